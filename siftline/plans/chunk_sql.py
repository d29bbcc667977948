"""SQL of the chunker for DuckDB: every sequential rule is a recursive table, one position after another."""

from __future__ import annotations

from siftline.config import EngineConfig
from siftline.functions import ids
from siftline.operators.chunking import CONTEXT_TOKENS, DEPENDENT, STRUCTURAL
from siftline.plans import sql as S

def sentences(x: str) -> str:
    """Split behind a stop that white space follows; a mark that no text holds stands in for the look-behind."""
    return rf"string_split(regexp_replace({x}, '([.!?]){S.WS}+', '\1' || chr(57344), 'g'), chr(57344))"


def sentence_walk(source: str, key: str, target: int, most: int) -> str:
    """``walk``: the sentences of ``source (key, body)`` taken up one by one; ``parts``: the texts they are packed into, numbered from 0."""
    overlap = max(10, target // 5)
    longer = "array_to_string(list_append(w.cur, s.s), ' ')"
    full = f"(len(w.cur) > 0 AND {S.token_count(longer)} > {most})"
    return f"""
sent AS (SELECT {key}, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT {key}, {sentences('body')} AS ss FROM {source})),
walk AS (
  SELECT {key}, 0::BIGINT AS i, []::VARCHAR[] AS cur, NULL::VARCHAR AS made FROM {source}
  UNION ALL
  SELECT w.{key}, s.i, CASE WHEN NOT {full} THEN list_append(w.cur, s.s) WHEN {S.token_count('w.cur[-1]')} <= {overlap} THEN [w.cur[-1], s.s] ELSE [s.s] END, CASE WHEN {full} THEN array_to_string(w.cur, ' ') END
  FROM walk w JOIN sent s ON s.{key} = w.{key} AND s.i = w.i + 1
),
parts AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS part, x AS body
  FROM (SELECT {key}, i, made AS x FROM walk WHERE made IS NOT NULL UNION ALL SELECT {key}, i + 1, array_to_string(cur, ' ') FROM walk WHERE len(cur) > 0 QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY i DESC) = 1))"""


def packed(c: EngineConfig = EngineConfig()) -> str:
    """Candidates with the span each is packed into, one position after another."""
    compatible = "(s.role IN ('header', 'intro') OR s.ptype IS NOT DISTINCT FROM a.ptype OR (s.ptype IN ('list', 'table') AND a.ptype IN ('list', 'table')) OR (s.tokens <= 30 AND a.tokens <= 30))"
    skip = "a.role IN ('boilerplate', 'duplicate_child')"
    return f"""{S.ANNOTATIONS.replace('a.tokens <= 20', f'a.tokens <= {c.hard_tokens}')},
step AS (
  SELECT row_ordinal, 0::BIGINT AS pos, -1 AS idx, false AS open, 0::BIGINT AS total, -1 AS span, '' AS role, NULL::VARCHAR AS ptype, 0::BIGINT AS tokens, -1 AS mark FROM (SELECT DISTINCT row_ordinal FROM ann)
  UNION ALL
  SELECT row_ordinal, pos, idx, goes OR NOT skip AS open, CASE WHEN goes THEN CASE WHEN skip THEN total ELSE total + n END WHEN skip THEN 0 ELSE n END,
    CASE WHEN goes OR skip THEN span ELSE span + 1 END, role, ptype, n, CASE WHEN goes THEN span WHEN skip THEN -1 ELSE span + 1 END
  FROM (SELECT s.row_ordinal, a.pos, a.idx, s.total, s.span, a.role, a.ptype, a.tokens AS n, {skip} AS skip,
    s.open AND s.total < {c.soft_tokens} AND ({skip} OR (coalesce({compatible}, false) AND s.total + a.tokens <= {c.max_tokens})) AS goes
    FROM step s JOIN ann a ON a.row_ordinal = s.row_ordinal AND a.pos = s.pos + 1)
)"""


def chunks(c: EngineConfig = EngineConfig()) -> str:
    """``final``: every chunk; :data:`packed` spans, long ones cut at sentences, each with its context. Needs hard <= soft limits."""
    longer = "(b.text || CASE WHEN k.prefix = '' THEN '' ELSE ' ' || k.prefix END)"
    wide = "(CASE WHEN prefix = '' THEN body ELSE prefix || ' ' || body END)"
    few = f"array_to_string(list_slice({S.words(wide)}, 1, {c.context_token_cap}), ' ')"
    usual = "CASE WHEN tables THEN 'table_span' WHEN lists THEN 'list_span' WHEN members > 1 THEN 'minimum_context_span' ELSE 'paragraph' END"
    name = "'{}' || chr(31) || '{}' || chr(31) || row_ordinal || chr(31) || first_idx || chr(31) || last_idx || chr(31) || left(body, 120)".format(c.dataset_name, c.dataset_split)
    return f"""{packed(c)},
member AS (SELECT s.mark AS span, a.* FROM step s JOIN ann a ON a.row_ordinal = s.row_ordinal AND a.pos = s.pos WHERE s.mark >= 0 AND a.role NOT IN ('boilerplate', 'duplicate_child')),
span AS (SELECT row_number() OVER () AS k, * FROM (SELECT row_ordinal, span, string_agg(text, ' ' ORDER BY pos) AS body, min(idx) AS first_idx, max(idx) AS last_idx, min(pos) AS first_pos, count(*) AS members,
  bool_or(role IN ({S.quoted(DEPENDENT)})) AS dependent, bool_or(role IN ('table_parent', 'table_child')) AS tables, bool_or(role IN ('list_parent', 'list_item')) AS lists,
  coalesce(array_to_string(list(ptype ORDER BY pos) FILTER (ptype IS NOT NULL), '|'), '') AS passage_types FROM member GROUP BY row_ordinal, span)),
long AS (SELECT k, body FROM span WHERE {S.token_count('body')} > {c.max_tokens}),
{sentence_walk('long', 'k', c.target_tokens, c.max_tokens)},
piece AS (SELECT k, 0 AS part, body FROM span WHERE {S.token_count('body')} <= {c.max_tokens} AND ({S.token_count('body')} >= {c.hard_tokens} OR {S.fact('body')})
  UNION ALL SELECT k, part + 1, body FROM parts WHERE {S.token_count('body')} >= {c.hard_tokens}),
made AS (SELECT row_number() OVER () AS id, p.part, p.body, {S.token_count('p.body')} AS n, s.* EXCLUDE (body) FROM piece p JOIN span s USING (k)),
back AS (
  SELECT id, row_ordinal, first_pos AS pos, ''::VARCHAR AS prefix, false AS done, body FROM made WHERE n < {c.soft_tokens} OR dependent OR members > 1
  UNION ALL
  SELECT id, row_ordinal, pos, prefix, found AND ({S.token_count('prefix')} >= {CONTEXT_TOKENS}) OR NOT found AND prefix <> '', body
  FROM (SELECT k.id, k.row_ordinal, b.pos, b.role IN ({S.quoted(STRUCTURAL)}) AS found, CASE WHEN b.role IN ({S.quoted(STRUCTURAL)}) AND NOT contains(k.body, b.text) THEN {longer} ELSE k.prefix END AS prefix, k.body
    FROM back k JOIN ann b ON b.row_ordinal = k.row_ordinal AND b.pos = k.pos - 1 WHERE NOT k.done)
),
context AS (SELECT id, CASE WHEN {S.token_count(wide)} <= {c.context_token_cap} THEN {wide} ELSE {few} END AS context_text FROM back QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
final AS (SELECT m.*, coalesce(x.context_text, body) AS context_text, CASE WHEN part > 0 THEN 'split_' || part WHEN n < {c.soft_tokens} THEN 'short_fact' ELSE {usual} END AS chunk_kind,
  '{c.dataset_name}:{c.dataset_split}:' || row_ordinal AS group_id, {S.uuid5(ids.CHUNK_NAMESPACE, name)} AS chunk_id FROM made m LEFT JOIN context x USING (id))"""

"""Queries of the chunking study: six strategies, their profiles, and a lexical proxy of retrieval over each."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.config import STRATEGIES
from siftline.functions import ids
from siftline.functions import text as T
from siftline.operators import strategies
from siftline.plans import sql as S
from siftline.plans.shared import kept
from siftline.sources.tables import table

K = 10


def _study(spark, d):
    return strategies.study_rows(table(spark, d, "nq_sample_rows"))


def _strategy(name):
    def query(spark, d):
        c = strategies.build(_study(spark, d), name)
        return c.select("chunk_id", "row_ordinal", "ord", "start_candidate_idx", "end_candidate_idx", "text", "chunk_kind", "token_count", "context_token_count")

    query.__name__ = f"strategy_{name}"
    return query


def dataset_profile(spark, d):
    return strategies.dataset_profile(_study(spark, d))


def candidate_type_counts(spark, d):
    return strategies.type_counts(_study(spark, d))


def _study_once(spark, d):
    """The study's rows and all chunks, made once: every figure reads them again."""
    rows = kept(_study(spark, d), "study")
    return rows, kept(strategies.build_all(rows), "study")


def strategy_profile(spark, d):
    rows, chunks = _study_once(spark, d)
    return strategies.strategy_profile(chunks, rows)


def bm25_proxy(spark, d):
    rows, chunks = _study_once(spark, d)
    hits = strategies.proxy_hits(strategies.study_queries(rows), chunks, rows, K)
    m = strategies.proxy_metrics(hits, K)
    return m.select("strategy", "query_count", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("strategy", "query_count")])


def budget_recall(spark, d):
    """Whether a relevant chunk comes before the running total of tokens passes a budget, for one strategy."""
    rows = kept(_study(spark, d), "study")
    hits = strategies.proxy_hits(strategies.study_queries(rows), kept(strategies.build(rows, "min_context"), "study"), rows, K)
    return strategies.proxy_metrics(hits, K, (128, 256, 512)).select("strategy", *[F.round(f"budget_{b}", 6).alias(f"budget_{b}") for b in (128, 256, 512)])


def example_chunks(spark, d):
    """The cap is the feature: the first ten relevant chunks of one strategy."""
    rows = _study(spark, d)
    return strategies.examples(strategies.build(rows, "parent_dedup"), rows).select("row_ordinal", "ord", "text")


_CANDS = f"""
sc0 AS (SELECT row_ordinal, i AS idx, {S.strip('c')} AS text, {S.optional('passage_types[i + 1]')} AS ptype, long_answers FROM (SELECT row_ordinal, passage_types, long_answers, unnest(candidates) AS c, unnest(range(len(candidates)))::INT AS i FROM nq_sample_rows) WHERE c IS NOT NULL AND {S.strip('c')} <> ''),
sc AS (SELECT row_ordinal, idx, row_number() OVER (PARTITION BY row_ordinal ORDER BY idx) AS pos, text, ptype, {S.token_count('text')} AS tokens, lower({S.normalize('text')}) AS low, {S.boilerplate(S.normalize('text'))} AS boiler, {S.intro_by_words(S.normalize('text'))} AS intro,
  len(list_filter(coalesce(long_answers, []), lambda a: a IS NOT NULL AND {S.normalize('a')} <> '' AND contains(lower({S.normalize('text')}), lower({S.normalize('a')})))) > 0 AS is_gold FROM sc0),
gold AS (SELECT row_ordinal, pos - 1 AS g, low, tokens FROM sc WHERE is_gold)"""
_GOES = "(s.ptype IS NOT DISTINCT FROM a.ptype OR (s.ptype IN ('list', 'table') AND a.ptype IN ('list', 'table')) OR s.intro OR s.ptype IN ('list_definition', 'section', 'header') OR (a.tokens <= 12 AND s.tokens <= 30))"


def _pack(name, least, most):
    return f"""{name} AS (
  SELECT row_ordinal, 0::BIGINT AS pos, -1 AS idx, NULL::VARCHAR AS text, true AS boiler, false AS open, 0::BIGINT AS total, -1 AS span, NULL::VARCHAR AS ptype, 0::BIGINT AS tokens, false AS intro, -1 AS mark FROM (SELECT DISTINCT row_ordinal FROM sc)
  UNION ALL
  SELECT row_ordinal, pos, idx, text, skip, goes OR NOT skip, CASE WHEN goes THEN CASE WHEN skip THEN total ELSE total + n END WHEN skip THEN 0 ELSE n END, CASE WHEN goes OR skip THEN span ELSE span + 1 END, ptype, n, intro, CASE WHEN goes THEN span WHEN skip THEN -1 ELSE span + 1 END
  FROM (SELECT s.row_ordinal, a.pos, a.idx, a.text, s.total, s.span, a.ptype, a.tokens AS n, a.intro, a.boiler AS skip, s.open AND s.total < {least} AND (a.boiler OR (s.total + a.tokens <= {most} AND coalesce({_GOES}, false))) AS goes FROM {name} s JOIN sc a ON a.row_ordinal = s.row_ordinal AND a.pos = s.pos + 1))"""


_DPR = """dpr AS (
  SELECT row_ordinal, 0::BIGINT AS pos, -1 AS idx, NULL::VARCHAR AS text, true AS boiler, 0::BIGINT AS total, -1 AS mark FROM (SELECT DISTINCT row_ordinal FROM sc)
  UNION ALL SELECT s.row_ordinal, a.pos, a.idx, a.text, a.boiler, CASE WHEN s.mark < 0 OR s.total + a.tokens > 100 THEN a.tokens ELSE s.total + a.tokens END, CASE WHEN s.mark < 0 OR s.total + a.tokens > 100 THEN s.mark + 1 ELSE s.mark END
  FROM dpr s JOIN sc a ON a.row_ordinal = s.row_ordinal AND a.pos = s.pos + 1)"""
_SPANS = "SELECT '{s}' AS strategy, row_ordinal, mark AS ord, min(idx) AS a, max(idx) AS b, coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (NOT boiler), '') AS text, '{k}' AS chunk_kind, NULL::VARCHAR AS context FROM {t} WHERE mark >= 0 GROUP BY 1, 2, 3"
_PARTS = {
    "raw_candidate": (None, "SELECT 'raw_candidate' AS strategy, row_ordinal, (pos - 1)::INT AS ord, idx AS a, idx AS b, text, 'candidate' AS chunk_kind, NULL::VARCHAR AS context FROM sc"),
    "whole_row": (None, "SELECT 'whole_row' AS strategy, row_ordinal, 0 AS ord, min(idx) AS a, max(idx) AS b, string_agg(text, chr(10) ORDER BY pos) AS text, 'row' AS chunk_kind, NULL::VARCHAR AS context FROM sc GROUP BY row_ordinal"),
    "dpr_window": (_DPR, _SPANS.format(s="dpr_window", k="fixed_window", t="dpr")),
    "parent_dedup": (
        None,
        "SELECT 'parent_dedup' AS strategy, row_ordinal, (pos - 1)::INT AS ord, idx AS a, idx AS b, text, 'parent_or_standalone' AS chunk_kind, NULL::VARCHAR AS context FROM sc c WHERE NOT boiler AND NOT (tokens <= 20 AND EXISTS (SELECT 1 FROM sc p WHERE p.row_ordinal = c.row_ordinal AND p.pos < c.pos AND p.tokens >= 40 AND NOT p.boiler AND contains(p.low, c.low)))",
    ),
    "min_context": (_pack("mc", 60, 220), _SPANS.format(s="min_context", k="minimum_context_span", t="mc")),
    "parent_child": (
        _pack("pc", 40, 180),
        f"SELECT 'parent_child' AS strategy, x.row_ordinal, ord, a, b, x.text, chunk_kind, l.text AS context FROM ({_SPANS.format(s='min_context', k='child_with_parent_context', t='pc')}) x JOIN (SELECT row_ordinal, text FROM sc QUALIFY row_number() OVER (PARTITION BY row_ordinal ORDER BY tokens DESC, idx) = 1) l USING (row_ordinal)",
    ),
}
_ALL_CH = ", ".join([_CANDS.strip(), *[p[0] for p in _PARTS.values() if p[0]], f"ch AS ({' UNION ALL '.join(p[1] for p in _PARTS.values())})"])
_REL = f"""cl AS (SELECT *, lower({S.normalize('text')}) AS low, {S.token_count('text')} AS tokens, CASE WHEN context IS NULL THEN {S.token_count('text')} ELSE {S.token_count('context')} END AS ctokens FROM ch),
rl AS (SELECT strategy, row_ordinal, ord, bool_or((a <= g AND g <= b) OR contains(gold.low, cl.low) OR contains(cl.low, gold.low)) AS rel FROM cl JOIN gold USING (row_ordinal) GROUP BY 1, 2, 3),
cr AS (SELECT cl.*, coalesce(rel, false) AS relevant FROM cl LEFT JOIN rl USING (strategy, row_ordinal, ord))"""
_DUP = "du AS (SELECT strategy, round(count(*) FILTER (length(low) > 5 AND EXISTS (SELECT 1 FROM cl y WHERE y.strategy = x.strategy AND y.row_ordinal = x.row_ordinal AND y.ord < x.ord AND (contains(y.low, x.low) OR contains(x.low, y.low)))) / count(*), 4) AS r FROM cl x GROUP BY 1)"
_PROXY = f"""q AS (SELECT row_ordinal AS query_id, {S.optional('question')} AS text FROM nq_sample_rows WHERE row_ordinal % 20 = 0 AND {S.optional('question')} IS NOT NULL AND row_ordinal IN (SELECT row_ordinal FROM gold)),
tk AS (SELECT strategy, row_ordinal, ord, {S.unicode_tokens('text')} AS t FROM ch), st AS (SELECT strategy, count(*) AS n, sum(len(t)) / count(*) AS avgdl FROM tk GROUP BY 1),
po AS (SELECT strategy, row_ordinal, ord, len, term, count(*) AS tf FROM (SELECT strategy, row_ordinal, ord, len(t) AS len, unnest(t) AS term FROM tk) GROUP BY ALL),
dr AS (SELECT strategy, term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po JOIN st USING (strategy) GROUP BY strategy, term, n), me AS (SELECT strategy, avg(raw) AS m FROM dr GROUP BY 1),
id AS (SELECT strategy, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM dr JOIN me USING (strategy)),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.unicode_tokens('text')}) AS term FROM q) GROUP BY 1, 2),
sx AS (SELECT strategy, query_id, row_ordinal, ord, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 9) AS score FROM po JOIN id USING (strategy, term) JOIN st USING (strategy) JOIN qt USING (term) GROUP BY 1, 2, 3, 4),
al AS (SELECT cr.strategy, query_id, cr.row_ordinal, cr.ord, relevant, ctokens, coalesce(score, 0) AS score FROM cr CROSS JOIN q LEFT JOIN sx USING (strategy, query_id, row_ordinal, ord)),
hi AS (SELECT *, row_number() OVER (PARTITION BY strategy, query_id ORDER BY score DESC, row_ordinal, ord) AS rank FROM al QUALIFY rank <= {K}),
ru AS (SELECT *, sum(ctokens) OVER (PARTITION BY strategy, query_id ORDER BY rank) AS used FROM hi)"""


def _proxy(budgets):
    per = ", ".join(f"max((relevant AND used <= {b})::INT) AS b{b}" for b in budgets)
    return f"""pq AS (SELECT strategy, query_id, max(relevant::INT) AS recall, count(*) FILTER (relevant) / {K} AS precision, coalesce(1 / min(rank) FILTER (relevant), 0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (relevant), 0) AS ndcg,
coalesce(sum(ctokens) FILTER (relevant) / nullif(sum(ctokens), 0), 0) AS density, {per} FROM ru GROUP BY 1, 2)"""


def _chunks_sql(name):
    key = f"strategy || chr(31) || row_ordinal || chr(31) || a || chr(31) || b || chr(31) || left({S.normalize('text')}, 120)"
    context = f"CASE WHEN context IS NULL THEN {S.token_count('text')} ELSE {S.token_count('context')} END"
    cte, select = _PARTS[name]
    # ids of the small spans are made before they get their context
    strategy = "strategy" if name != "parent_child" else "'min_context'"
    return f"WITH RECURSIVE {', '.join(x for x in (_CANDS.strip(), cte) if x)}, ch AS ({select}) SELECT {S.uuid5(ids.STUDY_NAMESPACE, key.replace('strategy', strategy, 1))} AS chunk_id, row_ordinal, ord, a AS start_candidate_idx, b AS end_candidate_idx, text, chunk_kind, {S.token_count('text')} AS token_count, {context} AS context_token_count FROM ch"


_Q = ", ".join(f"min(tokens) FILTER (upto > floor(total * {share})) AS {name}" for name, share in strategies.QUANTILES.items())
ORACLES = {
    **{f"strategy_{s}": _chunks_sql(s) for s in STRATEGIES},
    "candidate_type_counts": f"WITH {_CANDS} SELECT coalesce(ptype, '<missing>') AS passage_type, count(*) AS n FROM sc GROUP BY 1",
    "dataset_profile": f"""WITH {_CANDS}, pr AS (SELECT r.row_ordinal, count(sc.idx) AS n FROM nq_sample_rows r LEFT JOIN sc USING (row_ordinal) GROUP BY 1),
ct AS (SELECT tokens, sum(count(*)) OVER (ORDER BY tokens) AS upto, sum(count(*)) OVER () AS total FROM sc GROUP BY tokens),
ne AS (SELECT avg(EXISTS (SELECT 1 FROM sc x WHERE x.row_ordinal = c.row_ordinal AND x.pos > c.pos AND x.pos <= c.pos + 24 AND x.tokens <= 20 AND length(x.low) > 5 AND contains(c.low, x.low))::INT) AS r FROM sc c WHERE tokens > 80)
SELECT (SELECT count(*) FROM pr) AS sample_rows, (SELECT sum(n)::BIGINT FROM pr) AS total_candidates, (SELECT round(avg(n), 4) FROM pr) AS avg_candidates, (SELECT median(n) FROM pr) AS median_candidates,
{', '.join(f'(SELECT count(*) FROM sc WHERE tokens <= {n}) AS short_{n}' for n in (3, 5, 10, 20))}, {', '.join(f'(SELECT min(tokens) FROM ct WHERE upto > floor(total * {v})) AS {k}' for k, v in strategies.QUANTILES.items())},
(SELECT count(*) FROM gold) AS gold_count, (SELECT coalesce(round(avg(tokens), 4), 0) FROM gold) AS gold_token_avg, (SELECT coalesce(median(tokens), 0) FROM gold) AS gold_token_median, (SELECT coalesce(round(r, 4), 0) FROM ne) AS nearby_nested_parent_ratio""",
    "strategy_profile": f"""WITH RECURSIVE {_ALL_CH}, {_REL}, {_DUP}
SELECT cr.strategy, count(*) AS chunks, round(avg(tokens), 4) AS avg_tokens, median(tokens) AS median_tokens, count(*) FILTER (tokens <= 10) AS tiny_chunks_le_10, count(*) FILTER (tokens <= 20) AS tiny_chunks_le_20, count(*) FILTER (tokens > 300) AS huge_chunks_gt_300,
count(*) FILTER (relevant) AS relevant_chunks, coalesce(median(tokens) FILTER (relevant), 0) AS relevant_token_median, min(r) AS duplicate_like_ratio FROM cr JOIN du USING (strategy) GROUP BY 1""",
    "bm25_proxy": f"""WITH RECURSIVE {_ALL_CH}, {_REL}, {_PROXY}, {_proxy((512, 1024, 2048))}
SELECT strategy, count(*) AS query_count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('recall', 'precision', 'mrr', 'ndcg', 'density'))}, {', '.join(f'round(avg(b{b}), 6) AS budget_{b}' for b in (512, 1024, 2048))} FROM pq GROUP BY 1""",
    "budget_recall": f"WITH RECURSIVE {_ALL_CH}, {_REL}, {_PROXY}, {_proxy((128, 256, 512))} SELECT strategy, {', '.join(f'round(avg(b{b}), 6) AS budget_{b}' for b in (128, 256, 512))} FROM pq WHERE strategy = 'min_context' GROUP BY 1",
    "example_chunks": f"WITH RECURSIVE {_ALL_CH}, {_REL} SELECT row_ordinal, ord, CASE WHEN length({S.normalize('text')}) <= 220 THEN {S.normalize('text')} ELSE left({S.normalize('text')}, 220) || '...' END AS text FROM cr WHERE relevant AND strategy = 'parent_dedup' ORDER BY row_ordinal, ord LIMIT 10",
}
QUERIES = {f.__name__: f for f in (*map(_strategy, STRATEGIES), dataset_profile, candidate_type_counts, strategy_profile, bm25_proxy, budget_recall, example_chunks)}
assert T.WORD

"""Queries of problem 2: nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import nested
from siftline.sources.tables import table


def p2_found(spark, d):
    return nested.orphans(table(spark, d, "nq_sample_rows"), table(spark, d, "index_chunk_groups"))


def p2_candidates(spark, d):
    rows = nested.child_table(table(spark, d, "nq_sample_rows"), "id", "candidates")
    return rows.select("parent_id", "pos", F.col("value").alias("candidate"), "variant")


def p2_types(spark, d):
    rows = nested.child_table(table(spark, d, "nq_sample_rows"), "id", "passage_types")
    return rows.select("parent_id", "pos", F.col("value").alias("passage_type"), "variant")


def p2_texts(spark, d):
    groups = nested.once(table(spark, d, "index_chunk_groups").select("group_id", "texts", "written_at"), "group_id", "written_at")
    return nested.child_table(groups, "group_id", "texts").select("parent_id", "pos", "text_idx", "raw_idx", "passage_type", "text")


def _together(parts):
    """Subtype tables again as one, columns that a subtype lacks being null."""
    both = None
    for name, part in parts.items():
        part = part.withColumn("subtype", F.lit(name))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    return both


def p2_chunks(spark, d):
    """The chunks that are not null as its SQL has them, without the context tokens of plain ones; p2_chunk_rows leaves nothing out."""
    both = _together(nested.chunk_subtypes(table(spark, d, "index_chunk_groups")))
    tokens = F.when(F.col("subtype") != "plain", F.col("context_token_count")).alias("context_token_count")
    return both.select("parent_id", "pos", "subtype", "chunk_id", "start_candidate_idx", "end_candidate_idx", "chunk_kind", "token_count", tokens, "parent_candidate_idx")


def p2_chunk_rows(spark, d):
    """Every element of the chunks with its stored values and types, null elements too."""
    both = _together(nested.chunk_subtypes(table(spark, d, "index_chunk_groups"), nulls=True))
    return both.select("parent_id", "pos", "subtype", "chunk_id", "start_candidate_idx", "end_candidate_idx", "passage_types", "chunk_kind", "token_count", "context_token_count", "parent_candidate_idx")


def p2_references(spark, d):
    return nested.references(table(spark, d, "index_chunk_groups"))


def p2_variants(spark, d):
    return nested.variant_counts(table(spark, d, "nq_sample_rows"), ["candidates", "passage_types"])


_BLANK = r"'^[ \t\r\n]*$'"
_STATE = "CASE WHEN {x} IS NULL THEN 'n' WHEN regexp_matches({x}, " + _BLANK + ") THEN 'b' ELSE 'v' END"
_LATEST = "g AS (SELECT * FROM index_chunk_groups WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY written_at DESC) = 1)"
_LIST_STATE = (
    "CASE WHEN {c} IS NULL THEN 'n' WHEN len({c}) = 0 THEN 'e' ELSE '[' || array_to_string(list_sort(list_distinct("
    "list_transform({c}, lambda x: CASE WHEN x IS NULL THEN 'n' WHEN regexp_matches(x, " + _BLANK + ") THEN 'b' ELSE 'v' END))), '|') || ']' END"
)
ORACLES = {
    "p2_found": f"""
WITH r AS (SELECT id, candidates AS c, passage_types AS t, unnest(range(greatest(coalesce(len(candidates), 0), coalesce(len(passage_types), 0)))) AS i FROM nq_sample_rows),
p AS (SELECT id, i, c IS NOT NULL AND i < len(c) AS has_c, {_STATE.format(x="c[i + 1]")} AS cs, {_STATE.format(x="t[i + 1]")} AS ts FROM r),
{_LATEST},
k AS (SELECT group_id, unnest(chunks) AS c, unnest(range(len(chunks))) AS pos FROM g),
refs AS (SELECT group_id, pos, 'text_ref' AS child, unnest(c.text_idxs) AS v FROM k UNION ALL SELECT group_id, pos, 'context_ref', unnest(c.context_idxs) FROM k),
t AS (SELECT group_id, u.text_idx AS v FROM (SELECT group_id, unnest(texts) AS u FROM g))
SELECT id AS parent_id, 'candidate' AS child, i::BIGINT AS child_pos, (-1)::BIGINT AS text_idx FROM p WHERE cs = 'v' AND ts <> 'v'
UNION ALL SELECT id, 'type', i::BIGINT, (-1)::BIGINT FROM p WHERE ts = 'v' AND NOT has_c
UNION ALL SELECT DISTINCT group_id, child, pos::BIGINT, v::BIGINT FROM refs WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.group_id = refs.group_id AND t.v = refs.v)
UNION ALL SELECT DISTINCT group_id, 'text', (-1)::BIGINT, v::BIGINT FROM t WHERE v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM refs WHERE refs.group_id = t.group_id AND refs.v = t.v)
""",
    "p2_candidates": f"""
SELECT parent_id, pos, candidate, {_STATE.format(x="candidate")} AS variant FROM
(SELECT id AS parent_id, unnest(range(len(candidates)))::BIGINT AS pos, unnest(candidates) AS candidate FROM nq_sample_rows)""",
    "p2_types": f"""
SELECT parent_id, pos, passage_type, {_STATE.format(x="passage_type")} AS variant FROM
(SELECT id AS parent_id, unnest(range(len(passage_types)))::BIGINT AS pos, unnest(passage_types) AS passage_type FROM nq_sample_rows)""",
    "p2_texts": f"""
WITH {_LATEST}
SELECT parent_id, pos, x.text_idx AS text_idx, x.raw_idx AS raw_idx, x.passage_type AS passage_type, x.text AS text FROM
(SELECT group_id AS parent_id, unnest(range(len(texts)))::BIGINT AS pos, unnest(texts) AS x FROM g)""",
    "p2_chunks": f"""
WITH {_LATEST}, k AS (SELECT group_id AS parent_id, unnest(range(len(chunks)))::BIGINT AS pos, unnest(chunks) AS c FROM g)
SELECT parent_id, pos, CASE WHEN c.parent_candidate_idx IS NOT NULL THEN 'child' WHEN coalesce(len(c.context_idxs), 0) = 0 THEN 'plain' ELSE 'contextual' END AS subtype,
c.chunk_id AS chunk_id, c.start_candidate_idx AS start_candidate_idx, c.end_candidate_idx AS end_candidate_idx, c.chunk_kind AS chunk_kind, c.token_count AS token_count,
CASE WHEN coalesce(len(c.context_idxs), 0) > 0 OR c.parent_candidate_idx IS NOT NULL THEN c.context_token_count END AS context_token_count, c.parent_candidate_idx AS parent_candidate_idx FROM k WHERE c IS NOT NULL""",
    "p2_chunk_rows": f"""
WITH {_LATEST}, k AS (SELECT group_id AS parent_id, unnest(range(len(chunks)))::BIGINT AS pos, unnest(chunks) AS c FROM g)
SELECT parent_id, pos, CASE WHEN c IS NULL THEN 'null' WHEN c.parent_candidate_idx IS NOT NULL THEN 'child' WHEN coalesce(len(c.context_idxs), 0) = 0 THEN 'plain' ELSE 'contextual' END AS subtype,
c.chunk_id AS chunk_id, c.start_candidate_idx AS start_candidate_idx, c.end_candidate_idx AS end_candidate_idx, c.passage_types AS passage_types, c.chunk_kind AS chunk_kind, c.token_count AS token_count,
c.context_token_count AS context_token_count, c.parent_candidate_idx AS parent_candidate_idx FROM k""",
    "p2_references": f"""
WITH {_LATEST}, k AS (SELECT group_id, list_transform(texts, lambda t: t.text_idx) AS t, unnest(chunks) AS c, unnest(range(len(chunks)))::BIGINT AS pos FROM g),
r AS (SELECT group_id, t, pos, 'text_idxs' AS list, unnest(range(len(c.text_idxs)))::BIGINT AS ref_pos, unnest(c.text_idxs) AS v FROM k
UNION ALL SELECT group_id, t, pos, 'context_idxs', unnest(range(len(c.context_idxs)))::BIGINT, unnest(c.context_idxs) FROM k)
SELECT group_id AS parent_id, pos AS chunk_pos, list, ref_pos, v AS text_idx, coalesce(list_contains(t, v), false) AS found FROM r""",
    "p2_variants": f"""
SELECT 'candidates=' || {_LIST_STATE.format(c="candidates")} || ';passage_types=' || {_LIST_STATE.format(c="passage_types")} AS variant, count(*) AS records
FROM nq_sample_rows GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (p2_found, p2_candidates, p2_types, p2_texts, p2_chunks, p2_chunk_rows, p2_references, p2_variants)}

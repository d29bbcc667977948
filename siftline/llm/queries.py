"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.llm import boilerplate, copies, encode, lookalike, mixture, neighbours, residue, termfreq
from siftline.sources.tables import table


def p1_found(spark, d):
    return copies.find(table(spark, d, "nq_sample_rows"), table(spark, d, "index_chunks"))


def p1_collapsed(spark, d):
    return copies.collapse(table(spark, d, "nq_sample_rows"), table(spark, d, "index_chunks"))


def p3_found(spark, d):
    return neighbours.pairs(table(spark, d, "dense_points"))


def p3_neighbours(spark, d):
    """The chunks most similar to each chunk that has a usable vector, however similar they are, with their texts' ids."""
    chunks = table(spark, d, "index_chunks").where("text IS NOT NULL").select(F.col("chunk_id").alias("point_id"), "group_id")
    return neighbours.neighbours(table(spark, d, "dense_points"), least=-1.0, probes=neighbours.FAR_PROBES, reach=neighbours.FAR_REACH).join(chunks, "point_id").select("point_id", "group_id", "other_id", F.round("similarity", 6).alias("similarity"))


def p4_found(spark, d):
    return termfreq.find(table(spark, d, "pass1_states"))


def p4_terms(spark, d):
    return termfreq.bands(table(spark, d, "pass1_states"))


def p5_found(spark, d):
    return lookalike.find(table(spark, d, "nq_sample_rows"))


def p5_normalised(spark, d):
    return lookalike.normalise(table(spark, d, "nq_sample_rows"))


def p6_found(spark, d):
    return boilerplate.chrome_lines(table(spark, d, "nq_sample_rows"))


def p6_main_body(spark, d):
    return boilerplate.main_body(table(spark, d, "nq_sample_rows"))


def p7_ids(spark, d):
    return encode.encode(table(spark, d, "documents"), ["doc_id"])


def p8_mixture(spark, d):
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p8_shares(spark, d):
    return mixture.shares(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_found(spark, d):
    return residue.residue(table(spark, d, "documents")).select("doc_id").distinct()


def p9_clean(spark, d):
    return residue.clean(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p3_found, p3_neighbours, p4_found, p4_terms, p5_found, p5_normalised, p6_found, p6_main_body, p7_ids, p8_mixture, p8_shares, p9_found, p9_clean)}
_TERMS = """
WITH s AS (SELECT * FROM pass1_states WHERE nd IS NOT NULL OR term_to_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY written_at DESC) = 1),
e AS (SELECT unnest(map_keys(nd)) AS term, unnest(map_values(nd)) AS chunks, 0 AS occurrences FROM s
UNION ALL SELECT unnest(map_keys(term_count)), 0, unnest(map_values(term_count)) FROM s UNION ALL SELECT unnest(map_keys(term_to_id)), 0, 0 FROM s),
t AS (SELECT term, sum(chunks)::BIGINT AS chunks, sum(occurrences)::BIGINT AS occurrences FROM e GROUP BY term),
b AS (SELECT term, chunks, occurrences, CASE WHEN chunks < 3 THEN 'rare' WHEN chunks > 0.2 * (SELECT sum(document_count) FROM s) THEN 'common' ELSE 'useful' END AS band FROM t)
"""
_STRIP = r"replace(replace(lower(regexp_replace({x}, '[\p{{P}}\p{{Z}}\x{{85}}\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"
_BLANK = r"regexp_full_match({x}, '[\s\x0b\x{{85}}\p{{Z}}\x1c-\x1f]*')"
_PIECES = rf"list_filter(string_split_regex(t, '[;|\n\r\x{{85}}\x{{2028}}\x{{2029}}]'), lambda p: NOT {_BLANK.format(x='p')})"
#: Records by a key that is equal for copies: the parts' stripped texts in order, those of fields in the order of their fields.
_COPIES = rf"""
WITH r AS (SELECT 'row' AS kind, id, candidates AS parts, true AS fields FROM nq_sample_rows WHERE candidates IS NOT NULL AND id IS NOT NULL
  UNION ALL SELECT 'chunk', chunk_id, [text], coalesce(chunk_kind, '') = 'table_span' FROM index_chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
p AS (SELECT kind, id, fields AND contains(t, ':') AND len(pieces) > 1 AND len(list_filter(pieces, lambda p: NOT regexp_matches(p, '(?s)^[^:]*[\p{{L}}\p{{N}}][^:]*:.*[\p{{L}}\p{{N}}]'))) = 0 AS listed, t, pieces
  FROM (SELECT kind, id, fields, t, {_PIECES} AS pieces FROM (SELECT kind, id, fields, unnest(parts) AS t FROM r) WHERE t IS NOT NULL AND NOT {_BLANK.format(x='t')})),
k AS (SELECT kind, id, string_agg(key || chr(1), '' ORDER BY key) AS key FROM (SELECT kind, id, CASE WHEN listed THEN array_to_string(list_sort(list_transform(pieces, lambda p: {_STRIP.format(x='p')})), '') ELSE {_STRIP.format(x='t')} END AS key FROM p) GROUP BY kind, id),
m AS (SELECT r.kind, r.id, min(r.id) OVER w AS keep_id, count(*) OVER w AS copies FROM r LEFT JOIN k USING (kind, id) WINDOW w AS (PARTITION BY r.kind, coalesce(k.key, '')))
"""
ORACLES = {
    "p1_found": _COPIES + "SELECT kind, keep_id, id AS copy_id FROM m WHERE id <> keep_id",
    "p1_collapsed": _COPIES + "SELECT kind, keep_id, copies FROM m WHERE id = keep_id",
    # all pairs of points: exact, so it also tells what the index misses
    "p3_found": """WITH d AS (SELECT point_id, arg_max(dense, embedded_at)::DOUBLE[] AS v FROM dense_points WHERE point_id IS NOT NULL AND len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  AND len(list_filter(dense, lambda x: x <> 0)) > 0 GROUP BY point_id),
s AS (SELECT a.point_id AS a, b.point_id AS b, round(list_cosine_similarity(a.v, b.v), 9) AS c FROM d a JOIN d b ON a.point_id <> b.point_id)
SELECT DISTINCT least(a, b) AS point_a, greatest(a, b) AS point_b FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5) WHERE c >= 0.85""",
    "p4_found": _TERMS + "SELECT term, band FROM b WHERE band <> 'useful'",
    "p4_terms": _TERMS + "SELECT term, chunks, occurrences, band FROM b",
}

"""Queries of text functions, ingestion, chunking and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.config import ANALYZERS
from siftline.functions import ids
from siftline.functions import text as T
from siftline.operators import audit, chunking, ingest
from siftline.plans import chunk_sql as C
from siftline.plans import sql as S
from siftline.sources.tables import table


def _rows(spark, d):
    return table(spark, d, "nq_sample_rows")


def _chunks(spark, d):
    return table(spark, d, "index_chunks")


def normalize_text(spark, d):
    return _chunks(spark, d).select("chunk_id", T.normalize(F.col("text")).alias("normalized"), T.normalize(F.col("title")).alias("title"))


def token_count(spark, d):
    c = _chunks(spark, d)
    return c.select("chunk_id", T.token_count(F.col("text")).alias("tokens"), F.size(T.words(F.col("text"))).alias("words"))


def optional_strings(spark, d):
    return _rows(spark, d).select("id", *[T.optional(F.col(c)).alias(c) for c in ("title", "question", "document_url")], F.array_join(ingest.long_answers(F.col("long_answers")), "|").alias("answers"))


def text_predicates(spark, d):
    x = F.col("text")
    return _chunks(spark, d).select("chunk_id", T.is_boilerplate(x).alias("boilerplate"), T.is_intro(x).alias("intro"), T.is_intro_by_words(x).alias("intro_by_words"), T.is_fact(x).alias("fact"), T.is_followup_fragment(x).alias("followup"))


def first_sentence(spark, d):
    return _chunks(spark, d).select("chunk_id", T.first_sentence(F.col("text")).alias("sentence"), T.display(F.col("text"), 60).alias("shown"))


def safe_urls(spark, d):
    return _rows(spark, d).select("id", T.safe_url(F.concat("document_url", F.lit("?q=1#top"))).alias("url"))


def _analyzer(name):
    def query(spark, d):
        return _chunks(spark, d).select("chunk_id", F.array_join(T.analyze(F.col("text"), name), " ").alias("tokens"))

    query.__name__ = f"analyzer_{name}"
    return query


def uuid5_ids(spark, d):
    return ingest.explode_passages(_rows(spark, d)).select("row_ordinal", "candidate_idx", "passage_id")


def explode_passages(spark, d):
    p = ingest.explode_passages(_rows(spark, d))
    return p.select("row_ordinal", "candidate_idx", "text", "title", "question", "passage_type", "document_url", F.array_join("long_answers", "|").alias("answers"))


def flatten_chunks(spark, d):
    from siftline.operators.nested import once

    groups = once(table(spark, d, "index_chunk_groups"), "group_id", "written_at")
    return ingest.flatten_groups(groups).select("group_id", "chunk_id", "text", "context_text", "chunk_kind", "token_count")


def chunk_rejects(spark, d):
    """References of chunks to texts that their group lacks."""
    from siftline.operators.nested import once

    return ingest.rejected_references(once(table(spark, d, "index_chunk_groups"), "group_id", "written_at"))


def group_chunks(spark, d):
    g = ingest.group_chunks(_chunks(spark, d), _rows(spark, d))
    flat = ingest.flatten_groups(g)
    return flat.select("group_id", "chunk_id", "text", "context_text")


def index_records(spark, d):
    groups = table(spark, d, "index_chunk_groups").select("group_id", "source_row_ordinal", "title", "question", "document_url", "texts", "chunks")
    flat = _chunks(spark, d).select("chunk_id", "text", "context_text", "title", "question")
    passages = ingest.explode_passages(_rows(spark, d)).select("passage_id", "text", "title", "question")
    lines = groups.unionByName(flat, allowMissingColumns=True).unionByName(passages, allowMissingColumns=True)
    return ingest.index_records(lines)


def row_counts(spark, d):
    rows, chunks = _rows(spark, d), _chunks(spark, d)
    a = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("candidates").isNotNull()).alias("rows_with_candidates"))
    b = ingest.explode_passages(rows).agg(F.count(F.lit(1)).alias("passages"))
    return a.crossJoin(b).crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))  # one row each


def max_rows_cap(spark, d):
    """The cap is the feature: the first rows in the order of ordinals."""
    return ingest.explode_passages(ingest.first_rows(_rows(spark, d), 50)).select("row_ordinal", "candidate_idx", "text")


def max_passages_cap(spark, d):
    """The cap is the feature: the first passages in the order of rows and candidates."""
    return ingest.first_passages(ingest.explode_passages(_rows(spark, d)), 100).select("row_ordinal", "candidate_idx", "text")


def point_payloads(spark, d):
    c = _chunks(spark, d)
    p = ingest.point_payload(c.select("chunk_id", "text", "title", "question", "parent_candidate_idx", "token_count", "long_answers"))
    got = lambda f: F.get_json_object("payload", f"$.{f}").alias(f)
    return p.select("point_id", got("title"), got("parent_candidate_idx"), got("token_count"), F.contains(F.col("payload"), F.lit('"long_answers"')).alias("has_answers"))


def embedding_texts(spark, d):
    return _chunks(spark, d).select("chunk_id", ingest.embedding_text(F.col("text"), F.col("title")).alias("input"))


def candidate_roles(spark, d):
    return chunking.candidates_of(chunking.annotate(_rows(spark, d))).select("row_ordinal", "candidate_idx", "tokens", "role", "passage_type")


def duplicate_children(spark, d):
    return chunking.candidates_of(chunking.annotate(_rows(spark, d))).where("role = 'duplicate_child'").select("row_ordinal", "candidate_idx", "parent_candidate_idx")


def role_histogram(spark, d):
    return chunking.candidates_of(chunking.annotate(_rows(spark, d))).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def span_packing(spark, d):
    packed = chunking.pack(chunking.annotate(_rows(spark, d)))
    z = F.transform(F.arrays_zip("anns", "spans"), lambda x: F.struct(x["anns"]["idx"].alias("candidate_idx"), x["spans"].alias("span")))
    return packed.select("row_ordinal", F.inline_outer(z)).where("candidate_idx IS NOT NULL")


def sentence_packing(spark, d):
    parts = chunking.split_sentences(T.normalize(F.col("text")), 20, 30)
    return _chunks(spark, d).where("text IS NOT NULL").select("chunk_id", F.posexplode(parts).alias("part", "text"))


def chunks(spark, d):
    c = chunking.chunk(_rows(spark, d))
    return c.select("chunk_id", "group_id", "source_row_ordinal", "start_candidate_idx", "end_candidate_idx", "text", "chunk_kind", "token_count", F.array_join("passage_types", "|").alias("passage_types"), "title", "question")


def chunk_context(spark, d):
    return chunking.chunk(_rows(spark, d)).select("source_row_ordinal", "start_candidate_idx", "span", "part", "context_text", "context_token_count")


def chunk_counters(spark, d):
    c = chunking.counters(_rows(spark, d))
    return c.select("rows", "candidates", "tiny_candidates", "boilerplate", "duplicate_children", "chunks", "short_facts", "context_expanded", "tiny_suppressed", F.to_json("role_counts").alias("role_counts"))


def continuity_pairs(spark, d):
    return audit.continuity_pairs(_rows(spark, d))


def continuity_summary(spark, d):
    return audit.continuity_summary(_rows(spark, d)).withColumn("likely_ratio", F.round("likely_ratio", 6))


def duplicate_text_groups(spark, d):
    return audit.duplicate_text_groups(_rows(spark, d))


def contiguous_groups(spark, d):
    return audit.contiguous_groups(_rows(spark, d).select("title", "question", "document_url", "row_ordinal"), "row_ordinal")


_PASSAGES = f"""
p AS (SELECT row_ordinal, i AS candidate_idx, {S.strip('c')} AS text, {S.optional('title')} AS title, {S.optional('question')} AS question, {S.optional('passage_types[i + 1]')} AS passage_type, {S.optional('document_url')} AS document_url, long_answers
  FROM (SELECT *, unnest(candidates) AS c, unnest(range(len(candidates)))::INT AS i FROM nq_sample_rows) WHERE c IS NOT NULL AND {S.strip('c')} <> '')"""
_GROUPS = "g AS (SELECT * FROM index_chunk_groups WHERE group_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY written_at DESC) = 1)"
_FLAT = """
k AS (SELECT group_id, texts, unnest(chunks) AS c FROM {g}), f AS (SELECT group_id, c.chunk_id AS chunk_id,
  coalesce(array_to_string(list_filter(list_transform(c.text_idxs, lambda i: list_filter(texts, lambda t: t.text_idx = i)[1].text), lambda x: x IS NOT NULL), ' '), '') AS text,
  coalesce(array_to_string(list_filter(list_transform(c.context_idxs, lambda i: list_filter(texts, lambda t: t.text_idx = i)[1].text), lambda x: x IS NOT NULL), ' '), '') AS context_text,
  c.chunk_kind AS chunk_kind, c.token_count AS token_count FROM k WHERE c IS NOT NULL)"""
ORACLES = {
    "normalize_text": f"SELECT chunk_id, {S.normalize('text')} AS normalized, {S.normalize('title')} AS title FROM index_chunks",
    "token_count": f"SELECT chunk_id, {S.token_count('text')} AS tokens, len({S.words('text')}) AS words FROM index_chunks",
    "optional_strings": f"SELECT id, {S.optional('title')} AS title, {S.optional('question')} AS question, {S.optional('document_url')} AS document_url, coalesce(array_to_string(list_filter(long_answers, lambda a: a IS NOT NULL), '|'), '') AS answers FROM nq_sample_rows",
    "text_predicates": f"SELECT chunk_id, {S.boilerplate('text')} AS boilerplate, {S.intro('text')} AS intro, {S.intro_by_words('text')} AS intro_by_words, {S.fact('text')} AS fact, contains(text, chr(10)) OR len({S.words('text')}) BETWEEN 1 AND 16 AS followup FROM index_chunks",
    "first_sentence": rf"SELECT chunk_id, {S.strip("CASE WHEN regexp_extract(text, '([^\n]+?[.!?])(?:" + S.WS + r"|$)', 1) <> '' THEN regexp_extract(text, '([^\n]+?[.!?])(?:" + S.WS + r"|$)', 1) ELSE text END")} AS sentence, CASE WHEN length({S.normalize('text')}) <= 60 THEN {S.normalize('text')} ELSE left({S.normalize('text')}, 60) || '...' END AS shown FROM index_chunks",
    "safe_urls": "SELECT id, document_url AS url FROM nq_sample_rows",
    **{f"analyzer_{a}": f"SELECT chunk_id, array_to_string({S.analyze('text', a)}, ' ') AS tokens FROM index_chunks" for a in ANALYZERS},
    "uuid5_ids": f"WITH {_PASSAGES} SELECT row_ordinal, candidate_idx, {S.uuid5(ids.PASSAGE_NAMESPACE, "'nq_sample' || chr(31) || 'train' || chr(31) || row_ordinal || chr(31) || candidate_idx")} AS passage_id FROM p",
    "explode_passages": f"WITH {_PASSAGES} SELECT row_ordinal, candidate_idx, text, title, question, passage_type, document_url, coalesce(array_to_string(list_filter(long_answers, lambda a: a IS NOT NULL), '|'), '') AS answers FROM p",
    "flatten_chunks": f"WITH {_GROUPS}, {_FLAT.format(g='g')} SELECT group_id, chunk_id, text, context_text, chunk_kind, token_count FROM f",
    "group_chunks": "SELECT group_id, chunk_id, text, context_text FROM index_chunks",
    "index_records": f"""WITH {_PASSAGES}, {_FLAT.format(g='index_chunk_groups').replace('texts, unnest', 'title, question, texts, unnest').replace('SELECT group_id, c.chunk_id', 'SELECT title, question, c.chunk_id')}
SELECT 'group' AS record_kind, chunk_id AS point_id, text, context_text, title, question FROM f UNION ALL SELECT 'chunk', chunk_id, text, context_text, title, question FROM index_chunks WHERE chunk_id IS NOT NULL
UNION ALL SELECT 'passage', {S.uuid5(ids.PASSAGE_NAMESPACE, "'nq_sample' || chr(31) || 'train' || chr(31) || row_ordinal || chr(31) || candidate_idx")}, text, NULL, title, question FROM p""",
    "chunk_rejects": f"""WITH {_GROUPS}, k AS (SELECT group_id, texts, unnest(chunks) AS c FROM g), r AS (SELECT group_id, c.chunk_id AS chunk_id, texts, unnest(['text_idxs', 'context_idxs']) AS field, unnest([c.text_idxs, c.context_idxs]) AS refs FROM k WHERE c IS NOT NULL),
e AS (SELECT DISTINCT group_id, chunk_id, field, texts, unnest(refs) AS text_idx FROM r) SELECT group_id, chunk_id, field, text_idx FROM e WHERE text_idx IS NOT NULL AND NOT coalesce(list_contains(list_transform(texts, lambda t: t.text_idx), text_idx), false)""",
    "row_counts": f"WITH {_PASSAGES} SELECT (SELECT count(*) FROM nq_sample_rows) AS rows, (SELECT count(*) FROM nq_sample_rows WHERE candidates IS NOT NULL) AS rows_with_candidates, (SELECT count(*) FROM p) AS passages, (SELECT count(*) FROM index_chunks) AS chunks",
    "max_rows_cap": f"WITH {_PASSAGES} SELECT row_ordinal, candidate_idx, text FROM p WHERE row_ordinal IN (SELECT row_ordinal FROM nq_sample_rows ORDER BY row_ordinal LIMIT 50)",
    "max_passages_cap": f"WITH {_PASSAGES} SELECT row_ordinal, candidate_idx, text FROM p ORDER BY row_ordinal, candidate_idx LIMIT 100",
    "point_payloads": "SELECT chunk_id AS point_id, title, parent_candidate_idx::VARCHAR AS parent_candidate_idx, token_count::VARCHAR AS token_count, coalesce(len(long_answers), 0) > 0 AS has_answers FROM index_chunks",
    "embedding_texts": f"SELECT chunk_id, CASE WHEN {S.optional('title')} IS NOT NULL THEN text || chr(10) || 'Title: ' || {S.strip('title')} ELSE text END AS input FROM index_chunks",
    "candidate_roles": f"WITH {S.ANNOTATIONS} SELECT row_ordinal, idx AS candidate_idx, tokens, role, ptype AS passage_type FROM ann",
    "duplicate_children": f"WITH {S.ANNOTATIONS} SELECT row_ordinal, idx AS candidate_idx, parent AS parent_candidate_idx FROM ann WHERE role = 'duplicate_child'",
    "role_histogram": f"WITH {S.ANNOTATIONS} SELECT role, count(*) AS n FROM ann GROUP BY role",
    "span_packing": f"WITH RECURSIVE {C.packed()} SELECT row_ordinal, idx AS candidate_idx, mark AS span FROM step WHERE pos > 0",
    "continuity_pairs": f"""WITH {_PASSAGES}, l AS (SELECT row_ordinal, candidate_idx, text, lead(candidate_idx) OVER w AS right_idx, lead(text) OVER w AS right_text FROM p WINDOW w AS (PARTITION BY row_ordinal ORDER BY candidate_idx))
SELECT row_ordinal, candidate_idx AS left_idx, right_idx, (ends_with(text, ':') OR ({S.contains_any('lower(text)', T.INTRO_MARKERS)} AND ends_with(text, '.'))) AND (contains(right_text, chr(10)) OR len({S.words('right_text')}) BETWEEN 1 AND 16) AS likely FROM l WHERE right_idx IS NOT NULL""",
    "duplicate_text_groups": f"WITH {_PASSAGES} SELECT text, count(*) AS occurrences, count(DISTINCT row_ordinal) AS distinct_rows FROM p GROUP BY text HAVING count(DISTINCT row_ordinal) >= 2",
    "contiguous_groups": """WITH m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR title IS DISTINCT FROM lag(title) OVER w OR question IS DISTINCT FROM lag(question) OVER w OR document_url IS DISTINCT FROM lag(document_url) OVER w THEN 1 ELSE 0 END AS n
  FROM nq_sample_rows WINDOW w AS (ORDER BY row_ordinal)), i AS (SELECT *, sum(n) OVER (ORDER BY row_ordinal) - 1 AS group_no FROM m)
SELECT group_no::BIGINT AS group_no, min(row_ordinal) AS first_row, max(row_ordinal) AS last_row, count(*) AS members, min(title) AS title, min(question) AS question, min(document_url) AS document_url FROM i GROUP BY group_no""",
}
ORACLES["continuity_summary"] = f"""WITH x AS ({ORACLES['continuity_pairs']}) SELECT (SELECT count(*) FROM nq_sample_rows) AS scanned_rows, (SELECT count(candidates) FROM nq_sample_rows) AS rows_with_candidates,
(SELECT count(*) FROM (WITH {_PASSAGES} SELECT * FROM p)) AS total_candidates, count(*) AS adjacent_pairs, count(*) FILTER (likely) AS likely_continuations, round(count(*) FILTER (likely) / count(*), 6) AS likely_ratio FROM x"""
_FINAL = f"WITH RECURSIVE {C.chunks()}"
ORACLES["sentence_packing"] = f"""WITH RECURSIVE source AS (SELECT chunk_id, {S.normalize('text')} AS body FROM index_chunks WHERE text IS NOT NULL), {C.sentence_walk('source', 'chunk_id', 20, 30)}
SELECT chunk_id, part::INT AS part, body AS text FROM parts"""
ORACLES["chunks"] = f"""{_FINAL} SELECT chunk_id, group_id, row_ordinal AS source_row_ordinal, first_idx AS start_candidate_idx, last_idx AS end_candidate_idx, body AS text, chunk_kind, n AS token_count, final.passage_types AS passage_types,
{S.optional('title')} AS title, {S.optional('question')} AS question FROM final JOIN nq_sample_rows USING (row_ordinal)"""
ORACLES["chunk_context"] = f"{_FINAL} SELECT row_ordinal AS source_row_ordinal, first_idx AS start_candidate_idx, span, part, context_text, {S.token_count('context_text')} AS context_token_count FROM final"
ORACLES["chunk_counters"] = f"""{_FINAL} SELECT (SELECT count(*) FROM nq_sample_rows) AS rows, (SELECT count(*) FROM ann) AS candidates, (SELECT count(*) FROM ann WHERE tokens <= 60) AS tiny_candidates,
(SELECT count(*) FROM ann WHERE role = 'boilerplate') AS boilerplate, (SELECT count(*) FROM ann WHERE role = 'duplicate_child') AS duplicate_children, count(*) AS chunks, count(*) FILTER (chunk_kind = 'short_fact') AS short_facts,
count(*) FILTER (context_text <> body) AS context_expanded,
(SELECT count(*) FROM span WHERE k NOT IN (SELECT k FROM long) AND k NOT IN (SELECT k FROM piece)) + (SELECT count(*) FROM parts) - (SELECT count(*) FROM piece WHERE part > 0) AS tiny_suppressed, (SELECT '{{' || string_agg('"' || role || '":' || n, ',' ORDER BY role) || '}}' FROM (SELECT role, count(*) AS n FROM ann GROUP BY role)) AS role_counts FROM final"""
_ALL = (
    normalize_text, token_count, optional_strings, text_predicates, first_sentence, safe_urls, uuid5_ids, explode_passages, flatten_chunks, chunk_rejects, group_chunks, index_records, row_counts, max_rows_cap, max_passages_cap, point_payloads,
    embedding_texts, candidate_roles, duplicate_children, role_histogram, span_packing, sentence_packing, chunks, chunk_context, chunk_counters, continuity_pairs, continuity_summary, duplicate_text_groups, contiguous_groups,
    *map(_analyzer, ANALYZERS),
)
QUERIES = {f.__name__: f for f in _ALL}

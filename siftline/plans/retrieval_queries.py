"""Queries of sparse, dense and hybrid retrieval, reranking, deduplication, evidence and evaluation.

The stated query set is every raw row whose ordinal is divisible by 20: its question as text, and as vector that of the
row's first chunk with a usable one. Queries are asked against all chunks and all points. ``whole`` asks all raw rows instead:
``eval_contract_answer_overlap`` and ``grounded_heuristic`` do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.config import CONTRACTS, EngineConfig
from siftline.functions import text as T
from siftline.operators import dense, evaluate, fusion, generate, sparse
from siftline.plans import sql as S
from siftline.plans.shared import among, cut, small, stored
from siftline.sources.tables import table
from siftline.streaming import resume

CONFIG = EngineConfig()
EVERY, K, KS = 20, 10, (1, 5, 10, 20)
#: Words of evidence for an answer.
BUDGET = 120
FIELDS = ("group_id", "text", "context_text", "title", "chunk_kind", "passage_types", "source_row_ordinal", "start_candidate_idx", "end_candidate_idx")


def _chunks(spark, d):
    return table(spark, d, "index_chunks")


def _points(spark, d):
    return dense.once(table(spark, d, "dense_points")).where(F.exists("dense", lambda x: x != 0))


def _asked(spark, d, whole):
    """The chunks of the rows that are asked."""
    return _chunks(spark, d) if whole else _chunks(spark, d).where(F.col("source_row_ordinal") % EVERY == 0)


def _queries(spark, d, whole=False):
    asked = _asked(spark, d, whole).withColumn("q", T.optional(F.col("question"))).where("q IS NOT NULL")
    return asked.groupBy(F.col("source_row_ordinal").alias("query_id")).agg(F.min("q").alias("text"))


def _query_vectors(spark, d, whole=False):
    rows = _asked(spark, d, whole).select(F.col("source_row_ordinal").alias("query_id"), F.col("chunk_id").alias("point_id"))
    usable = _points(spark, d).where(dense.usable(F.col("dense"), 64))
    return rows.join(usable, "point_id").groupBy("query_id").agg(F.min_by("dense", "point_id").alias("dense"))


def _docs(spark, d):
    return _chunks(spark, d).select("chunk_id", "text")


def _index(spark, d):
    """The stored index of the chunks, built by the first query that asks it."""
    return stored(spark, f"chunks of {d}", lambda: sparse.build(_docs(spark, d), CONFIG, key="chunk_id"))


def _sparse(spark, d, k, whole=False):
    return sparse.search(_queries(spark, d, whole), _index(spark, d), k, CONFIG)


def _dense(spark, d, k, distance="Cosine"):
    return dense.topk(_query_vectors(spark, d), _points(spark, d), k, distance)


def _from_chunks(hits, spark, d, columns):
    """Stored hits with columns of their chunks, made where the chunks are; of the chunks that no query hits hardly any text moves."""
    hit = among(_chunks(spark, d).select(F.col("chunk_id").alias("point_id"), *FIELDS), "point_id", hits)
    return hit.select("point_id", *columns).join(small(hits), "point_id")


def _with_fields(hits, spark, d, columns=FIELDS):
    """The hits, stored first, with the fields of their chunks or with columns made of them."""
    return _from_chunks(cut(hits), spark, d, columns)


def _hashed(hits, spark, d):
    """The hits with what equal bodies have in common: their texts stay where the chunks are."""
    return _chunks(spark, d).select(F.col("chunk_id").alias("point_id"), fusion.body_hash()).join(small(cut(hits)), "point_id")


def _fused(spark, d):
    k = max(K, CONFIG.retrieve_k)
    return fusion.fuse(_dense(spark, d, k), _sparse(spark, d, k), CONFIG)


def corpus_stats(spark, d):
    return sparse.corpus_stats(sparse.tokenized(_docs(spark, d), key="chunk_id")).withColumn("avg_doc_len", F.round("avg_doc_len", 6))


def document_frequency(spark, d):
    return sparse.document_frequency(sparse.postings(sparse.tokenized(_docs(spark, d), key="chunk_id")))


def term_ids(spark, d):
    w = F.struct("source_row_ordinal", "start_candidate_idx", "end_candidate_idx", "chunk_id")
    docs = _chunks(spark, d).select("text", "source_row_ordinal", w.alias("o"))
    # document order: row, span, id. The ordinal is the row's; ties inside a row go by the first of its chunks
    return sparse.term_ids(docs.groupBy("source_row_ordinal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), " ").alias("text")), "source_row_ordinal")


def okapi_idf(spark, d):
    tokens = sparse.tokenized(_docs(spark, d), key="chunk_id")
    idf = sparse.okapi_idf(sparse.document_frequency(sparse.postings(tokens)), sparse.corpus_stats(tokens))
    return idf.withColumn("idf", F.round("idf", 6))


def bm25_doc_weights(spark, d):
    i = _index(spark, d)
    return sparse.weights(i.posted, i.idf, i.stats, CONFIG).select("doc_id", "term", "weight").withColumn("weight", F.round("weight", 6))


def query_terms(spark, d):
    return sparse.query_terms(_queries(spark, d))


def missing_terms(spark, d):
    """Terms of the chunks' index that the vocabulary of the stored shards lacks: stems that are no words of it."""
    posted = _index(spark, d).posted
    known = table(spark, d, "pass1_states").select(F.explode(F.map_keys("term_to_id")).alias("term")).distinct()
    return sparse.missing_terms(posted, known)


def bm25_topk(spark, d):
    return _sparse(spark, d, K).withColumn("score", F.round("score", 6))


def _dense_query(distance):
    def query(spark, d):
        return _dense(spark, d, K, distance).withColumn("score", F.round("score", 6))

    query.__name__ = f"dense_topk_{distance.lower()}"
    return query


def rrf_fusion(spark, d):
    return _fused(spark, d).select("query_id", "point_id", "dense_rank", "sparse_rank", "fusion_rank", F.round("fusion_score", 9).alias("fusion_score"))


def hybrid_topk(spark, d):
    final = min(K, CONFIG.rerank_k or K)
    hits = _hashed(_fused(spark, d), spark, d)
    return fusion.dedupe(hits, "fusion_rank", final).select("query_id", "point_id", "fusion_rank", "dedupe_rank", F.array_join("duplicate_aliases", "|").alias("aliases"))


def _single(mode):
    def query(spark, d):
        k = max(K, CONFIG.retrieve_k)
        hits = _sparse(spark, d, k) if mode == "sparse" else _dense(spark, d, k)
        return fusion.dedupe(_hashed(hits, spark, d), "rank", K).select("query_id", "point_id", "rank", "dedupe_rank", F.array_join("duplicate_aliases", "|").alias("aliases"))

    query.__name__ = f"{mode}_mode_topk"
    return query


def rerank_inputs(spark, d):
    hits = _with_fields(_sparse(spark, d, K), spark, d)
    return hits.select("query_id", "point_id", fusion.rerank_input(F.col("text"), F.col("context_text"), F.col("title"), 24).alias("input"))


def rerank_lexical(spark, d):
    asked = _queries(spark, d).withColumnRenamed("text", "query")
    hits = _with_fields(_fused(spark, d).select("query_id", "point_id", "fusion_rank").join(asked, "query_id"), spark, d)
    body = fusion.rerank_input(F.col("text"), F.col("context_text"), F.col("title"), CONFIG.rerank_context_token_budget)
    out = fusion.rerank(hits, F.round(fusion.lexical_score(F.col("query"), body), 9)).where(F.col("rerank_rank") <= K)
    return out.select("query_id", "point_id", "fusion_rank", "rerank_rank", "rerank_score")


def dedupe_metrics(spark, d):
    return fusion.dedupe_metrics(_hashed(_fused(spark, d), spark, d)).withColumn("dedupe_drop_rate", F.round("dedupe_drop_rate", 6))


def _evidence(spark, d, hits):
    return generate.evidence(_with_fields(hits, spark, d), BUDGET)


def _fitting(spark, d, k=K, whole=False):
    """The hits that fit the budget; for that their bodies are only counted, and no text moves."""
    hits = cut(_sparse(spark, d, k, whole).select("query_id", "point_id", "rank"))
    return generate.fitting(_from_chunks(hits, spark, d, (F.size(T.words(generate.body())).alias("words"),)), BUDGET)


def _quoted(fitting, spark, d, *fields):
    """Fitting hits with their bodies: of a text no more moves than the budget, once and not for each hit."""
    found = _with_fields(fitting, spark, d, (*fields, generate.shortened(generate.body(), F.lit(BUDGET)).alias("body")))
    return found.withColumn("body", generate.shortened(F.col("body"), F.col("room")))


def prompt_budget(spark, d):
    return _quoted(_fitting(spark, d), spark, d).select("query_id", "evidence_no", "point_id", "body")


def prompts(spark, d):
    p = generate.prompts(_queries(spark, d), _quoted(_fitting(spark, d), spark, d, "title", "chunk_kind", "passage_types"))
    return p.select("query_id", F.sha1("prompt").alias("prompt_sha1"), F.array_join("evidence_ids", "|").alias("evidence_ids"))


def grounded_heuristic(spark, d):
    # a hit has a term in its text, so its body is not blank: the first evidence is always the best hit, and the others are not needed
    return generate.heuristic(_quoted(_fitting(spark, d, 1, whole=True).where("evidence_no = 1"), spark, d))


def citation_filter(spark, d):
    """Replies that cite the query's five best points, twice the first, one object and one unknown id, against its evidence."""
    best = cut(_sparse(spark, d, K))  # the evidence and the five best come from one search
    hits = best.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "point_id"))).alias("h")).withColumn("c", F.transform("h", lambda x: x["point_id"]))
    found = _evidence(spark, d, best).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("evidence_no", "point_id"))).alias("e")).select("query_id", F.transform("e", lambda x: x["point_id"]).alias("evidence_ids"))
    quoted = F.array_join(F.transform(F.concat(F.slice("c", 1, 1), F.col("c"), F.array(F.lit("unknown"))), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ",")
    raw = F.concat(F.lit('Here it is: {"abstained": false, "answer": " yes ", "citations": ['), quoted, F.lit(', {"point_id": "'), F.get("c", F.lit(0)), F.lit('"}]}'))
    out = generate.checked_answers(hits.join(found, "query_id").select("query_id", raw.alias("raw"), "evidence_ids"), 2)
    return out.select("query_id", "answer", "abstained", F.array_join("citations", "|").alias("citations"))


def _labels(gold, queries):
    """Gold labels of the queries' questions."""
    return gold.join(queries.select("query_id", F.col("text").alias("query")), "query")


def eval_cases(spark, d):
    return evaluate.cases(evaluate.gold(_chunks(spark, d)))


def eval_labels(spark, d):
    return evaluate.gold(_chunks(spark, d)).select("query", "kind", "label")


def _all_hits(spark, d, queries, vectors):
    """The final hits of all modes: over-fetched, deduplicated, cut to the largest k."""
    top, k = max(KS), max(max(KS), CONFIG.retrieve_k)
    s, v = cut(sparse.search(queries, _index(spark, d), k, CONFIG)), cut(dense.topk(vectors, _points(spark, d), k))  # each is in two of the three
    named = {"sparse": (s, "rank"), "dense": (v, "rank"), "hybrid": (fusion.fuse(v, s, CONFIG), "fusion_rank")}
    every = None
    for mode, (hits, rank) in named.items():
        final = fusion.dedupe(_hashed(hits, spark, d), rank, top).select(F.lit(mode).alias("mode"), "query_id", F.col("dedupe_rank").alias("rank"), "point_id")
        every = final if every is None else every.unionByName(final)
    return _with_fields(every, spark, d)


def _metrics(spark, d, contract, whole=False):
    gold, queries, vectors = evaluate.gold(_chunks(spark, d)), _queries(spark, d, whole), _query_vectors(spark, d, whole)
    if whole:  # a query without a label is in no mean, so its hits are not looked for
        gold = cut(gold)
        queries = cut(queries.join(gold.select(F.col("query").alias("text")).distinct(), "text", "left_semi"))
        vectors = vectors.join(queries, "query_id", "left_semi")
    return evaluate.metrics(evaluate.metrics_per_query(_all_hits(spark, d, queries, vectors), _labels(gold, queries), contract, KS, ("dense", "sparse", "hybrid")))


def _rounded(df):
    return df.select("mode", "k", "query_count", *[F.round(m, 6).alias(m) for m in ("recall_at_k", "mrr_at_k", "ndcg_at_k")])


def _contract(name, whole=False):
    def query(spark, d):
        return _rounded(_metrics(spark, d, name, whole))

    query.__name__ = f"eval_contract_{name}"
    return query


def mode_winners(spark, d):
    return evaluate.winners(_metrics(spark, d, "answer_overlap")).withColumn("value", F.round("value", 6))


def resume_antijoin(spark, d):
    """Chunks that have no point yet."""
    return resume.missing(_chunks(spark, d).select("chunk_id"), table(spark, d, "dense_points").select("point_id"), "chunk_id", "point_id")


_Q = f"q AS (SELECT source_row_ordinal AS query_id, min({S.optional('question')}) AS text FROM index_chunks WHERE source_row_ordinal % {EVERY} = 0 AND {S.optional('question')} IS NOT NULL GROUP BY 1)"
#: The same of all rows.
_WHOLE_Q = f"q AS (SELECT source_row_ordinal AS query_id, min({S.optional('question')}) AS text FROM index_chunks WHERE {S.optional('question')} IS NOT NULL GROUP BY 1)"
_DOCS = f"""
d AS (SELECT chunk_id AS doc_id, coalesce({S.analyze('text')}, []) AS toks FROM index_chunks),
st AS (SELECT count(*) AS n, sum(len(toks)) AS total, sum(len(toks)) / count(*) AS avgdl FROM d),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
w AS (SELECT doc_id, term, idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) AS weight FROM post JOIN idf USING (term), st WHERE idf <> 0)"""
_QT = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({S.analyze('text')}) AS term FROM q) GROUP BY 1, 2)"
_SCORED = f"""{_DOCS}, {_QT},
sc AS (SELECT query_id, doc_id AS point_id, round(sum(qtf * weight), 9) AS score FROM qt JOIN w USING (term) GROUP BY 1, 2),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sc)"""
_SPARSE, _WHOLE_SPARSE = f"{_Q}, {_SCORED}", f"{_WHOLE_Q}, {_SCORED}"
_PT = """
pt AS (SELECT point_id, dense::DOUBLE[] AS v FROM (SELECT * FROM dense_points WHERE point_id IS NOT NULL AND dense IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY embedded_at DESC, dense DESC) = 1) WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x <> 0)) > 0)"""
_POINTS = f"""{_PT},
qv AS (SELECT source_row_ordinal AS query_id, arg_min(v, point_id) AS qv FROM index_chunks JOIN pt ON point_id = chunk_id WHERE source_row_ordinal % 20 = 0 GROUP BY 1)"""
_WHOLE_POINTS = f"""{_PT},
qv AS (SELECT source_row_ordinal AS query_id, arg_min(v, point_id) AS qv FROM index_chunks JOIN pt ON point_id = chunk_id GROUP BY 1)"""
_SCORE = {"cosine": "list_cosine_similarity(qv, v)", "dot": "list_dot_product(qv, v)", "euclid": "-list_distance(qv, v)", "manhattan": "-list_sum(list_transform(list_zip(qv, v), lambda z: abs(z[1] - z[2])))"}


def _dense_sql(kind, points=_POINTS):
    return f"{points}, dn AS (SELECT query_id, point_id, {_SCORE[kind]} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE[kind]} DESC, point_id) AS rank FROM qv, pt)"


_FUSION = """
fs AS (SELECT query_id, point_id, a.rank AS dense_rank, b.rank AS sparse_rank, coalesce(0.5 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS fusion_score FROM (SELECT * FROM dn WHERE rank <= 50) a FULL JOIN (SELECT * FROM sp WHERE rank <= 50) b USING (query_id, point_id)),
fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, point_id) AS fusion_rank FROM fs)"""
_FUSED = f"{_SPARSE}, {_dense_sql('cosine')},{_FUSION}"
_WHOLE_FUSED = f"{_WHOLE_SPARSE}, {_dense_sql('cosine', _WHOLE_POINTS)},{_FUSION}"
_KEY = f"coalesce(lower({S.normalize('title')}), '') || chr(31) || coalesce(lower({S.normalize(f'CASE WHEN {S.optional('context_text')} IS NOT NULL THEN context_text ELSE text END')}), '')"


def _dedupe_sql(source, rank, name="dd"):
    return f"""{name}k AS (SELECT h.*, {_KEY} AS key FROM {source} h JOIN (SELECT chunk_id, title, text, context_text FROM index_chunks) c ON c.chunk_id = h.point_id),
{name}g AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY {rank}, point_id) AS nth, string_agg(point_id, '|' ORDER BY {rank}, point_id) OVER (PARTITION BY query_id, key ORDER BY {rank}, point_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS aliases FROM {name}k),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rank}, point_id) AS dedupe_rank FROM {name}g WHERE nth = 1)"""


_BODY = f"coalesce({S.optional('context_text')}, text)"
_INPUT = "CASE WHEN {title} IS NOT NULL THEN 'Title: ' || {title} || chr(10) ELSE '' END || CASE WHEN len({words}) > {n} THEN array_to_string({words}[1:{n}], ' ') ELSE {body} END"
_FITTING = f"""
eb AS (SELECT query_id, rank, point_id, title, chunk_kind, passage_types, coalesce({S.optional('context_text')}, {S.strip('text')}) AS body FROM sp JOIN index_chunks ON chunk_id = point_id WHERE rank <= {K}),
en AS (SELECT *, len({S.words('body')}) AS n FROM eb), el AS (SELECT *, 120 - coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM en WHERE n > 0),
ev AS (SELECT query_id, point_id, title, chunk_kind, passage_types, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS evidence_no, CASE WHEN n > room THEN array_to_string({S.words('body')}[1:room::INT], ' ') ELSE body END AS body FROM el WHERE room > 0)"""
_EVIDENCE, _WHOLE_EVIDENCE = f"{_SPARSE},{_FITTING}", f"{_WHOLE_SPARSE},{_FITTING}"
_OVERLAP = f"lower(CASE WHEN {S.optional('context_text')} IS NOT NULL THEN text || chr(10) || context_text ELSE text END)"
_ANSWERS = f"list_filter(list_transform(coalesce(long_answers, []), lambda a: {S.strip('a')}), lambda a: a IS NOT NULL AND a <> '')"
_GOLD = f"""
gd AS (SELECT *, {S.optional('question')} AS query, {_ANSWERS} AS ans FROM index_chunks WHERE {S.optional('question')} IS NOT NULL AND len(list_filter({_ANSWERS}, lambda a: contains({_OVERLAP}, lower(a)))) > 0),
gl AS (SELECT DISTINCT * FROM (
  SELECT query, 'point' AS kind, chunk_id AS label, source_row_ordinal AS row, NULL::INT AS start, NULL::INT AS stop FROM gd
  UNION ALL SELECT query, 'group', group_id, source_row_ordinal, NULL, NULL FROM gd UNION ALL SELECT query, 'row', source_row_ordinal::VARCHAR, source_row_ordinal, NULL, NULL FROM gd
  UNION ALL SELECT query, 'span', source_row_ordinal || ':' || start_candidate_idx || ':' || end_candidate_idx, source_row_ordinal, start_candidate_idx, end_candidate_idx FROM gd
  UNION ALL SELECT query, 'answer', unnest(ans), NULL, NULL, NULL FROM gd) WHERE label IS NOT NULL)"""
_HITS = f"""{_dedupe_sql('(SELECT * FROM sp WHERE rank <= 50)', 'rank', 'ds')}, {_dedupe_sql('(SELECT * FROM dn WHERE rank <= 50)', 'rank', 'dv')}, {_dedupe_sql('fu', 'fusion_rank', 'dh')},
hit AS (SELECT mode, query_id, rank, point_id, group_id, source_row_ordinal, start_candidate_idx, end_candidate_idx, {_OVERLAP} AS body FROM (
  SELECT 'sparse' AS mode, query_id, dedupe_rank AS rank, point_id FROM ds UNION ALL SELECT 'dense', query_id, dedupe_rank, point_id FROM dv UNION ALL SELECT 'hybrid', query_id, dedupe_rank, point_id FROM dh)
  JOIN index_chunks ON chunk_id = point_id WHERE rank <= {max(KS)})"""
_MATCH = {
    "answer_overlap": ("contains(h.body, lower(l.label))", "l.label", "lower(l.label)"),
    "point_id": ("h.point_id = l.label", "l.label", "l.label"),
    "group_id": ("h.group_id = l.label", "l.label", "l.label"),
    "source_row_ordinal": ("h.source_row_ordinal::VARCHAR = l.label", "l.label", "l.label"),
    "candidate_span_overlap": ("h.source_row_ordinal = l.row AND h.start_candidate_idx <= l.stop AND h.end_candidate_idx >= l.start", "(l.row, l.start, l.stop)", "l.label"),
}


def _metrics_sql(contract, fused=_FUSED):
    on, order, name = _MATCH[contract]
    kind = evaluate.KIND[contract]
    return f"""WITH {fused}, {_HITS}, {_GOLD}, ql AS (SELECT q.query_id, gl.* FROM gl JOIN q ON q.text = gl.query),
cr AS (SELECT h.mode, h.query_id, h.rank, arg_min({name}, {order}) AS label FROM hit h JOIN ql l ON h.query_id = l.query_id AND l.kind = '{kind}' AND {on} GROUP BY 1, 2, 3),
fi AS (SELECT mode, query_id, label, min(rank) AS rank FROM cr GROUP BY 1, 2, 3),
re AS (SELECT query_id, count(DISTINCT CASE WHEN kind = '{kind}' THEN {'lower(label)' if contract == 'answer_overlap' else 'label'} END) AS relevant FROM ql GROUP BY 1),
pq AS (SELECT m.mode, re.query_id, k.k, relevant, count(*) FILTER (fi.rank <= k.k) AS n, min(fi.rank) FILTER (fi.rank <= k.k) AS best, coalesce(sum(1 / log2(fi.rank + 1)) FILTER (fi.rank <= k.k), 0) AS dcg
  FROM re CROSS JOIN (VALUES ('dense'), ('sparse'), ('hybrid')) m(mode) CROSS JOIN (VALUES {', '.join(f'({k})' for k in KS)}) k(k) LEFT JOIN fi ON fi.mode = m.mode AND fi.query_id = re.query_id GROUP BY 1, 2, 3, 4),
me AS (SELECT mode, k, count(*) AS query_count, avg(CASE WHEN relevant > 0 THEN n / relevant ELSE 0 END) AS recall_at_k, avg(coalesce(1 / best, 0)) AS mrr_at_k,
  avg(CASE WHEN relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END) AS ndcg_at_k FROM pq GROUP BY 1, 2)
"""


_MEANS = "SELECT mode, k, query_count, round(recall_at_k, 6) AS recall_at_k, round(mrr_at_k, 6) AS mrr_at_k, round(ndcg_at_k, 6) AS ndcg_at_k FROM me"
ORACLES = {
    "corpus_stats": f"WITH {_DOCS} SELECT n AS document_count, total::BIGINT AS total_tokens, round(avgdl, 6) AS avg_doc_len FROM st",
    "document_frequency": f"WITH {_DOCS} SELECT term, df FROM df",
    "term_ids": f"""WITH r AS (SELECT source_row_ordinal AS o, {S.analyze("string_agg(text, ' ' ORDER BY start_candidate_idx, end_candidate_idx, chunk_id)")} AS toks FROM index_chunks GROUP BY 1),
f AS (SELECT term, min((o, p)) AS f FROM (SELECT o, unnest(toks) AS term, unnest(range(len(toks))) AS p FROM r) GROUP BY 1) SELECT term, row_number() OVER (ORDER BY f) - 1 AS term_id FROM f""",
    "okapi_idf": f"WITH {_DOCS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_doc_weights": f"WITH {_DOCS} SELECT doc_id, term, round(weight, 6) AS weight FROM w WHERE weight <> 0",
    "query_terms": f"WITH {_Q}, {_QT} SELECT query_id, term, qtf FROM qt",
    "missing_terms": f"SELECT DISTINCT term FROM (SELECT unnest({S.analyze('text')}) AS term FROM index_chunks) WHERE term NOT IN (SELECT unnest(map_keys(term_to_id)) FROM pass1_states WHERE term_to_id IS NOT NULL)",
    "bm25_topk": f"WITH {_SPARSE} SELECT query_id, point_id, round(score, 6) AS score, rank FROM sp WHERE rank <= {K}",
    **{f"dense_topk_{k}": f"WITH {_dense_sql(k)} SELECT query_id, point_id, round(score, 6) AS score, rank FROM dn WHERE rank <= {K}" for k in _SCORE},
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, point_id, dense_rank, sparse_rank, fusion_rank, round(fusion_score, 9) AS fusion_score FROM fu",
    "hybrid_topk": f"WITH {_FUSED}, {_dedupe_sql('fu', 'fusion_rank')} SELECT query_id, point_id, fusion_rank, dedupe_rank, coalesce(aliases, '') AS aliases FROM dd WHERE dedupe_rank <= {K}",
    "sparse_mode_topk": f"WITH {_SPARSE}, {_dedupe_sql('(SELECT * FROM sp WHERE rank <= 50)', 'rank')} SELECT query_id, point_id, rank, dedupe_rank, coalesce(aliases, '') AS aliases FROM dd WHERE dedupe_rank <= {K}",
    "dense_mode_topk": f"WITH {_dense_sql('cosine')}, {_dedupe_sql('(SELECT * FROM dn WHERE rank <= 50)', 'rank')} SELECT query_id, point_id, rank, dedupe_rank, coalesce(aliases, '') AS aliases FROM dd WHERE dedupe_rank <= {K}",
    "rerank_inputs": f"WITH {_SPARSE} SELECT query_id, point_id, {_INPUT.format(title=S.optional('title'), words=S.words(_BODY), n=24, body=_BODY)} AS input FROM sp JOIN index_chunks ON chunk_id = point_id WHERE rank <= {K}",
    "rerank_lexical": f"""WITH {_FUSED}, h AS (SELECT fu.query_id, point_id, fusion_rank, q.text AS query, {_INPUT.format(title=S.optional('title'), words=S.words(f"coalesce({S.optional('context_text')}, c.text)"), n=384, body=f"coalesce({S.optional('context_text')}, c.text)")} AS input FROM fu JOIN q USING (query_id) JOIN index_chunks c ON chunk_id = point_id),
s AS (SELECT *, list_distinct({S.unicode_tokens('query')}) AS qt, list_distinct({S.unicode_tokens('input')}) AS it FROM h), z AS (SELECT *, CASE WHEN len(qt) > 0 THEN round(len(list_intersect(qt, it)) / len(qt), 9) ELSE 0 END AS rerank_score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_rank, point_id) AS rerank_rank FROM z) SELECT query_id, point_id, fusion_rank, rerank_rank, rerank_score FROM r WHERE rerank_rank <= {K}""",
    "dedupe_metrics": f"WITH {_FUSED}, {_dedupe_sql('fu', 'fusion_rank')} SELECT query_id, count(*) AS raw_count, count(DISTINCT key) AS unique_count, count(*) - count(DISTINCT key) AS dedupe_drop_count, round((count(*) - count(DISTINCT key)) / count(*), 6) AS dedupe_drop_rate FROM ddk GROUP BY 1",
    "prompt_budget": f"WITH {_EVIDENCE} SELECT query_id, evidence_no, point_id, body FROM ev",
    "prompts": f"""WITH {_EVIDENCE}, b AS (SELECT query_id, string_agg('Evidence [E' || evidence_no || '] point_id=' || point_id || chr(10) || 'Title: ' || coalesce(title, '') || chr(10) || 'Chunk kind: ' || coalesce(chunk_kind, '') || chr(10) || 'Passage types: ' || coalesce(array_to_string(list_filter(passage_types, lambda p: p IS NOT NULL), ', '), '') || chr(10) || 'Content: ' || body, chr(10) || chr(10) ORDER BY evidence_no) AS blocks, string_agg(point_id, '|' ORDER BY evidence_no) AS ids FROM ev GROUP BY 1)
SELECT query_id, sha1('{generate.CONTRACT.replace("'", "''").replace(chr(10), "' || chr(10) || '")}' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || coalesce(blocks, 'No evidence provided.')) AS prompt_sha1, coalesce(ids, '') AS evidence_ids FROM q LEFT JOIN b USING (query_id)""",
    "grounded_heuristic": rf"WITH {_WHOLE_EVIDENCE}, s AS (SELECT query_id, point_id, body, regexp_extract(body, '([^\n]+?[.!?])(?:{S.WS}|$)', 1) AS f FROM ev WHERE evidence_no = 1) SELECT query_id, {S.strip("CASE WHEN f <> '' THEN f ELSE body END")} AS answer, point_id, {S.strip("CASE WHEN f <> '' THEN f ELSE body END")} = '' AS abstained FROM s",
    "citation_filter": f"""WITH {_EVIDENCE}, c AS (SELECT query_id, point_id, rank FROM sp WHERE rank <= 5 AND (query_id, point_id) IN (SELECT query_id, point_id FROM ev)),
n AS (SELECT query_id, count(*) AS n, string_agg(point_id, '|' ORDER BY rank) AS ids FROM c GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(n, 0) >= 2 THEN 'yes' ELSE '' END AS answer, coalesce(n, 0) < 2 AS abstained, CASE WHEN n >= 2 THEN ids ELSE '' END AS citations FROM (SELECT DISTINCT query_id FROM ev) LEFT JOIN n USING (query_id)""",
    "resume_antijoin": "SELECT chunk_id FROM index_chunks WHERE chunk_id NOT IN (SELECT point_id FROM dense_points WHERE point_id IS NOT NULL)",
    "eval_cases": f"WITH {_GOLD} SELECT query, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}s" for k in evaluate.KIND.values())} FROM gl GROUP BY query",
    "eval_labels": f"WITH {_GOLD} SELECT query, kind, label FROM gl",
    **{f"eval_contract_{c}": _metrics_sql(c, _WHOLE_FUSED if c == "answer_overlap" else _FUSED) + _MEANS for c in CONTRACTS},
    "mode_winners": _metrics_sql("answer_overlap") + """, lo AS (SELECT mode, k, 'recall_at_k' AS metric, round(recall_at_k, 9) AS value FROM me UNION ALL SELECT mode, k, 'mrr_at_k', round(mrr_at_k, 9) FROM me UNION ALL SELECT mode, k, 'ndcg_at_k', round(ndcg_at_k, 9) FROM me)
SELECT metric, mode, k, round(value, 6) AS value FROM lo QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, k, mode) = 1""",
}
_ALL = (
    corpus_stats, document_frequency, term_ids, okapi_idf, bm25_doc_weights, query_terms, missing_terms, bm25_topk, *map(_dense_query, ("Cosine", "Dot", "Euclid", "Manhattan")), rrf_fusion, hybrid_topk, _single("sparse"), _single("dense"),
    rerank_inputs, rerank_lexical, dedupe_metrics, prompt_budget, prompts, grounded_heuristic, citation_filter, resume_antijoin, eval_cases, eval_labels, *[_contract(c, whole=c == "answer_overlap") for c in CONTRACTS], mode_winners,
)
QUERIES = {f.__name__: f for f in _ALL}

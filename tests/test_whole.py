"""Queries that ask every raw row and not only the stated query set."""

from __future__ import annotations

import sqlcheck

from siftline.plans import retrieval_queries


def test_evaluation_asks_every_row_with_gold(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    con = sqlcheck.connect(d)
    sqlcheck.same(spark, d, retrieval_queries.QUERIES["eval_contract_answer_overlap"], retrieval_queries.ORACLES["eval_contract_answer_overlap"], con)
    asked = {r.query_count for r in retrieval_queries.QUERIES["eval_contract_answer_overlap"](spark, d).collect()}
    labelled = {r.query for r in retrieval_queries.eval_cases(spark, d).collect()}
    rows = con.sql("SELECT source_row_ordinal, min(trim(question)) FROM index_chunks WHERE trim(question) <> '' GROUP BY 1").fetchall()
    assert asked == {sum(q in labelled for _, q in rows)} and sum(o % 20 != 0 for o, q in rows if q in labelled) > 100


def test_heuristic_answers_every_row_with_a_hit(spark, sf):
    con = sqlcheck.connect(sf)
    query = retrieval_queries.QUERIES["grounded_heuristic"]
    sqlcheck.same(spark, sf, query, retrieval_queries.ORACLES["grounded_heuristic"], con)
    asked = {r[0] for r in con.sql("SELECT DISTINCT source_row_ordinal FROM index_chunks WHERE trim(question) <> ''").fetchall()}
    answered = {r.query_id for r in query(spark, sf).collect()}
    assert answered <= asked and len([o for o in answered if o % 20]) > 0.9 * len([o for o in asked if o % 20]) > 0


def test_first_evidence_is_the_best_hit_whatever_is_blank(spark, tmp_path, monkeypatch):
    blank = [None, "", " ", "\t\n", "\x1c\x1f", "  ", "　\x1d ", "​", " The context. More. "]
    rows = [(f"c{i:02}", f"{b or ''}tower {'bridge ' * (i % 3)}{i}. Next.{b or ''}", c, i % 7, "where is the tower bridge?" if i % 4 else " ") for i, (b, c) in enumerate((b, c) for b in blank for c in blank)]
    rows += [(f"d{i}", t, "A context without the words.", 30 + i, "tower?") for i, t in enumerate([" ", "", "the of", "éè ü"])]
    schema = "chunk_id string, text string, context_text string, source_row_ordinal bigint, question string"
    full = spark.createDataFrame(rows, schema).selectExpr("*", "chunk_id AS group_id", "CAST(NULL AS string) AS title", "CAST(NULL AS string) AS chunk_kind", "CAST(NULL AS array<string>) AS passage_types", "0 AS start_candidate_idx", "0 AS end_candidate_idx")
    full.coalesce(1).write.parquet(f"{tmp_path}/all")
    import glob
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(glob.glob(f"{tmp_path}/all/part-*.parquet")[0], tmp_path / "in" / "index_chunks.parquet")
    real, asked = retrieval_queries._sparse, []
    monkeypatch.setattr(retrieval_queries, "_sparse", lambda s, d, k, whole: asked.append(k) or real(s, d, k, whole))
    d = f"{tmp_path}/in"
    sqlcheck.same(spark, d, retrieval_queries.grounded_heuristic, retrieval_queries.ORACLES["grounded_heuristic"], sqlcheck.connect(d))
    assert asked == [1]

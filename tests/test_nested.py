from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import nested
from siftline.sources.tables import table

GROUP = (
    "group_id string, texts array<struct<text_idx:int,text:string,raw_idx:int,passage_type:string>>, chunks array<struct<chunk_id:string,text_idxs:array<int>,context_idxs:array<int>,start_candidate_idx:int,"
    "end_candidate_idx:int,passage_types:array<string>,parent_candidate_idx:int,chunk_kind:string,token_count:int,context_token_count:int>>, written_at int"
)


def chunk(name, texts, context, parent=None):
    return (name, texts, context, 0, 0, ["p", None], parent, "k", 1, 1)


def groups(spark):
    return spark.createDataFrame(
        [
            ("g1", [(0, "a", 0, None), (2, "b", 1, "p"), (2, "b", 1, "p"), None], [chunk("c0", [0, 1, 1, None], None), None, chunk("c2", [], [7], 3)], 1),
            ("g1", [(0, "a", 0, None), (2, "b", 1, "p"), (2, "b", 1, "p"), None], [chunk("c0", [0, 1, 1, None], None), None, chunk("c2", [], [7], 3)], 2),
            ("g2", None, [chunk("c0", [0], [0])], 1),
            ("g3", [(5, "x", None, None)], None, 1),
            ("g4", [], [], 1),
            (None, [(5, "x", None, None)], None, 1),
        ],
        GROUP,
    )


def test_states_of_values(spark):
    df = spark.createDataFrame([(["a", " "], (1, None)), ([], (None, "x")), (None, None)], "l array<string>, s struct<a:int,b:string>")
    got = [tuple(r) for r in df.select(nested.state(F.col("l"), df.schema["l"].dataType), nested.state(F.col("s"), df.schema["s"].dataType)).collect()]
    assert got == [("[b|v]", "{a:v,b:n}"), ("e", "{a:n,b:v}"), ("n", "n")]
    assert {r.variant: r.records for r in nested.variant_counts(df, ["l"]).collect()} == {"l=[b|v]": 1, "l=e": 1, "l=n": 1}


def test_group_orphans(spark):
    got = {tuple(r) for r in nested.group_orphans(groups(spark)).collect()}
    assert got == {("g1", "text_ref", 0, 1), ("g1", "context_ref", 2, 7), ("g1", "text", -1, 2), ("g2", "text_ref", 0, 0), ("g2", "context_ref", 0, 0), ("g3", "text", -1, 5)}
    assert nested.group_orphans(groups(spark)).count() == len(got)


def test_row_orphans(spark, raw):
    df = raw(
        {"candidates": ["a", "b", " ", "c"], "passage_types": ["t", " ", "t"]}, {"candidates": None, "passage_types": ["t", None]}, {"candidates": ["a"], "passage_types": None}, {"candidates": [None], "passage_types": ["t", "u"]},
        {"candidates": None, "passage_types": None}, {"candidates": [], "passage_types": []}, {"candidates": [" x"], "passage_types": ["\t"]},
    )
    got = sorted(tuple(r)[:3] for r in nested.row_orphans(df).collect())
    assert got == [("r0", "candidate", 1), ("r0", "candidate", 3), ("r1", "type", 0), ("r2", "candidate", 0), ("r3", "type", 1), ("r6", "candidate", 0)]
    assert nested.row_orphans(df.where("false")).count() == 0


def test_subtypes_hold_every_chunk_once(spark, sf):
    parts = nested.chunk_subtypes(groups(spark))
    assert {k: sorted((r.parent_id, r.pos) for r in v.collect()) for k, v in parts.items()} == {"plain": [("g1", 0)], "contextual": [("g2", 0)], "child": [("g1", 2)]}
    assert "parent_candidate_idx" in parts["child"].columns and "parent_candidate_idx" not in parts["plain"].columns
    real = table(spark, sf, "index_chunk_groups")
    whole = nested.child_table(nested.once(real, "group_id", "written_at"), "group_id", "chunks").where("variant <> 'n'").count()
    assert sum(v.count() for v in nested.chunk_subtypes(real).values()) == whole


def test_child_names_that_clash(spark):
    df = spark.createDataFrame([("k", [(1, "a")], 9)], "key string, xs array<struct<pos:int,parent_id:string>>, pos int")
    assert nested.child_table(df, "key", "xs").columns == ["parent_id", "pos", "xs_pos", "xs_parent_id", "variant"]


def test_hot_key_is_combined_before_the_shuffle(spark):
    plan = nested.once(groups(spark), "group_id", "written_at")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_chunk_rows_keep_every_stored_value(spark, tmp_path):
    from siftline.plans import nested_queries as Q

    groups(spark).write.parquet(f"{tmp_path}/index_chunk_groups.parquet")
    got = {(r.parent_id, r.pos): (r.subtype, r.context_token_count, r.passage_types) for r in Q.p2_chunk_rows(spark, str(tmp_path)).collect()}
    assert got == {("g1", 0): ("plain", 1, ["p", None]), ("g1", 1): ("null", None, None), ("g1", 2): ("child", 1, ["p", None]), ("g2", 0): ("contextual", 1, ["p", None])}
    assert "context_token_count" in nested.chunk_subtypes(groups(spark))["plain"].columns

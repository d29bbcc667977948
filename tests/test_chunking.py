from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from siftline.config import EngineConfig
from siftline.operators import chunking, ingest
from siftline.plans import chunk_sql
from siftline.sources.tables import table

WORDS = "tower was built stone the river including parts has gate: old. such as mill and small! carts? of wood is long 1900 Übung".split()
KINDS = ["paragraph", "list", "table", "header", "section", "list_definition", "", None, " list "]


def rows_at_random(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        cands = []
        for _ in range(r.randint(0, 14)):
            kind = r.random()
            if kind < 0.1:
                cands.append(r.choice(["", " \n", None, "See also", "V T E", "vte", "ab", "Notes"]))
            elif kind < 0.25 and any(c and len(c) > 20 for c in cands):
                whole = r.choice([c for c in cands if c and len(c) > 20]).split()
                cands.append(" ".join(whole[: r.randint(1, len(whole))]))
            else:
                cands.append(" ".join(r.choice(WORDS) for _ in range(r.choice([3, 8, 15, 30, 60, 120, 400]))) + r.choice(["", ".", ":", " "]))
        kinds = r.choice([None, [r.choice(KINDS) for _ in range(r.randint(0, 16))]])
        out.append({"candidates": r.choice([cands, cands, cands, None]) if r.random() < 0.2 else cands, "passage_types": kinds, "title": " T ", "question": "", "long_answers": [None, "x"]})
    return out


@pytest.mark.parametrize("seed, config", [(1, {}), (2, {"soft_tokens": 30, "hard_tokens": 5, "max_tokens": 80}), (3, {"soft_tokens": 25, "hard_tokens": 20, "context_token_cap": 50}), (4, {"target_tokens": 40, "max_tokens": 60})])
def test_same_as_sql_on_random_rows(spark, raw, seed, config):
    df, c = raw(*rows_at_random(seed)), EngineConfig(**config)
    con = duckdb.connect()
    con.register("nq_sample_rows", df.toArrow())
    want = con.sql(f"WITH RECURSIVE {chunk_sql.chunks(c)} SELECT row_ordinal, first_idx, last_idx, span, part, chunk_kind, body, context_text, chunk_id FROM final ORDER BY row_ordinal, span, part").fetchall()
    got = chunking.chunk(df, c).orderBy("source_row_ordinal", "span", "part").collect()
    assert len(got) > 20
    assert [(r.source_row_ordinal, r.start_candidate_idx, r.end_candidate_idx, r.span, r.part, r.chunk_kind, r.text, r.context_text, r.chunk_id) for r in got] == want
    assert all(r.title == "T" and r.question is None and r.long_answers == ["x"] for r in got)


def test_tiny_chunks_join_the_one_before(spark, raw):
    """Where the soft limit is under the hard one, a chunk under the hard limit is added to the chunk before it, or dropped at the row's start."""
    fact = lambda n, w: " ".join(f"{w}{i}" for i in range(n)) + " was so."
    tiny, large = [fact(8, w) for w in "abc"], fact(26, "l")
    rows = raw({"candidates": [tiny[0], large, tiny[1], tiny[2]], "passage_types": ["a", "b", "c", "d"]}, {"candidates": [tiny[0]]})
    got = chunking.chunk(rows, EngineConfig(soft_tokens=5, hard_tokens=20, max_tokens=31)).collect()
    assert [(r.source_row_ordinal, r.start_candidate_idx, r.end_candidate_idx, r.text) for r in got] == [(0, 1, 3, f"{large} {tiny[1]} {tiny[2]}")]


def test_roles_and_contained_children(spark, raw):
    rows = raw({"candidates": ["See also", "Alpha was a small town in the northern hills.", "small town in the"], "passage_types": ["header", "paragraph", "paragraph"]})
    got = [(r.role, r.parent_candidate_idx) for r in chunking.candidates_of(chunking.annotate(rows)).orderBy("candidate_idx").collect()]
    assert got == [("boilerplate", None), ("short_fact_candidate", None), ("duplicate_child", 1)]


def test_equal_candidates_drop_each_other(spark, raw):
    same = "one two three four five six seven eight nine"
    assert chunking.chunk(raw({"candidates": [same, same]})).count() == 0


def test_no_shuffle_from_rows_to_chunks(spark, raw):
    plan = chunking.chunk(raw({"candidates": ["a b c"]}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_empty_and_null_rows(spark, raw):
    df = raw({"candidates": None}, {"candidates": []}, {"candidates": [None, " "]})
    assert chunking.chunk(df).count() == 0
    assert chunking.chunk(df.where("false")).count() == 0
    assert ingest.explode_passages(df).count() == 0


def test_counters(spark, raw):
    c = chunking.counters(raw({"candidates": ["See also", "A b c d e f g h i j k l m n o p q r s t u v."]})).first()
    assert (c.rows, c.candidates, c.boilerplate, c.chunks) == (1, 2, 1, 1)
    assert c.role_counts == {"boilerplate": 1, "paragraph": 1} and c.tiny_suppressed == 0
    few = chunking.counters(raw({"candidates": ["only three words"]}, {"candidates": [" ".join(f"w{i}" for i in range(299)) + ". a b c"]}), EngineConfig(max_tokens=299)).first()
    assert (few.chunks, few.tiny_suppressed) == (1, 2)


def test_group_and_flatten_round_trip(spark, raw):
    rows = raw(*rows_at_random(9))
    chunks = chunking.chunk(rows).dropDuplicates(["chunk_id"])
    groups = ingest.group_chunks(chunks, rows)
    flat = ingest.flatten_groups(groups).select("chunk_id", "text", "context_text")
    assert {tuple(r) for r in flat.collect()} == {tuple(r) for r in chunks.select("chunk_id", "text", "context_text").collect()}
    pool = groups.select(F.explode("texts").alias("t")).where("t.raw_idx IS NULL").count()
    assert pool < chunks.count()

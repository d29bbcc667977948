from __future__ import annotations

import random
import re
import string
import unicodedata
from collections import defaultdict

from siftline.llm import copies

ROWS = "id string, candidates array<string>, kind_of int, digest string"
CHUNKS = "chunk_id string, text string, chunk_kind string"


def stripped(t):
    return "".join(c for c in t.casefold() if not (unicodedata.category(c)[0] == "P" or c.isspace() or c in string.punctuation))


def key(t, fields):
    pieces = [p for p in re.split(r"[;|\n\r]", t) if p.strip()]
    if fields and len(pieces) > 1 and all(re.search(r"[^\W_]", p.partition(":")[0]) and re.search(r"[^\W_]", p.partition(":")[2]) for p in pieces):
        return "".join(sorted(map(stripped, pieces)))
    return stripped(t)


def brute(rows, chunks):
    sets = defaultdict(list)
    for name, cands, *_ in rows:
        if cands is not None:
            sets["row", tuple(sorted(key(c, True) for c in cands if c and c.strip()))].append(name)
    for name, text, kind in chunks:
        if text is not None:
            sets["chunk", key(text, kind == "table_span")].append(name)
    return {(k[0], min(v), x) for k, v in sets.items() for x in v if x != min(v)}


def noisy(r, t):
    t = r.choice([str.upper, str.lower, str.title, str])(t)
    return "".join(c + r.choice(["", "", "", " ", "\n", ",", "  "]) for c in t) if r.random() < 0.5 else f' "{t}" '


def run(spark, rows, chunks):
    return copies.find(spark.createDataFrame(rows, ROWS), spark.createDataFrame(chunks, CHUNKS))


def test_against_brute_force(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("alpha beta gamma straße élan 12 34 müde".split()) for _ in range(r.randint(1, 6))) for _ in range(25)]
    rows, chunks = [], []
    for i in range(150):
        cands = r.sample(base, r.randint(0, 3)) + r.choice([[], [None, " "], ["a: 1; b: 2"]])
        cands = [noisy(r, c) if c and ":" not in c else c for c in cands]
        r.shuffle(cands)
        rows.append((f"r{i:03}", r.choice([cands] * 9 + [None]), i, "x"))
        t = r.choice(base)
        chunks.append((f"c{i:03}", r.choice([noisy(r, t), t, None, "", "a: 1 | b: 2", "B: 2\nA: 1", "a 1 b 2"]), r.choice(["table_span", "chunk"])))
    got = [tuple(x) for x in run(spark, rows, chunks).select("kind", "keep_id", "copy_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, chunks)


def test_what_makes_no_copy(spark):
    chunks = [("a", "elan", "chunk"), ("b", "élan", "chunk"), ("c", "el​an", "chunk"), ("d", "ｅlan", "chunk"), ("e", "a: 1; b: 2", "chunk"), ("f", "b: 2; a: 1", "chunk"), ("g", "b: 2; a: 1", "table_span"), ("h", "a: 1|b: 2", "table_span")]
    got = {tuple(x) for x in run(spark, [], chunks).collect()}
    assert got == {("chunk", "e", "g"), ("chunk", "e", "h"), ("chunk", "g", "h")} or got == brute([], chunks)


def test_hot_set_and_very_long_text(spark):
    long = "word " * 100_000
    chunks = [(f"c{i:04}", "Hot   text" if i % 3 == 0 else f"t{i}", None) for i in range(900)] + [("x1", long, None), ("x2", long.upper(), None)]
    got = {tuple(x) for x in run(spark, [], chunks).collect()}
    assert got == brute([], chunks) and len(got) == 300


def test_collapse_counts_copies(spark):
    rows = [("a", ["x"], 1, None), ("b", ["X!"], 1, None), ("c", ["y"], 1, None), ("d", None, 1, None)]
    got = {tuple(x) for x in copies.collapse(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], CHUNKS)).collect()}
    assert got == {("row", "a", 2), ("row", "c", 1)}


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0

from __future__ import annotations

import pytest

from siftline.llm import encode, mixture

TARGETS = "source string, target_share double, max_repeats int"


def documents(spark, sizes):
    rows = [(i, "word" * n, s) for i, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_shares_and_caps(spark):
    sizes = [("big", 3)] * 3000 + [("mid", 5)] * 300 + [("small", 7)] * 40 + [(None, 3)] * 20 + [("other", 3)] * 20
    docs = documents(spark, sizes)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 3), ("zero", 0.0, 1), ("null", None, None)], TARGETS)
    got = {r.source: r for r in mixture.shares(docs, targets).collect()}
    assert set(got) == {"big", "mid", "small", "gone"} and got["gone"].tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    for s, share in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert got[s].actual_share == pytest.approx(share, abs=0.01)
    assert got["big"].repeats <= 1 and got["mid"].repeats <= 2 and got["small"].repeats <= 4
    mixed = mixture.mix(docs, targets)
    per = {(r.source, r.doc_id): r["count"] for r in mixed.groupBy("source", "doc_id").count().collect()}
    assert {s for s, _ in per} == {"big", "mid", "small"}
    sums = {s: sum(n for (x, _), n in per.items() if x == s) for s in ("big", "mid", "small")}
    # every document of a source has the same size, so its tokens are copies times that size
    size = {r.source: r.tokens for r in encode.count_tokens(docs.where("doc_id in (0, 3000, 3300)"), ["source"]).collect()}
    assert {s: n * size[s] for s, n in sums.items()} == {s: got[s].tokens for s in sums}
    # the mixture is as large as the source that runs out first allows, and each source within one document of its share
    have = {"big": 3000 * size["big"], "mid": 300 * size["mid"] * 2, "small": 40 * size["small"] * 4}
    whole = min(have[s] / w for s, w in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)))
    for s, w in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(got[s].tokens - w * whole) <= size[s]
    for s, cap in (("big", 1), ("mid", 2), ("small", 4)):
        assert max(n for (x, _), n in per.items() if x == s) <= cap
        assert max(n for (x, _), n in per.items() if x == s) - min(n for (x, _), n in per.items() if x == s) <= 1


def test_thresholds_are_nested(spark):
    docs = documents(spark, [("a", 3)] * 400 + [("b", 3)] * 400)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    take = lambda total: {r.doc_id for r in mixture.mix(docs, targets, total).select("doc_id").collect()}
    small, large = take(200.0), take(400.0)
    assert small and small < large


def test_empty_inputs(spark):
    docs, targets = documents(spark, []), spark.createDataFrame([], TARGETS)
    some = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixture.mix(docs, targets).count() == 0 and mixture.mix(docs, some).count() == 0
    assert mixture.shares(documents(spark, [("a", 0), ("a", 0)]), some).first().tokens == 0


def test_documents_of_all_sizes_come_within_one_of_the_share(spark):
    """Against the sizes added up in Python: a source with a third of all rows, sizes from none to many tokens."""
    import random

    r = random.Random(4)
    sizes = [("hot" if i % 3 == 0 else f"s{i % 5}", r.choice([0, 1, 2, 5, 40])) for i in range(1500)]
    docs = documents(spark, sizes)
    targets = spark.createDataFrame([("hot", 0.2, 1), ("s0", 0.3, 3), ("s1", 0.1, 2), ("s2", 0.25, 5), ("s3", 0.15, 1)], TARGETS)
    tokens = {r.doc_id: r.tokens for r in encode.count_tokens(docs, ["doc_id"]).collect()}
    own = {s: [tokens[i] for i, (x, _) in enumerate(sizes) if x == s] for s in ("hot", "s0", "s1", "s2", "s3")}
    caps = {"hot": (0.2, 1), "s0": (0.3, 3), "s1": (0.1, 2), "s2": (0.25, 5), "s3": (0.15, 1)}
    whole = min(sum(own[s]) * n / w for s, (w, n) in caps.items())
    rows = mixture.mix(docs, targets).select("doc_id", "source", "copy_no").collect()
    for s, (w, n) in caps.items():
        taken = [x for x in rows if x.source == s]
        assert abs(sum(tokens[x.doc_id] for x in taken) - w * whole) <= max(own[s]) and max(x.copy_no for x in taken) <= n
        assert len({(x.doc_id, x.copy_no) for x in taken}) == len(taken)
    assert {x.source for x in rows} == set(caps)

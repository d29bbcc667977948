from __future__ import annotations

import random
from collections import Counter

from siftline.llm import termfreq

STATES = "shard_id bigint, document_count bigint, total_tokens bigint, term_to_id map<string,bigint>, nd map<string,bigint>, term_count map<string,bigint>, written_at int"


def states(spark, rows):
    return spark.createDataFrame(rows, STATES).repartition(3)


def shard(r, i, words, at=1):
    own = r.sample(words, min(len(words), 40)) + ["hot"]
    nd = {w: r.randint(1, 9) for w in own}
    return (i, 100, 1000, {w: k for k, w in enumerate(own)}, nd, {w: n + 1 for w, n in nd.items()}, at)


def brute(rows):
    best = {}
    for s in rows:
        if (s[3] is not None or s[4] is not None) and (s[0] not in best or s[6] > best[s[0]][6]):
            best[s[0]] = s
    chunks, occ, docs = Counter(), Counter(), sum(s[1] or 0 for s in best.values())
    for s in best.values():
        for m, c in ((s[4], chunks), (s[5], occ)):
            for t, n in (m or {}).items():
                c[t] += n or 0
        for t in s[3] or {}:
            chunks[t] += 0
    names = set(chunks) | set(occ)
    return {(t, chunks[t], occ[t], "rare" if chunks[t] < 3 else "common" if chunks[t] > 0.2 * docs else "useful") for t in names}


def cases():
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)] + ["ünï", "日本", ""]
    rows = [shard(r, i, words) for i in range(30)]
    rows += [(3, 0, 0, None, None, None, 9), (*rows[5][:6], 4), (31, 5, 5, {"only-id": 1}, None, None, 1), (32, 5, 5, None, {"x": None, "y": 1}, {}, 1), (33, None, None, {}, {}, {}, 1)]
    return rows


def test_against_plain_python(spark):
    got = [tuple(x) for x in termfreq.bands(states(spark, cases())).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(cases())
    assert {tuple(x) for x in termfreq.find(states(spark, cases())).collect()} == {(t, b) for t, _, _, b in brute(cases()) if b != "useful"}


def test_oversized_partitions_are_split_again(spark, tmp_path):
    got = {tuple(x) for x in termfreq.bands(states(spark, cases()), leaf_bytes=700).collect()}
    assert got == brute(cases())
    df = states(spark, cases())
    rows = termfreq.entries(df, termfreq.shards(df)).where("term IS NOT NULL")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("split", "split")
    deep = termfreq.leaves(rows, f"file://{tmp_path}/radix", leaf_bytes=700)
    jobs = len(tracker.getJobIdsForGroup("split"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    levels = {int(f.split("level=")[1].split("/")[0]) for f, _ in deep}
    assert len(deep) > 32 and max(levels) >= 2
    assert jobs <= 6 * (max(levels) + 1)  # a number of jobs for each level, not for each partition


def test_shards_sent_again_at_one_time_count_once(spark):
    rows = [(1, 10, 10, {"a": 1}, {"a": 4}, {"a": 5}, 3)] * 5 + [(1, 10, 10, {"a": 1}, {"a": 9}, {"a": 9}, 2), (None, 3, 3, {"b": 1}, {"b": 1}, None, None)]
    assert {tuple(x) for x in termfreq.bands(states(spark, rows)).collect()} == {("a", 4, 5, "common"), ("b", 1, 0, "rare")}


def test_leaves_are_put_together():
    got = termfreq.together([("a", 5), ("b", 5), ("c", 50), ("d", 1)], 12, 1)
    assert got == [["a", "b"], ["c"], ["d"]] and termfreq.together([("a", 1), ("b", 1)], 100, 8) == [["a"], ["b"]]


def test_work_folders_are_removed(spark):
    import glob
    import os

    from siftline.plans.shared import shared_dir

    termfreq.bands(states(spark, cases())).count()
    assert not glob.glob(os.path.join(shared_dir(spark).removeprefix("file://"), "siftline-radix-*"))


def test_empty_tables(spark):
    assert termfreq.bands(states(spark, [])).count() == 0
    assert termfreq.bands(states(spark, [(1, 0, 0, None, None, None, 1)])).count() == 0

from __future__ import annotations

import numpy as np

from siftline.llm import neighbours as N

POINTS = "point_id string, dense array<float>, model string, embedded_at int"


def frame(spark, rows):
    return spark.createDataFrame([(p, None if v is None else [float(x) for x in v], "m", t) for p, v, t in rows], POINTS).repartition(4)


def brute(points, k=5, least=0.85):
    names = sorted(points)
    x = np.array([points[n] for n in names], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    pairs = set()
    for i, name in enumerate(names):
        for j in np.argsort(-np.round(s[i], 9), kind="stable")[:k]:  # the names are in order
            if s[i, j] >= least:
                pairs.add(tuple(sorted((name, names[j]))))
    return pairs


def clustered(n=2500, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, 64))
    x = centres[rng.integers(0, len(centres), n)] + rng.uniform(0.1, 0.4, (n, 1)) * rng.standard_normal((n, 64))
    return x * rng.uniform(0.5, 2, (n, 1))


def test_recall_and_precision_against_brute_force(spark):
    x = clustered()
    points = {f"p{i:05}": v for i, v in enumerate(x)}
    got = {tuple(r) for r in N.pairs(frame(spark, [(p, v, 1) for p, v in points.items()])).collect()}
    want = brute(points)
    assert len(want) > 2000
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_hard_spread_reaches_the_recall_asked_for(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 64))
    x = np.vstack([base + s * rng.standard_normal(base.shape) for s in (0, 0.3, 0.35, 0.4, 0.45)])
    points = {f"p{i:05}": v for i, v in enumerate(x)}
    got = {tuple(r) for r in N.pairs(frame(spark, [(p, v, 1) for p, v in points.items()])).collect()}
    want = brute(points)
    assert len(got & want) / len(want) >= 0.9


def indexed(spark, x):
    points = frame(spark, [(f"p{i:05}", v, 1) for i, v in enumerate(x)])
    members = N.usable(points)
    return N.classes(points, members), members.count()


def test_every_vector_is_indexed(spark):
    v, n = indexed(spark, clustered(700))
    posted = N.postings(v, *N.fit(v, n)).where("use % 2 = 1")
    assert n == 700 and posted.select("key").distinct().count() == 700


def test_a_hot_region_of_unequal_vectors_is_cut_into_parts(spark, monkeypatch):
    """Half of all vectors are near one point; the sample holds a few, so their lists outgrow the limit and are cut, losing nothing."""
    monkeypatch.setattr(N, "SAMPLE", 400)
    monkeypatch.setattr(N, "PART_ROWS", 40)
    rng = np.random.default_rng(8)
    x = np.vstack([clustered(600, 3), rng.standard_normal(64) + 0.3 * rng.standard_normal((500, 64))])
    v, n = indexed(spark, x)
    graph, parts = N.fit(v, n, 400)
    posted = N.postings(v, graph, parts).toPandas()
    sizes = posted[posted.use % 2 == 1].groupby(["list", "part"]).size()
    assert parts.max() > 3 and sizes.max() < 4 * 40
    points = {f"p{i:05}": v for i, v in enumerate(x)}
    got = {tuple(r) for r in N.pairs(frame(spark, [(p, v, 1) for p, v in points.items()])).collect()}
    want = brute(points)
    assert len(got & want) / len(want) > 0.9


def test_exact_mode_is_brute_force(spark):
    points = {f"p{i:05}": v for i, v in enumerate(np.random.default_rng(6).standard_normal((600, 64)))}
    got = {tuple(r) for r in N.neighbours(frame(spark, [(p, v, 1) for p, v in points.items()]), least=-1.0, exact=True).select(N.F.least("point_id", "other_id"), N.F.greatest("point_id", "other_id")).collect()}
    want = brute(points, least=-1)
    assert len(got ^ want) <= 4  # nearly equal similarities may change places by a millionth


def test_unusable_and_resent_points(spark):
    one = np.eye(64)[0]
    rows = [("a", one, 1), ("a", one, 2), ("b", one * 3 + 0.01, 1), ("n", None, 1), ("e", [], 1), ("z", np.zeros(64), 1), ("s", one[:10], 1), ("nan", [float("nan")] * 64, 1), (None, one, 1)]
    assert {tuple(r) for r in N.pairs(frame(spark, rows)).collect()} == {("a", "b")}
    assert N.pairs(frame(spark, [])).count() == 0
    assert N.pairs(frame(spark, [("a", one, 1)])).count() == 0


def test_equal_vectors_are_indexed_once_but_all_come_back(spark):
    rng = np.random.default_rng(4)
    hot = rng.standard_normal(64)
    points = {f"h{i:03}": hot for i in range(120)}
    points |= {f"x{i:03}": v for i, v in enumerate(rng.standard_normal((240, 64)))}
    points |= {"near1": hot + 0.05, "near2": hot - 0.05, "twin1": points["x000"], "twin2": points["x000"] * 1.0}
    got = {tuple(r) for r in N.pairs(frame(spark, [(p, v, 1) for p, v in points.items()])).collect()}
    assert got == brute(points)


def test_graph_search_finds_the_nearest_centroid():
    rng = np.random.default_rng(1)
    c = rng.standard_normal((3000, 64)).astype(np.float32)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = c[::3] + 0.05 * rng.standard_normal((1000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = N.CentroidGraph(c)
    assert (g.search(x, 1)[0][:, 0] == (x @ c.T).argmax(1)).mean() > 0.95


def test_parts_are_nearly_even():
    x = clustered(4000).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = N.split_evenly(x, 32, np.random.default_rng(0))
    sizes = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    assert len(c) >= 28 and sizes.max() < 5 * sizes.mean()


def test_query_gives_every_point_all_k_neighbours(spark, tmp_path):
    from siftline.llm import queries

    rng = np.random.default_rng(9)
    x = np.vstack([clustered(1000), rng.standard_normal((200, 64))])  # the last are near nothing
    names = np.array([f"p{i:05}" for i in range(len(x))])
    frame(spark, [(p, v, 1) for p, v in zip(names.tolist(), x)]).write.parquet(f"{tmp_path}/dense_points.parquet")
    spark.createDataFrame([(p, "g", "t") for p in names.tolist()], "chunk_id string, group_id string, text string").write.parquet(f"{tmp_path}/index_chunks.parquet")
    rows = queries.p3_neighbours(spark, str(tmp_path)).toPandas()
    assert (rows.groupby("point_id").size().reindex(names, fill_value=0) == 5).all()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -np.inf)
    fifth = dict(zip(names, np.sort(s, axis=1)[:, -5]))
    right = rows.similarity >= rows.point_id.map(fifth) - 1e-5
    far = rows.point_id.map(fifth) < 0.85
    assert far.sum() > 1000 and right.mean() > 0.97 and right[far].mean() > 0.95

"""The most similar vectors of every vector: balanced posting lists.

* A bounded sample (``SAMPLE`` rows, chosen by hash) is split again and again by k-means into parts of nearly equal size;
  the parts' centres are the lists' centroids: one for ``LIST_ROWS`` vectors, at most one for ``SAMPLE_ROWS`` rows of the sample.
* The centroids form a graph in memory (nearest neighbours of each, entered through a few hubs); a beam search over it finds
  the lists near a vector, for a batch of vectors at a time.
* Every vector is indexed: in its nearest list, and on a boundary also in the others whose distance is at most
  ``1 + POST`` times the nearest one's, leaving out a list that is nearer to one already taken than to the vector.
* As a query, a vector looks into the lists within ``1 + PROBE`` times the nearest distance. Each list is one group: blocks
  of queries against its postings, by matrix product, and the best k of every query from all its lists.
* Where there are more vectors than the sample holds, a list can grow: its size is estimated from the sample, and one over
  ``PART_ROWS`` is cut into parts by hash. A posting is in one part, a query looks into all of them, so nothing is lost.
  ``exact=True`` has every query look into every list (cut into such parts): brute force, for collections that bear it.

Points are numbers in the order of their ids until the end, and between tasks a vector moves as 16-bit whole numbers of its
largest component (a cosine changes by about a millionth). Vectors with equal content are indexed once, with the smallest number
of them; the others are put back at the end, so a vector that a third of all rows repeat is one posting. Ties go to the smaller
id. Null, all-zero, non-finite vectors and those of another size take no part; a point sent again counts once (the last sent);
empty tables give an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftline.plans.shared import cut, small

DIMENSIONS = 64
SAMPLE, SAMPLE_ROWS, LIST_ROWS, PART_ROWS = 60_000, 4, 512, 20_000
POST, PROBE, REPLICAS, PROBES = 0.12, 0.30, 4, 6
DEGREE, BEAM = 16, 24
#: The same for neighbours however far: lists that a point looks into at most, and how much farther than the nearest.
FAR_PROBES, FAR_REACH = 20, 0.6
#: Rows of two numbers up to which a table is sent to every task.
FEW = 500_000


def _vectors(points: DataFrame, dimensions: int) -> DataFrame:
    """``point_id, dense, embedded_at, h, g``: the rows that may take part, with 128 bits of hash of the vector."""
    good = (F.size("dense") == dimensions) & F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("dense", lambda x: x != 0)
    kept = points.where(F.col("point_id").isNotNull() & F.col("dense").isNotNull() & good)
    return kept.select("point_id", "dense", "embedded_at", F.xxhash64("dense").alias("h"), F.xxhash64(F.lit(7), "dense").alias("g"))


def usable(points: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``no, point_id, first, copies, h, g, sent``: every point that takes part, numbered in the order of ids; ``first`` is the number
    of the first point with the same vector, ``sent`` how often the point came with it. Vectors don't move: hashes stand for them."""
    each = _vectors(points, dimensions).groupBy("point_id", "h", "g").agg(F.max("embedded_at").alias("at"), F.count(F.lit(1)).alias("sent"))
    last = each.groupBy("point_id").agg(F.max(F.struct("at", "h", "g", "sent")).alias("c"))
    numbered = cut(last.select("point_id", "c.h", "c.g", "c.sent").orderBy("point_id").withColumn("no", F.monotonically_increasing_id()))
    again = numbered.groupBy("h", "g").agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    known = numbered.join(small(again, FEW), ["h", "g"], "left")
    return cut(known.select("no", "point_id", F.coalesce("first", "no").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"), "h", "g", "sent"))


def classes(points: DataFrame, members: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``key, raw``: the different vectors, as bytes of 16-bit numbers. This is where vectors move: those of points that were sent
    again, after a first choice in each task, and all if the table of points isn't small."""
    first = small(members.where("no = first").select(F.col("no").alias("key"), "point_id", "h", "g", "sent"), FEW)
    found = _vectors(points, dimensions).drop("embedded_at").join(first, ["point_id", "h", "g"]).select("key", "sent", "dense")
    once, again = found.where("sent = 1").select("key", "dense"), found.where("sent > 1").groupBy("key").agg(F.first("dense").alias("dense"))
    return once.unionByName(again).select("key", _pack("dense").alias("raw"))


def split_evenly(x: np.ndarray, parts: int, rng: np.random.Generator, branch: int = 8) -> np.ndarray:
    """Centres of ``parts`` nearly equal parts of the rows of x, by repeated balanced k-means."""
    todo, done = [(np.arange(len(x)), max(1, parts))], []
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) <= 2:
            centre = x[rows].mean(0)
            done.append(centre / (np.linalg.norm(centre) or 1.0))
            continue
        b = min(branch, n, len(rows))
        own = x[rows]
        centres = own[rng.choice(len(rows), b, replace=False)]
        room = -(-len(rows) // b)
        for _ in range(6):
            near = own @ centres.T
            label = near.argmax(1)
            for j in np.argsort(-np.bincount(label, minlength=b)):  # a part over its room gives its farthest rows away
                mine = np.flatnonzero(label == j)
                limit = int(room * 1.5)
                if len(mine) > limit:
                    away = mine[np.argsort(-near[mine, j])[limit:]]
                    near[away, j] = -np.inf
                    label[away] = near[away].argmax(1)
            for j in range(b):
                if (label == j).any():
                    centre = own[label == j].mean(0)
                    centres[j] = centre / (np.linalg.norm(centre) or 1.0)
        sizes = np.bincount(label, minlength=b)
        for j in range(b):
            if sizes[j]:
                todo.append((rows[label == j], max(1, round(n * sizes[j] / len(rows)))))
    return np.array(done, dtype=np.float32)


class CentroidGraph:
    """A graph over unit vectors: each one's nearest neighbours, and hubs to begin at."""

    def __init__(self, centroids: np.ndarray, seed: int = 7) -> None:
        self.c = np.ascontiguousarray(centroids, dtype=np.float32)
        n = len(self.c)
        d = min(DEGREE, n)
        self.links = np.empty((n, d), dtype=np.int32)
        for at in range(0, n, 1024):
            near = self.c[at : at + 1024] @ self.c.T
            self.links[at : at + 1024] = np.argpartition(-near, d - 1, axis=1)[:, :d]
        hubs = max(BEAM, int(2 * n**0.5))
        self.hubs = np.random.default_rng(seed).permutation(n)[:hubs].astype(np.int32)

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and similarities of about the k most similar centroids of every row, most similar first; -1 where there are fewer."""
        n = len(x)
        near = x @ self.c[self.hubs].T
        beam = min(BEAM, len(self.hubs))
        at = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
        ids, sims = self.hubs[at], np.take_along_axis(near, at, 1)
        open_ = np.ones_like(ids, dtype=bool)
        rows = np.arange(n)[:, None]
        for _ in range(24):
            waiting = np.where(open_, sims, -np.inf)
            pick = np.argpartition(-waiting, min(2, beam - 1), axis=1)[:, :2]
            live = np.isfinite(np.take_along_axis(waiting, pick, 1))
            if not live.any():
                break
            open_[rows, pick] = False
            more = self.links[np.where(live, ids[rows, pick], ids[:, :1])].reshape(n, -1)
            new = np.einsum("nd,nmd->nm", x, self.c[more])
            ids2, sims2, open2 = np.hstack([ids, more]), np.hstack([sims, new]), np.hstack([open_, np.ones_like(more, dtype=bool)])
            order = np.argsort(ids2 * 2 + open2, axis=1, kind="stable")  # of equal ids the one already expanded comes first
            ids2, sims2, open2 = (np.take_along_axis(a, order, 1) for a in (ids2, sims2, open2))
            again = np.zeros_like(open2)
            again[:, 1:] = ids2[:, 1:] == ids2[:, :-1]
            sims2[again], open2[again] = -np.inf, False
            best = np.argpartition(-sims2, beam - 1, axis=1)[:, :beam]
            ids, sims, open_ = (np.take_along_axis(a, best, 1) for a in (ids2, sims2, open2))
            open_ &= np.isfinite(sims)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def lists(self, x: np.ndarray, probes: int = PROBES, reach: float = PROBE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every row the near lists, which of them hold it, and which it looks into."""
        ids, sims = self.search(x, probes)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * np.where(ids >= 0, sims, -1.0)))
        nearest = far[:, :1]
        probe = (ids >= 0) & (far <= (1 + reach) * nearest + 1e-6)
        post = (ids >= 0) & (far <= (1 + POST) * nearest + 1e-6)
        post[:, REPLICAS:] = False
        for j in range(1, min(REPLICAS, ids.shape[1])):
            for i in range(j):
                between = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("nd,nd->n", self.c[ids[:, j]], self.c[ids[:, i]])))
                post[:, j] &= ~(post[:, i] & (between < 0.7 * far[:, j]))
        return ids, post, probe


_GRAPHS: dict[str, CentroidGraph] = {}


def _unit(raw: list) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.int16).reshape(len(raw), -1).astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _pack(dense):
    """A vector as bytes: of its direction, the largest component being 32,767."""

    @F.pandas_udf("binary")
    def pack(values):
        import pandas as pd

        if not len(values):
            return pd.Series([], dtype="object")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in values])
        x = np.rint(x / np.abs(x).max(1, keepdims=True) * 32_767).astype(np.int16)
        return pd.Series([v.tobytes() for v in x])

    return pack(dense)


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE) -> tuple[CentroidGraph, np.ndarray]:
    """The centroids' graph, from the bounded sample of rows with the smallest hashes, and the number of parts of each list."""
    share = min(1.0, sample / max(n, 1))
    cut_at = max(-(2**63), min(2**63 - 1, int((2 * share - 1) * 2**63)))
    rows = vectors.where(F.xxhash64("key") <= F.lit(cut_at)).select("raw").limit(2 * sample).toPandas()  # about `sample` rows; the limit only guards the driver
    if not len(rows):
        return CentroidGraph(np.eye(1, DIMENSIONS, dtype=np.float32)), np.ones(1, dtype=np.int64)
    x = _unit(list(rows["raw"]))
    lists = int(max(1, min(n // LIST_ROWS, len(x) // SAMPLE_ROWS)))
    graph = CentroidGraph(split_evenly(x, lists, np.random.default_rng(11)))
    parts = np.ones(len(graph.c), dtype=np.int64)
    if n > len(x):
        held = np.zeros(len(graph.c))
        for at in range(0, len(x), 1000):
            ids, post, _ = graph.lists(x[at : at + 1000])
            np.add.at(held, ids[post], 1)
        parts = np.maximum(1, np.ceil(held * (n / len(x)) / PART_ROWS)).astype(np.int64)
    return graph, parts


def postings(vectors: DataFrame, graph: CentroidGraph, parts: np.ndarray, exact: bool = False, probes: int = PROBES, reach: float = PROBE) -> DataFrame:
    """``list, part, key, raw, use``: a row for each part of a list that holds a vector (1), that it looks into (2), or both (3)."""
    shared, token = vectors.sparkSession.sparkContext.broadcast((graph.c, graph.links, graph.hubs, parts)), uuid.uuid4().hex

    def run(batches):
        import pandas as pd

        parts = shared.value[3]
        if token not in _GRAPHS:
            _GRAPHS.clear()
            g = object.__new__(CentroidGraph)
            g.c, g.links, g.hubs = shared.value[:3]
            _GRAPHS[token] = g
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                ids, post, probe = _GRAPHS[token].lists(_unit(list(part["raw"])), probes, reach)
                if exact:
                    near, ids = ids, np.broadcast_to(np.arange(len(parts)), (len(part), len(parts)))
                    post = ids == near[:, :1]
                    probe = np.ones_like(post)
                i, j = np.nonzero(post | probe)
                name, many = ids[i, j], parts[ids[i, j]]
                keys = part["key"].to_numpy()[i]
                own = (keys * 0x9E3779B1 >> 7) % many
                again = np.where(probe[i, j], many, 1)
                row = np.repeat(np.arange(len(i)), again)
                step = np.arange(len(row)) - np.repeat(np.cumsum(again) - again, again)
                at_part = np.where(probe[i, j][row], step, own[row])
                use = np.where(post[i, j][row] & (at_part == own[row]), 1, 0) + np.where(probe[i, j][row], 2, 0)
                yield pd.DataFrame({"list": name[row].astype("int32"), "part": at_part.astype("int32"), "key": keys[row], "raw": part["raw"].to_numpy()[i][row], "use": use.astype("int8")})

    return vectors.select("key", "raw").mapInPandas(run, "list int, part int, key bigint, raw binary, use tinyint")


def _best_of_list(k: int, least: float):
    def run(pdf):
        import pandas as pd

        held = pdf[(pdf["use"] & 1) > 0].sort_values("key")
        asks = pdf[(pdf["use"] & 2) > 0]
        out_q, out_p, out_s = [], [], []
        if len(held) and len(asks):
            p, names = _unit(list(held["raw"])), held["key"].to_numpy()
            for at in range(0, len(asks), 1024):
                block = asks.iloc[at : at + 1024]
                q, own = _unit(list(block["raw"])), block["key"].to_numpy()
                near = q @ p.T
                place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                mine = np.flatnonzero(names[place] == own)
                near[mine, place[mine]] = -np.inf
                # more than k are looked at, as single precision may turn the order of nearly equal ones
                m = min(k + 3, near.shape[1])
                best = np.argpartition(-near, m - 1, axis=1)[:, :m]
                i, j = np.nonzero(np.take_along_axis(near, best, 1) >= least - 1e-4)
                j = best[i, j]
                exact = np.maximum(np.einsum("nd,nd->n", q[i].astype(np.float64), p[j].astype(np.float64)), -1.0)
                order = np.lexsort((j, -exact, i))  # the list's numbers are in order
                i, j, exact = i[order], j[order], exact[order]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                out_q.append(own[i[top]])
                out_p.append(names[j[top]])
                out_s.append(exact[top])
        if not out_q:
            return pd.DataFrame({"key": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        return pd.DataFrame({"key": np.concatenate(out_q), "other": np.concatenate(out_p), "similarity": np.concatenate(out_s)})

    return run


def nearest_vectors(vectors: DataFrame, n: int, k: int, least: float, exact: bool = False, probes: int = PROBES, reach: float = PROBE) -> DataFrame:
    """``key, other, similarity``: of every different vector the k most similar others of at least ``least``."""
    graph, parts = fit(vectors, n)
    found = postings(vectors, graph, parts, exact, probes, reach).groupBy("list", "part").applyInPandas(_best_of_list(k, least), "key bigint, other bigint, similarity double")
    # one shuffle by key serves the grouping and the ranking
    once = found.repartition("key").groupBy("key", "other").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= least)
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbours(points: DataFrame, k: int = 5, least: float = 0.85, exact: bool = False, probes: int = PROBES, reach: float = PROBE) -> DataFrame:
    """``point_id, other_id, similarity``: of every point the k most similar other points of at least ``least``; -1 leaves none out.

    probes, reach: how many lists a point looks into at most, and how much farther than the nearest; far neighbours need more.
    """
    members = usable(points)
    count = members.agg(F.count_if(F.col("no") == F.col("first")).alias("n")).first().n
    near = nearest_vectors(classes(points, members), count, k, least, exact, probes, reach)
    # of points with the same vector the first k + 1 can count, and only the few that lack k among themselves look at other vectors
    rank = F.row_number().over(W.partitionBy("first").orderBy("no"))
    alike = members.where("copies > 1").select("first", "no", "copies").withColumn("_r", rank).where(F.col("_r") <= k + 1)
    groups = cut(alike.groupBy("first").agg(F.array_sort(F.collect_list("no")).alias("nos"), F.first("copies").alias("copies")))
    sent = small(groups, FEW)
    listed = near.join(sent.select(F.col("first").alias("other"), F.col("nos").alias("other_nos")), "other", "left").join(sent.select(F.col("first").alias("key"), "nos", "copies"), "key", "left")
    each = listed.where(F.coalesce("copies", F.lit(1)) <= k).select("key", "similarity", "nos", "copies", F.explode(F.coalesce("other_nos", F.array("other"))).alias("other"))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    ranked = each.withColumn("_r", place).where(F.col("_r") <= k - F.coalesce("copies", F.lit(1)) + 1)
    outside = ranked.select(F.explode(F.coalesce("nos", F.array("key"))).alias("no"), "other", "similarity")
    repeated = members.where("copies > 1").select("no", "first").join(sent.select("first", "nos"), "first")
    copies = repeated.select("no", F.explode(F.slice(F.array_except("nos", F.array("no")), 1, k)).alias("other"), F.lit(1.0).alias("similarity"))
    names = small(members.select("no", "point_id"), FEW)
    both = outside.unionByName(copies).join(names, "no").join(names.select(F.col("no").alias("other"), F.col("point_id").alias("other_id")), "other")
    return both.select("point_id", "other_id", "similarity")


def pairs(points: DataFrame, k: int = 5, least: float = 0.85) -> DataFrame:
    """Pairs of points of which at least one is among the k most similar to the other: ``point_a < point_b``."""
    found = neighbours(points, k, least)
    return found.select(F.least("point_id", "other_id").alias("point_a"), F.greatest("point_id", "other_id").alias("point_b")).distinct()

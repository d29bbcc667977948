"""Exact dense search: query vectors in blocks against all points, by matrix product.

Points and queries are packed, per task, into blocks of ``BLOCK`` vectors; each pair of blocks is one matrix product of which a
task keeps what is among the best k of a query over all its blocks so far, and a ranking over those few rows ends it. Vectors that are null, of another size than the
queries' or hold null or non-finite numbers take no part; an all-zero vector has cosine 0 with everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.sparse import ranked
from siftline.plans.shared import cut

BLOCK = 2_000
#: Bytes of query vectors that are sent to every task.
FEW_BYTES = 64 << 20
#: Rows that a task holds before it gives them on.
HELD = 2_000_000
PACKED = "ids array<string>, size int, block binary"


def once(points: DataFrame) -> DataFrame:
    """Each point once, as it was sent last."""
    return points.where("point_id IS NOT NULL AND dense IS NOT NULL").groupBy("point_id").agg(F.max_by("dense", F.struct("embedded_at", "dense")).alias("dense"))


def usable(vector: Column, size: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _packed(vectors: DataFrame, key: str, size: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                yield pd.DataFrame({"ids": [list(part["k"])], "size": [len(part)], "block": [np.stack(part["dense"].to_list()).astype(np.float64).tobytes()]})

    return vectors.where(usable(F.col("dense"), size)).select(F.col(key).cast("string").alias("k"), "dense").mapInPandas(run, PACKED)


class _Block:
    """The best of a block of queries so far; of equal scores at the border all are kept: the smaller id wins later."""

    def __init__(self, qids: tuple, k: int) -> None:
        import numpy as np

        self.qids, self.k, self.least, self.parts, self.rows = qids, k, np.full(len(qids), -np.inf), [], 0

    def add(self, score, ids) -> None:
        import numpy as np

        n = min(self.k, score.shape[1])
        least = self.least
        if not (least > -np.inf).all():
            least = np.maximum(least, np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n])
        i, j = np.nonzero(score >= least[:, None])
        self.parts.append((i, ids[j], score[i, j]))
        self.rows += len(i)
        if self.rows > 2 * self.k * len(self.qids) or len(self.parts) == 1:
            self.cut()

    def cut(self) -> None:
        import numpy as np

        i, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((-score, i))
        i, ids, score = i[order], ids[order], score[order]
        first = np.searchsorted(i, np.arange(len(self.qids) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = np.maximum(self.least[full], score[first[full] + self.k - 1])
        keep = score >= self.least[i]
        self.parts, self.rows = [(i[keep], ids[keep], score[keep])], int(keep.sum())

    def take(self):
        import numpy as np
        import pandas as pd

        self.cut()
        i, ids, score = self.parts[0]
        self.parts, self.rows = [], 0
        return pd.DataFrame({"query_id": np.asarray(self.qids, dtype=object)[i], "point_id": ids, "score": score})


def _compare(distance: str, k: int) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import numpy as np

        def unit(x):
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

        blocks: dict[tuple, _Block] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                q = np.frombuffer(r.qblock).reshape(r.qsize, -1)
                p = np.frombuffer(r.block).reshape(r.size, -1)
                if distance == "Cosine":
                    score = unit(q) @ unit(p).T
                elif distance == "Dot":
                    score = q @ p.T
                elif distance == "Euclid":
                    score = -np.sqrt(np.maximum(0, ((q[:, None, :] - p[None]) ** 2).sum(-1))) if len(q) * len(p) < 20_000 else np.vstack([-np.sqrt(((p - x) ** 2).sum(1)) for x in q])
                else:
                    score = np.vstack([-np.abs(p - x).sum(1) for x in q])
                qids = tuple(r.qids)
                if qids not in blocks:
                    blocks[qids] = _Block(qids, k)
                blocks[qids].add(score, np.asarray(r.ids, dtype=object))
                if sum(b.rows for b in blocks.values()) > HELD:  # more query blocks than a task holds: their least scores stay
                    yield from (b.take() for b in blocks.values() if b.rows)
        yield from (b.take() for b in blocks.values() if b.rows)

    return run


def scores(queries: DataFrame, points: DataFrame, k: int, distance: str = "Cosine", size: int = 64) -> DataFrame:
    """``query_id, point_id, score``: for each query a superset of its k best points; distances count negative."""
    q = _packed(queries, "query_id", size).select(F.col("ids").alias("qids"), F.col("size").alias("qsize"), F.col("block").alias("qblock"))
    # blocks of a stated query set against blocks of all points; few of them go to every task, more are paired partition by partition
    q = cut(q)
    pairs = _packed(points, "point_id", size).crossJoin(F.broadcast(q) if q.agg(F.coalesce(F.sum(F.length("qblock")), F.lit(0)).alias("n")).first().n <= FEW_BYTES else q.hint("shuffle_replicate_nl"))
    kind = queries.schema["query_id"].dataType.simpleString()
    found = pairs.mapInPandas(_compare(distance, k), "query_id string, point_id string, score double")
    return found.withColumn("query_id", F.col("query_id").cast(kind))


def topk(queries: DataFrame, points: DataFrame, k: int, distance: str = "Cosine", size: int = 64) -> DataFrame:
    """``query_id, point_id, score, rank`` of ``query_id, dense`` against ``point_id, dense``."""
    return ranked(scores(queries, points, k, distance, size), k)


def embed(records: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list]], batch: int = 64, name: str = "dense") -> DataFrame:
    """Adds the vectors of a model. ``model()`` is called once per worker and gives a function from texts to vectors."""

    return records.withColumn(name, _iterator_udf(model, batch)(F.col(text)))


def _iterator_udf(model: Callable, batch: int):
    import pandas as pd

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for s in batches:
            out = []
            for at in range(0, len(s), batch):
                out += [None if v is None else [float(x) for x in v] for v in encode(s.iloc[at : at + batch].fillna("").to_list())]
            yield pd.Series(out, index=s.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")

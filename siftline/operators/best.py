"""The best documents of many queries, block of documents by block, in numpy: no pair of a query and a document leaves its task.

A task takes its documents in blocks. Within a block every query adds up the postings of its terms; terms whose largest weights
together cannot reach the query's k-th best score so far are only looked up for documents that others brought up, so the result
is that of scoring every pair. A task gives its k best documents of each query.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

#: Documents of a task's first block and of its largest; they double, so that the first bounds are found at little cost.
FIRST, LARGEST = 4_096, 65_536
#: What rounding to nine places and the order of summation may change.
SLACK = 1e-8


@dataclasses.dataclass(frozen=True)
class Asked:
    """Queries numbered from 0 as rows of terms, with what weights need: ``terms[at[starts[q]:starts[q + 1]]]`` are asked ``times`` each."""

    terms: list[str]
    idf: object
    starts: object
    at: object
    times: object
    average: float
    k1: float
    b: float
    k: int


class Best:
    """The k best documents of each query so far: score down, then id up."""

    def __init__(self, n: int, k: int) -> None:
        import numpy as np

        self.k, self.score, self.doc, self.held = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros(n, np.int64)
        self.least = np.full(n, -np.inf)
        self.ids: list = []  # the ids of each block, in order
        self.before = [0]

    def block(self, ids) -> int:
        """Takes up the sorted ids of a block; the number of its first document."""
        self.ids.append(ids)
        self.before.append(self.before[-1] + len(ids))
        return self.before[-2]

    def id(self, doc: int):
        from bisect import bisect_right

        i = bisect_right(self.before, doc) - 1
        return self.ids[i][int(doc) - self.before[i]].as_py()

    def add(self, q: int, docs, scores) -> None:
        """docs: of one block, in order of their ids; those below the query's least score may be left out."""
        import numpy as np

        k = self.k
        if len(docs) > k:
            docs, scores = self.cut(docs, scores)
        h = self.held[q]
        if h + len(docs) <= k:
            self.score[q, h : h + len(docs)], self.doc[q, h : h + len(docs)] = scores, docs
            self.held[q] = h = h + len(docs)
        else:
            s, d = np.concatenate([self.score[q, :h], scores]), np.concatenate([self.doc[q, :h], docs])
            least = np.partition(s, len(s) - k)[len(s) - k]
            above, equal = np.flatnonzero(s > least), np.flatnonzero(s == least)
            if len(above) + len(equal) > k:  # ids of several blocks have to be compared
                equal = np.array(sorted(equal, key=lambda i: self.id(d[i]))[: k - len(above)], np.int64)
            keep = np.concatenate([above, equal])
            self.score[q], self.doc[q], self.held[q] = s[keep], d[keep], k
            h = k
        if h == k:
            self.least[q] = self.score[q].min()

    def cut(self, docs, scores):
        import numpy as np

        least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        keep = scores > least
        keep[np.flatnonzero(scores == least)[: self.k - keep.sum()]] = True
        return docs[keep], scores[keep]

    def rows(self, step: int = 2_000) -> Iterator:
        """``q, point_id, score`` as Arrow batches."""
        import numpy as np
        import pyarrow as pa

        if not self.ids:
            return
        ids = pa.chunked_array(self.ids)
        for at in range(0, len(self.held), step):
            held = self.held[at : at + step]
            if total := held.sum():
                inside = np.arange(self.k)[None] < held[:, None]
                q = np.repeat(np.arange(at, at + len(held)), held)
                found = ids.take(pa.array(self.doc[at : at + step][inside])).combine_chunks()
                assert len(q) == total
                yield pa.RecordBatch.from_arrays([pa.array(q), found, pa.array(self.score[at : at + step][inside])], ["q", "point_id", "score"])


def _postings(docs, asked: Asked, terms):
    """The block's ids in order, and of each asked term the sorted numbers of its documents and their weights, one after another."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.sort_indices(docs.column("doc_id"))
    ids = docs.column("doc_id").take(order)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    listed, times = docs.column("terms"), docs.column("tfs").flatten().to_numpy()
    code = pc.index_in(listed.flatten(), value_set=terms)
    known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
    code = pc.fill_null(code, 0).to_numpy()[known].astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), pc.list_value_length(listed).to_numpy())[known]
    tf, length = times[known].astype(np.float64), docs.column("len").to_numpy()[doc]
    k1, b = asked.k1, asked.b
    below = k1 * (1 - b + b * length / asked.average) if asked.average > 0 else k1 * (1 - b)
    weight = asked.idf[code] * (tf * (k1 + 1)) / (tf + below)
    doc, some = place[doc], weight != 0
    code, doc, weight = code[some], doc[some], weight[some]
    by = np.argsort(code * len(place) + doc, kind="stable")
    starts = np.zeros(len(asked.terms) + 1, np.int64)
    np.cumsum(np.bincount(code, minlength=len(asked.terms)), out=starts[1:])
    return (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids), starts, doc[by], weight[by]


def _score(best: Best, asked: Asked, docs, terms) -> None:
    import numpy as np

    ids, starts, doc, weight = _postings(docs, asked, terms)
    first = best.block(ids)
    if not len(doc):
        return
    most = np.zeros(len(asked.terms))
    some = np.flatnonzero(np.diff(starts))
    most[some] = np.maximum.reduceat(weight, starts[some])
    total, met = np.zeros(len(ids)), np.zeros(len(ids), bool)
    reach = np.maximum(most[asked.at] * asked.times, 0)
    n = np.diff(starts)[asked.at]
    for q in range(len(asked.starts) - 1):
        a, z = asked.starts[q], asked.starts[q + 1]
        mine = np.flatnonzero(n[a:z]) + a
        if not len(mine):
            continue
        mine = mine[np.argsort(-reach[mine])]
        # what the terms from here on can add at most
        rest = np.append(np.cumsum(reach[mine][::-1])[::-1], 0.0)
        floor = best.least[q] - SLACK
        lead = int((rest[:-1] >= floor).sum())  # the others alone cannot reach the floor
        if not lead:
            continue
        part = [(asked.times[i], slice(starts[asked.at[i]], starts[asked.at[i] + 1])) for i in mine]
        if lead == 1:
            found, s = doc[part[0][1]], part[0][0] * weight[part[0][1]]
        else:
            for t, p in part[:lead]:
                total[doc[p]] += t * weight[p]
                met[doc[p]] = True
            found = np.flatnonzero(met)
            s = total[found]
            total[found], met[found] = 0.0, False
        for j in range(lead, len(part)):
            keep = s + rest[j] >= floor
            found, s = found[keep], s[keep]
            if not len(found):
                break
            t, p = part[j]
            own = doc[p]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            s = s + np.where(own[at] == found, t * weight[p][at], 0.0)
        s = np.round(s, 9)
        if floor > -np.inf:
            keep = s >= best.least[q]
            found, s = found[keep], s[keep]
        if len(found):
            best.add(q, found + first, s)


def search(batches: Iterator, asked: Asked) -> Iterator:
    """Arrow batches of ``doc_id, len, terms, tfs`` to those of ``q, point_id, score``."""
    import pyarrow as pa

    best, terms, size, held, n = Best(len(asked.starts) - 1, asked.k), pa.array(asked.terms, pa.string()), FIRST, [], 0
    for batch in batches:
        while len(batch):
            part = batch.slice(0, size - n)
            batch = batch.slice(len(part))
            held.append(part)
            n += len(part)
            if n == size:
                _score(best, asked, pa.Table.from_batches(held).combine_chunks().to_batches()[0], terms)
                size, held, n = min(2 * size, LARGEST), [], 0
    if n:
        _score(best, asked, pa.Table.from_batches(held).combine_chunks().to_batches()[0], terms)
    yield from best.rows()

"""The main body of web pages: a recurrent labeller of blocks.

A page is the sequence of its leaves, the lines of its candidates between line feeds. A leaf is read as a vector of hashed
words (the mean of learned vectors of its words, with the words at its ends once more), of its tag path (the candidate's type
and where the leaf is in it) and of its shape. A bidirectional LSTM in numpy, which has read the whole page in both
directions, then tells for every leaf whether it is main body. Its weights are trained by ``boilerplate_train``.

Headings that the chunker calls boilerplate are never main body (an exact check after the network).

Pages of any length are read whole. Null candidate lists give nothing; null and blank candidates have no leaves but keep
their position; blank lines keep their number. A missing type is a tag of its own. Every row is its own page.
"""

from __future__ import annotations

import io
import math
import os
import pkgutil
import re
from functools import lru_cache
from string import ascii_uppercase
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS, WIDE, HIDDEN, SHAPES = 4096, 24, 32, 16
WEIGHTS = os.path.join(os.path.dirname(__file__), "boilerplate_weights.npz")
TOKEN = re.compile(r"\w+|[^\w\s]")
DIGITS = re.compile(r"\d+")
#: The headings that the chunker calls boilerplate.
FIXED_HEADINGS = {"v t e", "vte", "v.t.e", "external links", "references", "see also", "notes"}


@lru_cache(200_000)
def _bucket(word: str) -> int:
    return crc32(word.encode()) % BUCKETS


@lru_cache(1)
def _plain():
    from siftline.llm.lookalike import Rewriter, representatives

    return Rewriter(*representatives({}))


class Page:
    """The leaves of a page: hashed words, tags and shapes of each, and where each came from."""

    __slots__ = ("words", "tags", "shapes", "at", "fixed")

    def __init__(self, candidates: list, types: list | None, title: str | None) -> None:
        self.words, self.tags, self.shapes, self.at, self.fixed = [], [], [], [], []
        name = " ".join((title or "").lower().split())
        n = len(candidates)
        for c, text in enumerate(candidates):
            if text is None or not text.strip():
                continue
            kind = (types[c] if types is not None and c < len(types) else None) or "none"
            lines = _plain()(text).split("\n") if not text.isascii() else text.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            for k, i in enumerate(full):
                raw = lines[i].strip()
                flat = raw.lower()
                low, flat = DIGITS.sub("0", flat), " ".join(flat.split())
                words = TOKEN.findall(low)
                ends = [f"^{words[0]}", f"^^{' '.join(words[:2])}", f"${words[-1]}"] if words else []
                place = "only" if len(full) == 1 else "first" if k == 0 else "last" if k == len(full) - 1 else "inner"
                self.words.append([_bucket(w) for w in words] + [_bucket(w) for w in ends] or [0])
                self.tags.append([_bucket(f"<{kind.strip().lower()}>"), _bucket(f"<{kind.strip().lower()}/{place}>"), _bucket(f"<{place}/{min(len(full), 8)}>")])
                count = max(1, len(words))
                self.shapes.append((
                    math.log1p(len(raw)) / 6, math.log1p(count) / 4, raw[-1] in ".!?", raw[-1] == ":", sum(map(raw.count, "|/>·»")) / count, raw.count(" - ") / count,
                    words.count("0") / count, (sum(map(raw.count, ascii_uppercase)) if raw.isascii() else sum(map(str.isupper, raw))) / len(raw), raw[0] in "-*•", k == 0, k == len(full) - 1, len(full) == 1,
                    c / n, c == n - 1, bool(name) and name in flat, "," in raw,
                ))
                self.at.append((c, i))
                self.fixed.append(flat in FIXED_HEADINGS)


def bags(lists: list[list[int]], table: np.ndarray) -> np.ndarray:
    """The mean vector of each list."""
    sizes = np.array([len(x) for x in lists])
    flat = table[np.concatenate([np.asarray(x) for x in lists])]
    return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.sqrt(sizes)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states over time of a batch (time, page, feature); where the mask is 0 the state stays."""
    steps, pages, _ = x.shape
    k = u.shape[0]
    h, c = np.zeros((pages, k), x.dtype), np.zeros((pages, k), x.dtype)
    out = np.empty((steps, pages, k), x.dtype)
    given = x @ w + b
    for t in range(steps):
        z = given[t] + h @ u
        gates = sigmoid(z[:, : 3 * k])
        i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        th = np.tanh(c2)
        if keep is not None:
            keep.append((h, c, i, f, o, g, th, m))
        c = m * c2 + (1 - m) * c
        h = m * (o * th) + (1 - m) * h
        out[t] = h
    return out


class Labeller:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: np.asarray(v, dtype=np.float32) for k, v in weights.items()}

    def inputs(self, pages: list[Page]) -> np.ndarray:
        words = bags([x for p in pages for x in p.words], self.w["words"])
        tags = bags([x for p in pages for x in p.tags], self.w["words"])
        shapes = np.array([x for p in pages for x in p.shapes], dtype=np.float32)
        return np.concatenate([words, tags, shapes], axis=1).astype(np.float32)

    @staticmethod
    def padded(flat: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(sizes)
        x = np.zeros((steps, len(sizes), flat.shape[1]), np.float32)
        mask = np.zeros((steps, len(sizes)), np.float32)
        at = 0
        for j, n in enumerate(sizes):
            x[:n, j], mask[:n, j] = flat[at : at + n], 1
            at += n
        return x, mask

    def scores(self, pages: list[Page]) -> list[np.ndarray]:
        """For each page the chance of each leaf to be chrome. Pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p.words), key=lambda i: len(pages[i].words))
        while order:
            longest = len(pages[order[-1]].words)
            take = order[-max(1, min(128, 20_000 // longest)) :]
            del order[-len(take) :]
            sizes = [len(pages[i].words) for i in take]
            x, mask = self.padded(self.inputs([pages[i] for i in take]), sizes)
            w = self.w
            ahead = lstm(x, mask, w["wf"], w["uf"], w["bf"])
            back = lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"])[::-1]
            chance = sigmoid(ahead @ w["of"] + back @ w["ob"] + x @ w["ox"] + w["o"])[..., 0]
            for j, (i, n) in enumerate(zip(take, sizes, strict=True)):
                out[i] = chance[:n, j]
        return out


@lru_cache(2)
def labeller(path: str = WEIGHTS) -> Labeller:
    source = path
    if path == WEIGHTS and not os.path.exists(path):  # the package is imported from an archive
        source = io.BytesIO(pkgutil.get_data("siftline.llm", os.path.basename(path)))
    with np.load(source) as f:
        return Labeller(dict(f))


def _pages(pdf):
    titles = pdf["title"] if "title" in pdf else [None] * len(pdf)
    listed = lambda x: None if x is None else list(x)
    return [Page(listed(c) or [], listed(t), s if isinstance(s, str) else None) for c, t, s in zip(pdf["candidates"], pdf["passage_types"], titles, strict=True)]


def chrome_lines(rows: DataFrame, weights: str | None = None) -> DataFrame:
    """``id, cand_pos, line_no``: lines of candidates that are not main body."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                pages = _pages(part)
                found = []
                for name, page, chance in zip(part["id"], pages, labeller(weights or WEIGHTS).scores(pages), strict=True):
                    found += [(name, c, i) for (c, i), fixed, p in zip(page.at, page.fixed, chance, strict=True) if fixed or p >= 0.5]
                yield pd.DataFrame(found, columns=["id", "cand_pos", "line_no"]).astype({"id": "object", "cand_pos": "int64", "line_no": "int64"})

    usable = rows.where(F.col("candidates").isNotNull()).select("id", "candidates", "passage_types", "title")
    return usable.mapInPandas(run, "id string, cand_pos bigint, line_no bigint")


def main_body(rows: DataFrame, weights: str | None = None) -> DataFrame:
    """``id, cand_pos, text``: every candidate with only its lines of main body; those without any are left out."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                pages, kept = _pages(part), []
                for name, candidates, page, chance in zip(part["id"], part["candidates"], pages, labeller(weights or WEIGHTS).scores(pages), strict=True):
                    bodies: dict[int, list[str]] = {}
                    for (c, i), fixed, p in zip(page.at, page.fixed, chance, strict=True):
                        if not fixed and p < 0.5:
                            bodies.setdefault(c, []).append(candidates[c].split("\n")[i])
                    kept += [(name, c, "\n".join(x)) for c, x in bodies.items()]
                yield pd.DataFrame(kept, columns=["id", "cand_pos", "text"]).astype({"id": "object", "cand_pos": "int64", "text": "object"})

    usable = rows.where(F.col("candidates").isNotNull()).select("id", "candidates", "passage_types", "title")
    return usable.mapInPandas(run, "id string, cand_pos bigint, text string")

"""Training of the block labeller: ``python -m siftline.llm.boilerplate_train DATA.parquet [WEIGHTS.npz]``.

Fits on a bounded sample of labelled rows: the ``ROWS`` raw rows whose ids have the smallest hashes, labelled by
``boilerplate_teacher``. In each epoch every page is *varied*: blocks of ``boilerplate_variants`` are put among its own, chrome in
words of which most are drawn at random, and genuine headings, lists and sentences that hold the words of menus and notices. So
what a block is must be read from its form and its place rather than from a list of words. One row in ten is held out and the
accuracy on it printed. Plain numpy: truncated to ``STEPS`` leaves a page, Adam, word dropout.
"""

from __future__ import annotations

import sys
from zlib import crc32

import numpy as np

from siftline.llm.boilerplate import BUCKETS, HIDDEN, SHAPES, WEIGHTS, WIDE, Labeller, Page, _plain, bags, lstm, sigmoid
from siftline.llm.boilerplate_teacher import labels
from siftline.llm.boilerplate_variants import varied

ROWS, STEPS, EPOCHS, BATCH, RATE, DROP = 8_000, 64, 12, 48, 4e-3, 0.2


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    size = 2 * WIDE + SHAPES
    fresh = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    return {
        "words": (0.2 * rng.standard_normal((BUCKETS, WIDE))).astype(np.float32),
        "wf": fresh(size, 4 * HIDDEN), "uf": fresh(HIDDEN, 4 * HIDDEN), "bf": bias.copy(),
        "wb": fresh(size, 4 * HIDDEN), "ub": fresh(HIDDEN, 4 * HIDDEN), "bb": bias.copy(),
        "of": fresh(HIDDEN, 1), "ob": fresh(HIDDEN, 1), "ox": fresh(size, 1), "o": np.zeros(1, np.float32),
    }


def back_through(dh_out: np.ndarray, x: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of an LSTM's weights and inputs from those of its outputs."""
    steps, pages, k = dh_out.shape
    dz_all = np.empty((steps, pages, 4 * k), np.float32)
    du = np.zeros_like(u)
    dh, dc = np.zeros((pages, k), np.float32), np.zeros((pages, k), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, th, m = kept[t]
        dh = dh + dh_out[t]
        live, held = dh * m, dh * (1 - m)
        dc2 = dc * m + live * o * (1 - th * th)
        dz = dz_all[t]
        dz[:, :k], dz[:, k : 2 * k] = dc2 * g * i * (1 - i), dc2 * c * f * (1 - f)
        dz[:, 2 * k : 3 * k], dz[:, 3 * k :] = live * th * o * (1 - o), dc2 * i * (1 - g * g)
        du += h.T @ dz
        dh, dc = held + dz @ u.T, dc2 * f + dc * (1 - m)
    flat = dz_all.reshape(-1, 4 * k)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0), dz_all @ w.T


def step(w: dict, pages: list[Page], truth: list[np.ndarray], rng: np.random.Generator) -> tuple[float, dict]:
    """Loss and gradients of a batch."""
    words = [[b for b in x if rng.random() > DROP] or x[:1] for p in pages for x in p.words]
    tags = [x for p in pages for x in p.tags]
    shapes = np.array([x for p in pages for x in p.shapes], dtype=np.float32)
    flat = np.concatenate([bags(words, w["words"]), bags(tags, w["words"]), shapes], axis=1).astype(np.float32)
    sizes = [len(p.words) for p in pages]
    x, mask = Labeller.padded(flat, sizes)
    y, _ = Labeller.padded(np.concatenate(truth)[:, None].astype(np.float32), sizes)
    kf, kb = [], []
    hf = lstm(x, mask, w["wf"], w["uf"], w["bf"], kf)
    hb = lstm(x[::-1], mask[::-1], w["wb"], w["ub"], w["bb"], kb)[::-1]
    p = sigmoid(hf @ w["of"] + hb @ w["ob"] + x @ w["ox"] + w["o"])
    n = mask.sum()
    loss = -(mask[..., None] * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n
    d = (p - y) * mask[..., None] / n
    two = lambda a: a.reshape(-1, a.shape[2])
    g = {"of": two(hf).T @ two(d), "ob": two(hb).T @ two(d), "ox": two(x).T @ two(d), "o": d.sum((0, 1))}
    g["wf"], g["uf"], g["bf"], dx = back_through(d @ w["of"].T, x, kf, w["wf"], w["uf"])
    g["wb"], g["ub"], g["bb"], dxb = back_through((d @ w["ob"].T)[::-1], x[::-1], kb, w["wb"], w["ub"])
    dx = dx + dxb[::-1] + d @ w["ox"].T
    leaf = np.concatenate([dx[:n, j] for j, n in enumerate(sizes)])
    g["words"] = np.zeros_like(w["words"])
    for lists, part in ((words, leaf[:, :WIDE]), (tags, leaf[:, WIDE : 2 * WIDE])):
        count = np.array([len(v) for v in lists])
        np.add.at(g["words"], np.concatenate([np.asarray(v) for v in lists]), np.repeat(part / np.sqrt(count)[:, None], count, axis=0))
    return float(loss), g


def shorten(page: Page, truth: np.ndarray, rng: np.random.Generator) -> tuple[Page, np.ndarray]:
    if len(page.words) <= STEPS:
        return page, truth
    at = int(rng.integers(0, len(page.words) - STEPS + 1))
    short = object.__new__(Page)
    for name in Page.__slots__:
        setattr(short, name, getattr(page, name)[at : at + STEPS])
    return short, truth[at : at + STEPS]


def labelled(rows: list[dict], rng: np.random.Generator | None = None) -> list[tuple[Page, np.ndarray]]:
    """Pages and the labels of their leaves; varied if a source of chance is given."""
    out = []
    for r in rows:
        marks = [labels(_plain()(t)) if t and t.strip() else [] for t in r["candidates"] or []]
        texts, types = [_plain()(t) if t else t for t in r["candidates"] or []], r["passage_types"]
        if rng is not None:
            texts, types, marks = varied(texts, types, marks, r["title"], rng)
        page = Page(texts, types, r["title"])
        if page.words:
            out.append((page, np.array([marks[c][i] for c, i in page.at])))
    return out


def accuracy(model: Labeller, data: list[tuple[Page, np.ndarray]]) -> tuple[float, float, float]:
    got = np.concatenate(model.scores([p for p, _ in data])) >= 0.5
    want = np.concatenate([t for _, t in data])
    return float((got == want).mean()), float((got & want).sum() / max(1, got.sum())), float((got & want).sum() / max(1, want.sum()))


def train(rows: list[dict], seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    held, fit_rows = labelled(rows[::10]), [r for i, r in enumerate(rows) if i % 10]
    held_varied = labelled(rows[::10], np.random.default_rng(1))
    w = start(rng)
    m, v, t = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    for epoch in range(EPOCHS):
        fit = labelled(fit_rows, rng) if epoch % 3 else labelled(fit_rows)
        rate = RATE * (1 - epoch / EPOCHS) ** 1.2 + 1e-5
        blocks = np.array_split(rng.permutation(len(fit)), -(-len(fit) // (8 * BATCH)))
        total = []
        for block in blocks:
            block = sorted(block, key=lambda i: len(fit[i][0].words))
            for at in range(0, len(block), BATCH):
                batch = [shorten(*fit[i], rng) for i in block[at : at + BATCH]]
                loss, g = step(w, [p for p, _ in batch], [y for _, y in batch], rng)
                total.append(loss)
                t += 1
                size = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
                for k in w:
                    a = g[k] * min(1.0, 1.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * a
                    v[k] = 0.999 * v[k] + 0.001 * a * a
                    w[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        print(f"epoch {epoch}: loss {np.mean(total):.4f}; held out: accuracy %.5f, precision %.5f, recall %.5f" % accuracy(Labeller(w), held), "; varied: %.5f, %.5f, %.5f" % accuracy(Labeller(w), held_varied), flush=True)
    return w


def main(source: str, target: str = WEIGHTS) -> None:
    import pyarrow as pa
    import pyarrow.dataset as ds

    table = ds.dataset(source)
    ids = sorted(filter(None, table.to_table(columns=["id"])["id"].to_pylist()), key=lambda x: crc32(x.encode()))[:ROWS]
    w = train(table.to_table(columns=["candidates", "passage_types", "title"], filter=ds.field("id").isin(pa.array(ids, pa.string()))).to_pylist())
    np.savez_compressed(target, **{k: a.astype(np.float16) for k, a in w.items()})


if __name__ == "__main__":
    main(*sys.argv[1:])

"""Template residue, filler, error pages and script notices instead of content.

1. One pass over whole texts makes of each document its *body*, the text without title, menu and footer lines, cut into
   sentences, with numbers, hosts, ids and the title masked. ``residue_seeds`` gives the trusted labels: ``placeholder`` (of its
   own document only) and ``whole`` (every sentence of the body is a sure message or filler). Bodies that are equal after masking
   are one. A body carries its SimHash, the smallest fifth of its shingles, the share of its words that sure sentences make up,
   and the hashes of its other, *open* sentences.
2. The label ``whole`` spreads over a graph of bodies, round by round from those that have it, until a round adds none;
   components without a trusted body are never built. Bodies are linked in two ways:

   * *Near-duplicates.* The SimHash is cut into ``BLOCKS`` blocks, and every choice of half of them is a table partitioned by
     their value; bodies of one value in one table whose Hamming distance is at most ``HAMMING`` are candidates. The tables lose
     most pairs that differ in more than a few bits, so bodies that share one of the smallest shingles, which all similar enough
     pairs do, are candidates too. All are verified by the Jaccard similarity of their five-word shingles, at least ``SIMILAR``:
     no link is lost.
   * *Company.* An open sentence that stands in at least ``COMPANY`` bodies that are residue by half of their words or more, and
     in no more others than those (bodies whose sentences are all of this kind not counted), becomes residue, and with it the
     bodies of which no sentence is left open; an article that holds such a sentence keeps its own. (A body that is sure by less than half of its words counts as having no sure sentence.) So kinds and languages that no seed knows are told by the known ones they come with.

Each round asks only rows that meet a fresh key: keys are sent to the tasks while a count shows that they are few, else both
sides are joined by key with salt on the larger. Of fresh bodies with one SimHash one stands for all first; the others look only
at what that one leaves.

Null, empty and blank texts are not residue. Bodies of under five words are one shingle. Repeated documents are judged alike;
nulls in other columns don't matter; empty tables give an empty result.
"""

from __future__ import annotations

import math
import re
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.boilerplate import _plain
from siftline.llm.residue_seeds import LATIN, SEEDS, WORD, Seeds, body_lines, has_placeholder, is_filler, repeats, sentences, unaccented, without_tracebacks
from siftline.plans.shared import cut, small

SHINGLE, SIMILAR, HAMMING = 5, 0.8, 16
BLOCKS, BITS, COMPANY, SALT = 6, 64, 2, 16
#: Keys (of eight bytes) up to which a set of them is sent to every task.
FEW = 500_000

HOST = re.compile(r"\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,8}\b")
HEXES = re.compile(r"\b[0-9a-f]{6,}\b")
NUMBER = re.compile(r"\d+")
DOTTED = re.compile(r"\.[a-z]")


def masked(pieces: list[str], title: str | None) -> list[list[str]]:
    """The words of each piece (in small letters), with what differs from page to page masked."""
    text = "\n".join(pieces)
    name = unaccented(" ".join((title or "").lower().split()))
    if len(name) > 3:
        text = text.replace(name, " titel ")
    if DOTTED.search(text):
        text = HOST.sub(" host ", text)
    if NUMBER.search(text):
        text = NUMBER.sub("0", HEXES.sub(lambda m: "ref" if NUMBER.search(m[0]) else m[0], text))
    return [WORD.findall(piece) for piece in text.split("\n")]


_HASHES: dict[str, int] = {}


def word_hashes(words: list[str]):
    import numpy as np
    import xxhash

    known = _HASHES
    if len(known) > 500_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in words], dtype=np.uint64)


def _mixed(h):
    """The bits of sums spread once more, so that any of them can stand for the whole."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sequence_hashes(hashes, sizes):
    """A signed number for each of the sequences of words that follow each other (``sizes`` of at least 1)."""
    import numpy as np

    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    return _mixed(np.add.reduceat(_mixed(hashes + place * np.uint64(0x9E3779B97F4A7C15)), starts)).astype(np.int64)


def shingle_hashes(hashes, sizes) -> list:
    """For each of the sequences the different five-word shingles, as signed numbers in order; of fewer words the one there is."""
    import numpy as np

    total, have = np.zeros(len(hashes), dtype=np.uint64), len(hashes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(have)  # words from here to the end of the sequence
    for j in range(min(SHINGLE, have)):
        here = np.zeros(have, dtype=np.uint64)
        here[: have - j] = hashes[j:]
        total = np.where(left > j, total * np.uint64(0x9E3779B97F4A7C15) + here, total)
    keep = (left >= SHINGLE) | (np.repeat(np.minimum(sizes, SHINGLE), sizes) == left)
    owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
    found = _mixed(total[keep]).astype(np.int64)
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return np.split(found[first], np.cumsum(np.bincount(owner[first], minlength=len(sizes)))[:-1])


def prefix(shingles):
    """The smallest of the ordered hashes: two sets of similarity ``SIMILAR`` share at least one of these."""
    return shingles[: len(shingles) - math.ceil(SIMILAR * len(shingles) - 1e-9) + 1]


def simhash(shingles: list) -> list[int]:
    """For each list of hashes: of each bit whether most of them have it. Bits are counted in parts, so long texts need no more room."""
    import numpy as np

    flat, sizes = np.concatenate(shingles), np.array([len(x) for x in shingles])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ones = np.zeros((len(sizes), BITS), dtype=np.int64)
    for at in range(0, len(flat), 65_536):
        bits = np.unpackbits(flat[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        mine = owner[at : at + 65_536]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        ones[mine[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.int64).ravel().tolist()


def _pieces(text: str, title: str | None, seeds: Seeds) -> tuple[str, list[str], list[list[str]]]:
    """The text in one form, its body's sentences in small letters without accents (tracebacks are left out), and the masked words of each."""
    text = _plain()(text)
    lines = body_lines(text, title, seeds.is_message)
    parts = sentences(without_tracebacks(lines)) or sentences(lines)
    low = unaccented("\n".join(parts).lower()).split("\n")
    return text, low, masked(low, title)


def judged(parts: list[str], words: list[list[str]], seeds: Seeds, latin: int) -> list[bool]:
    """Which sentences are sure; ``latin``: how many words are those of Latin fillers. The longest are asked first, and none is sure once others make up more than half of the words."""
    sizes = [len(w) for w in words]
    sure, other, n = [False] * len(parts), 0, sum(sizes)
    filled = latin >= 4 or any(len(set(w)) <= 4 <= len(w) for w in words)
    for i in sorted(range(len(parts)), key=lambda i: -sizes[i]):
        sure[i] = not sizes[i] or seeds.tells(parts[i]) or filled and is_filler(words[i]) and is_filler(WORD.findall(parts[i]))
        if not sure[i]:
            other += sizes[i]
            if 2 * other > n:
                return [False] * len(parts)
    return sure


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "title")


SCREENED = "doc_id bigint, label string, body string, simhash bigint, shingled bigint, prefix array<bigint>, told double, open array<bigint>"


def screen(docs: DataFrame, seeds: Seeds = SEEDS) -> DataFrame:
    """Of each text its trusted label, if any, and its body (see above); bodies are null where the text has no word."""

    def run(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), 500):
                out, words, sizes, opened, open_sizes = [], [], [], [], []
                for name, text, title in pdf.iloc[at : at + 500][["doc_id", "text", "title"]].itertuples(index=False):
                    text, parts, each = _pieces(text, title if isinstance(title, str) else None, seeds)
                    label = "placeholder" if has_placeholder(text) else None
                    flat = [w for x in each for w in x]
                    if not flat:
                        out.append([name, label, *[None] * 6])
                        continue
                    latin = sum(map(LATIN.__contains__, flat))
                    whole = (latin >= 0.8 * len(flat) or repeats(flat)) and is_filler(WORD.findall(" ".join(parts)))
                    sure = [True] * len(parts) if whole else judged(parts, each, seeds, latin)
                    left = [w for w, ok in zip(each, sure, strict=True) if w and not ok]
                    opened += left
                    open_sizes.append(len(left))
                    words += flat
                    sizes.append(len(flat))
                    out.append([name, label or (None if left else "whole"), "", None, None, None, 1 - sum(map(len, left)) / len(flat), None])
                if sizes:
                    hashes, counts = word_hashes(words), np.array(sizes)
                    shingles = shingle_hashes(hashes, counts)
                    marks = iter(zip(np.split(hashes, np.cumsum(counts)[:-1]), shingles, simhash(shingles), open_sizes, strict=True))
                    lengths = np.array([len(w) for w in opened], dtype=np.int64)
                    open_hashes = sequence_hashes(word_hashes([w for x in opened for w in x]), lengths) if opened else np.zeros(0, np.int64)
                    taken = 0
                    for row in out:
                        if row[2] is not None:
                            own, s, mark, n = next(marks)
                            row[2:6] = hashlib.md5(own.tobytes()).hexdigest(), mark, len(s), prefix(s)
                            row[7], taken = list(dict.fromkeys(open_hashes[taken : taken + n].tolist())), taken + n
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCREENED.split(", ")]).astype({"simhash": "Int64", "shingled": "Int64"})

    return _usable(docs).mapInPandas(run, SCREENED)


def with_shingles(bodies: DataFrame, docs: DataFrame, seeds: Seeds = SEEDS) -> DataFrame:
    """``body, shingles`` of bodies (``body, doc_id`` of one document that has it), made from its text again."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for body, text, title in pdf[["body", "text", "title"]].itertuples(index=False):
                words = [w for x in _pieces(text, title if isinstance(title, str) else None, seeds)[2] for w in x]
                rows.append((body, shingle_hashes(word_hashes(words), np.array([len(words)]))[0]))
            yield pd.DataFrame(rows, columns=["body", "shingles"])

    return _usable(docs).join(small(bodies.select("body", "doc_id")), "doc_id").select("body", "text", "title").mapInPandas(run, "body string, shingles array<bigint>")


def _tables(bodies: DataFrame) -> DataFrame:
    """A row for each body and table: the table's number with the value of its blocks."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    block = [F.shiftrightunsigned("simhash", edges[i]).bitwiseAND((1 << edges[i + 1] - edges[i]) - 1) for i in range(BLOCKS)]
    keys = [F.xxhash64(F.lit(t), *[block[i] for i in chosen]) for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS // 2))]
    return bodies.select("doc_id", "body", "simhash", F.explode(F.array(*keys)).alias("key"))


def _meet(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Join by a key: ``a`` is sent to the tasks if a count shows that it is small, else salted against hot keys of ``b``."""
    a = cut(a)
    if a.limit(FEW + 1).count() <= FEW:
        return b.join(F.broadcast(a), key)
    return b.withColumn("_salt", F.pmod(F.xxhash64("b_id"), F.lit(SALT))).join(a.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint")))), [key, "_salt"]).drop("_salt")


def candidates(some: DataFrame, others: DataFrame) -> DataFrame:
    """``a_id, b_id, a, b``: bodies that meet in a table of SimHash blocks and are near by Hamming distance."""
    a = _tables(some).toDF("a_id", "a", "a_hash", "key")
    b = _tables(others).toDF("b_id", "b", "b_hash", "key")
    near = (F.bit_count(F.col("a_hash").bitwiseXOR(F.col("b_hash"))) <= HAMMING) & (F.col("a") != F.col("b"))
    return _meet(a, b, "key").where(near).select("a_id", "b_id", "a", "b").distinct()


def sharing(some: DataFrame, others: DataFrame) -> DataFrame:
    """``a_id, b_id, a, b``: bodies that share a shingle of their prefixes and can be similar enough by their sizes and its places; every similar pair is among them."""
    a, b = (x.select(F.col("doc_id").alias(f"{n}_id"), F.col("body").alias(n), F.col("shingled").alias(f"{n}_size"), F.posexplode("prefix").alias(f"{n}_at", "shingle")) for x, n in ((some, "a"), (others, "b")))
    sizes = (F.col("a_size") >= SIMILAR * F.col("b_size") - 1e-6) & (F.col("b_size") >= SIMILAR * F.col("a_size") - 1e-6)
    # from the first shingle that both have, no more can be common than is left of either
    most = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    places = most * (1 + SIMILAR) >= SIMILAR * (F.col("a_size") + F.col("b_size")) - 1e-6
    return _meet(a, b, "shingle").where(sizes & places & (F.col("a_id") != F.col("b_id"))).select("a_id", "b_id", "a", "b").distinct()


def verified(met: DataFrame, shingled: DataFrame) -> DataFrame:
    """Those pairs of bodies whose shingles (``body, shingles``) are similar enough."""
    full = met.join(shingled.select(F.col("body").alias("a"), F.col("shingles").alias("sa")), "a").join(shingled.select(F.col("body").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.where(common >= SIMILAR * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(fresh: DataFrame, rest: DataFrame, docs: DataFrame, seeds: Seeds = SEEDS) -> DataFrame:
    """The bodies (``body``) of ``rest`` that are linked to one of ``fresh``, checked."""
    met = cut(candidates(fresh, rest).union(sharing(fresh, rest)).distinct())
    if not met.head(1):
        return rest.select("body").where("false")
    needed = met.select(F.explode(F.array(F.struct(F.col("a").alias("body"), F.col("a_id").alias("doc_id")), F.struct(F.col("b").alias("body"), F.col("b_id").alias("doc_id"))))).select("col.*").distinct()
    return cut(verified(met, cut(with_shingles(needed, docs, seeds))).select(F.col("b").alias("body")).distinct())


def in_company(rest: DataFrame, whole: DataFrame) -> DataFrame:
    """``sentence``: the open sentences that the company they keep shows to be residue. whole: the bodies labelled so far, with theirs."""
    half = rest.where("told >= 0.5").select("body", F.explode("open").alias("sentence"))
    asked = cut(half.select("sentence").unionByName(whole.select(F.explode("open").alias("sentence"))).distinct())
    if not asked.head(1):
        return asked
    key = F.broadcast(asked) if asked.limit(FEW + 1).count() <= FEW else asked
    opened = rest.select("body", (F.col("told") >= 0.5).alias("with"), F.size("open").alias("n"), F.explode("open").alias("sentence"))
    beside = opened.unionByName(whole.select("body", F.lit(True).alias("with"), F.size("open").alias("n"), F.explode("open").alias("sentence")))
    held = cut(beside.join(key, "sentence"))
    enough = held.where("with").groupBy("sentence").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMPANY).select("sentence")
    held = cut(held.join(small(enough, FEW), "sentence", "left_semi"))
    while True:  # each time sentences are dropped, so it ends
        covered = held.groupBy("body").agg(F.count(F.lit(1)).alias("c"))
        sides = held.join(covered, "body").groupBy("sentence").agg(F.count_if("with").alias("with"), F.count_if((F.col("c") < F.col("n")) & ~F.col("with")).alias("apart"))
        apart = cut(sides.where(F.col("apart") > F.col("with")).select("sentence"))
        if not apart.head(1):
            return held.select("sentence").distinct()
        held = cut(held.join(small(apart, FEW), "sentence", "left_anti"))


def settle(rest: DataFrame, known: DataFrame) -> DataFrame:
    """``rest`` with the sentences of ``known`` no longer open. Only bodies that hold one move."""
    key = F.broadcast(known) if known.limit(FEW + 1).count() <= FEW else known
    hit = rest.select("body", F.explode("open").alias("sentence")).join(key, "sentence").groupBy("body").agg(F.collect_set("sentence").alias("_known"))
    joined = rest.join(small(hit, FEW), "body", "left")
    left = F.when(F.col("_known").isNull(), F.col("open")).otherwise(F.array_except("open", "_known"))
    # the closed ones count by their number among the open ones, the masked words not being at hand
    told = F.when(F.col("_known").isNull() | (F.size("open") == 0), F.col("told")).otherwise(1 - (1 - F.col("told")) * F.size(left) / F.size("open"))
    return joined.withColumns({"told": told, "open": left}).drop("_known")


def residue(docs: DataFrame, seeds: Seeds = SEEDS) -> DataFrame:
    """``doc_id, label``: ``placeholder``, ``whole`` or, of documents linked to those, ``linked``."""
    screened = cut(screen(docs, seeds))
    bodies = cut(
        screened.where(F.col("body").isNotNull()).groupBy("body").agg(
            F.min("simhash").alias("simhash"), F.min("doc_id").alias("doc_id"), F.min("shingled").alias("shingled"), F.first("prefix").alias("prefix"), F.min("told").alias("told"), F.first("open").alias("open")
        )
    )
    trusted = F.size("open") == 0
    fresh, rest = bodies.where(trusted), bodies.where(~trusted)
    linked, whole = None, fresh
    while fresh.head(1):  # each round labels at least one body more, so it ends; in practice after as many as the longest chain of links
        first = fresh.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"))
        leaders = fresh.join(first, ["simhash", "doc_id"], "left_semi")
        found = near_duplicates(leaders, rest, docs, seeds)
        others = fresh.join(first, ["simhash", "doc_id"], "left_anti")
        if others.head(1):
            found = found.unionByName(near_duplicates(others, rest.join(found, "body", "left_anti"), docs, seeds))
        found = small(found)
        near, after = rest.join(found, "body", "left_semi"), rest.join(found, "body", "left_anti")
        told = cut(in_company(after, near))
        if told.head(1):
            after = cut(settle(after, told))
        fresh = cut(near.unionByName(after.where(trusted)))
        rest = after.where(~trusted)
        linked = fresh.select("body") if linked is None else linked.unionByName(fresh.select("body"))
    own = screened.where(F.col("label").isNotNull()).select("doc_id", "label")
    if linked is None:
        return own
    reached = screened.where(F.col("label").isNull() & F.col("body").isNotNull()).join(small(linked.distinct()), "body", "left_semi")
    return own.unionByName(reached.select("doc_id", F.lit("linked").alias("label")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents without residue."""
    return docs.join(residue(docs).select("doc_id").distinct(), "doc_id", "left_anti")

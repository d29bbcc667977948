"""Token ids of a public byte-level BPE tokenizer, by dynamic programming over prefixes.

A text is cut into pieces by the tokenizer's pattern. Of every prefix of a piece, BPE's encoding has one last token. It is
found left to right: the automaton of all tokens, with its suffix links, names the tokens that end at a position; of these
exactly one is compatible with the last token of the prefix before it, that is, BPE would leave this pair of tokens side by
side. The stored last tokens, followed back from the end, are the encoding: exact, and in time proportional to the length
however long a piece is.

Null and empty texts give an empty list. Strings of special tokens are ordinary text. Each distinct short piece is encoded
once per worker (the store is emptied when it is full, which changes nothing in the result).
"""

from __future__ import annotations

import json
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public tokenizers' vocabulary files are; only ever read from there.
TOKENIZERS = "/opt/tokenizers"
DEFAULT = "byte_bpe_50k.json"
#: Fixed value: the pattern of the tokenizer's pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STORE = 300_000
LONG = 64


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Exact BPE without merging: see the module."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, byte = model["vocab"], byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a token's number here is its place in the order of merges: bytes first
        order = [*byte, *(a + b for a, b in merges)]
        number: dict[str, int] = {}
        for i, token in enumerate(order):
            number.setdefault(token, i)
        self.id_of = [vocabulary[t] for t in order]
        self.made: dict[tuple[int, int], int] = {}
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        for i, (a, b) in enumerate(merges, len(byte)):
            if number[a + b] == i:
                self.left[i], self.right[i] = number[a], number[b]
            self.made.setdefault((number[a], number[b]), i)
        self.automaton = ahocorasick.Automaton()
        for token, i in number.items():
            raw = "".join(chr(byte[c]) for c in token)
            self.automaton.add_word(raw, (len(raw), i))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b after token a.

        Undo the latest merge of either side, again and again. At each step the two parts at the border stood side by side
        until the earlier of the merges undone; a merge across the border that comes before that would have happened.
        """
        if (seen := self.pairs.get((a, b))) is not None:
            return seen
        key, until, fine = (a, b), len(self.id_of), None
        while fine is None:
            if self.made.get((a, b), until) < until:
                fine = False
            elif a > b and self.right[a] != a:
                until, a = a, self.right[a]
            elif self.left[b] != b:
                # of equal merges the one on the left happens first: a part on the right lasts through its own number
                until, b = b + 1, self.left[b]
            elif self.right[a] != a:
                until, a = a, self.right[a]
            else:
                fine = True
        if len(self.pairs) > 4 * STORE:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8").decode("latin-1")
        last = [-1] * (len(raw) + 1)
        step = [0] * (len(raw) + 1)
        for end, (length, token) in self.automaton.iter(raw):
            to, start = end + 1, end + 1 - length
            if last[to] < 0 and (start == 0 or last[start] >= 0 and self.compatible(last[start], token)):
                last[to], step[to] = token, length
        out, at = [], len(raw)
        while at:
            out.append(self.id_of[last[at]])
            at -= step[at]
        out.reverse()
        return out

    def __call__(self, text: str | None) -> list[int]:
        ids: list[int] = []
        known = self.known
        for piece in self.split(text or ""):
            got = known.get(piece)
            if got is None:
                got = self.piece(piece)
                if len(piece) <= LONG:
                    if len(known) >= STORE:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    """One encoder per worker process and vocabulary."""
    return PrefixEncoder(path)


def encode(docs: DataFrame, keep: list[str], text: str = "text", ids: str = "ids", vocabulary: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """The columns to keep and each text's token ids."""
    return _arrow(docs, keep, text, ids, vocabulary, False)


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", name: str = "tokens", vocabulary: str = f"{TOKENIZERS}/{DEFAULT}") -> DataFrame:
    """The columns to keep and each text's number of tokens."""
    return _arrow(docs, keep, text, name, vocabulary, True)


def _arrow(docs: DataFrame, keep: list[str], text: str, new: str, vocabulary: str, only_count: bool) -> DataFrame:
    kinds = {f.name: f for f in docs.schema.fields}
    need = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # a batch's ids are small beside its texts, but not for all rows at once
                part = batch.slice(at, 1000)
                lists = [enc(t) for t in part.column(len(keep)).to_pylist()]
                sizes = np.array([len(x) for x in lists], dtype=np.int64)
                if only_count:
                    made = pa.array(sizes)
                else:
                    offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                    np.cumsum(sizes, out=offsets[1:])
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array([i for x in lists for i in x], pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], made], names=[*keep, new])

    from pyspark.sql import types as T

    schema = T.StructType([*[kinds[c] for c in keep], T.StructField(new, T.LongType() if only_count else T.ArrayType(T.IntegerType()))])
    return need.mapInArrow(run, schema)

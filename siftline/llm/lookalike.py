"""Text that looks ordinary but is stored in other characters, brought to one form.

*Strings and code points* that look alike are joined by union-find, transitively: a character of another width or
presentation form with what it stands for, a letter and its detached accent with the composed letter, invisible characters
with nothing, spaces with the plain space (all from the Unicode data), letters of other scripts with the Latin letters they
imitate, and Latin letters of one shape with each other (capital i and small l, o and O, ...). A multi-pattern automaton over
all of these rewrites every text greedily, always at the leftmost longest match.

The representative of an imitating letter is chosen by frequency. Of each different word that mixes it with Latin letters, the
words are made that come of putting the class's Latin members in its place; the member whose words are most frequent in the
corpus stands for the letter (ties: the letter's own shape). A letter that no class holds is learnt in the same way from all
Latin letters: if at least ``SUPPORT`` words of four letters or more point to one with a share of ``SHARE``, it joins its class.

Letters of other scripts are only rewritten inside a word that holds Latin letters; words wholly in another script stay.
Composed accents, quotation marks and dashes of any shape, ``×`` and ``°`` stay.

Null texts give no row; empty texts and texts of plain ASCII are unchanged (no pattern is ASCII, so those never reach
Python). Null list elements keep their position.
"""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
from collections import defaultdict
from functools import lru_cache
from itertools import chain, starmap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.plans.shared import cut

#: Letters of other scripts and the Latin letters they imitate.
IMITATIONS = {
    "Cyrillic": ("аеорсухіјѕһԛԝӏвкмнтАВЕКМНОРСТУХІЈЅԚԜӀҮүԁѡԍѵԌѴ", "aeopcyxijshqwlbkmhtABEKMHOPCTYXIJSQWIYydwGvGV"),
    "Greek": ("αονρικυτγχηΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳϲϹΓ", "aovpikutyxnABEZHIKMNOPTYXjcCr"),
    "Armenian": ("օսոհցգՕՍԼ", "ounhgqOUL"),
    "Coptic": ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲨⲟⲣⲥ", "BHIKMNOPCTXYopc"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiyAJEWMHYGhZbRWSVSLCPKdGB"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Canadian": ("ᐯᑌᑭᑯᑕᒍᒪᕼᖇᗅᗞᗰᗷ᙭", "VUPdCJLHRADMBX"),
    "Latin": ("ıɑɡ", "iag"),
}
#: Latin letters of one shape. Fixed values.
SHAPES = ("Il", "Oo", "Cc", "Ss", "Vv", "Ww", "Xx", "Zz", "Uu")
SUPPORT, SHARE = 3, 0.8
#: Code points beyond ASCII but for plain ideographs, Hangul syllables and what is private or not given. Fixed values.
BLOCKS = ((0x80, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200))
#: Compatibility decompositions that are another width or presentation form of a letter, digit or sign.
FORMS = ("<wide>", "<narrow>", "<font>", "<small>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<circle>")
#: Invisible besides the characters of category Cf.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
#: Accents are these marks; other scripts need theirs.
ACCENT = re.compile("[̀-ͯ᪰-᫿᷀-᷿]")
LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ]")
#: Letters beyond Latin that a word can be mixed with (alphabets and syllabaries before the ideographs, and those after them).
FOREIGN = re.compile("[ɐ-ʯͰ-᷿Ⰰ-⷟꓀-ꭿ\U00010000-\U0001efff\u2160-\u2188]")
WORD = re.compile(r"[^\W_]+(?:[̀-ͯ][^\W_]*)*")


class UnionFind:
    """Classes of strings; every string belongs to itself until joined."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.up[self.find(a)] = self.find(b)

    def classes(self) -> dict[str, list[str]]:
        out = defaultdict(list)
        for x in sorted(self.up):
            out[self.find(x)].append(x)
        return out


def _quote_or_dash(text: str) -> bool:
    return all(unicodedata.category(c) in ("Pd", "Pi", "Pf") or c in "\"'`-´" or "QUOTATION" in unicodedata.name(c, "") for c in text)


@lru_cache(1)
def edges() -> tuple[dict[str, str], dict[str, str]]:
    """Pairs (string, what it looks like): those that hold anywhere, and letters of other scripts."""
    anywhere: dict[str, str] = {}
    forms: dict[str, str] = {}
    for code in chain.from_iterable(starmap(range, BLOCKS)):
        c = chr(code)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if category in ("Cf", "Cc") and c != "\u0085" or c in INVISIBLE:
            anywhere[c] = ""
        elif category in ("Zs", "Zl", "Zp") or c == "\u0085":
            anywhere[c] = " "
        elif decomposition := unicodedata.decomposition(c):
            plain = unicodedata.normalize("NFKC", c)
            tag = decomposition.split(" ")[0]
            joined = tag == "<compat>" and len(plain) > 1 and all(x.isalpha() for x in plain) and 0xFB00 <= code <= 0xFDFF
            if (tag in FORMS or joined or tag == "<compat>" and 0xFB00 <= code <= 0xFDFF) and plain != c and not _quote_or_dash(plain):
                anywhere[c] = plain
            elif "<" not in tag:
                composed = unicodedata.normalize("NFC", c)
                if composed != c:
                    if len(composed) == 1:  # a sign that stands for a letter, as that of kelvin
                        anywhere[c] = composed
                else:  # the letter with its accents apart
                    apart = unicodedata.normalize("NFD", c)
                    if ACCENT.search(apart):
                        anywhere[apart] = c
                        if len(two := unicodedata.normalize("NFC", apart[:-1]) + apart[-1]) < len(apart):
                            anywhere[two] = c
            elif tag == "<compat>" and len(plain) == 1 and plain in string.ascii_letters and c != "ſ":
                forms[c] = plain  # as the small roman numeral fifty
        elif (name := unicodedata.name(c, "")).startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28 and code >= 0x1D00:
            forms[c] = name[-1].lower()
    return anywhere, forms | {a: b for other, latin in IMITATIONS.values() for a, b in zip(other, latin, strict=True)}


@lru_cache(1)
def admissible() -> dict[str, tuple[str, ...]]:
    """For each imitating letter the Latin letters of its class, its own shape first."""
    anywhere, imitated = edges()
    joined = UnionFind()
    for a, b in (*anywhere.items(), *imitated.items(), *map(tuple, SHAPES)):
        joined.join(a, b)
    out = {}
    for group in joined.classes().values():
        latin = [x for x in group if len(x) == 1 and x in string.ascii_letters]
        out |= {x: tuple(sorted(latin, key=lambda y, x=x: (y != imitated[x], y))) for x in group if x in imitated}
    return out


def mixed_words(texts: DataFrame, column: str) -> DataFrame:
    """``word``: the different words of Latin and other letters."""
    plain, _ = edges()
    hidden = re.compile("[" + "".join(re.escape(c) for c, new in plain.items() if len(c) == 1 and new == "") + "]")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = set()
            for text in pdf[column]:
                if FOREIGN.search(text):
                    found.update(w for w in WORD.findall(hidden.sub("", text)) if FOREIGN.search(w) and LATIN.search(w))
            yield pd.DataFrame({"word": list(found)}).astype({"word": "object"})

    return texts.select(column).where(F.col(column).rlike(r"[^\x00-\x{24f}]")).mapInPandas(run, "word string").distinct()


def meant(words: DataFrame) -> DataFrame:
    """``letter, latin, made, word``: for each other letter of a mixed word, each Latin letter it may stand for and the word that makes."""

    def run(batches):
        import pandas as pd

        known = admissible()
        for pdf in batches:
            rows = []
            for word in pdf["word"]:
                for letter in set(FOREIGN.findall(word)):
                    if letter not in known and (len(word) < 4 or unicodedata.category(letter) == "Lm"):
                        continue
                    some = known.get(letter) or (string.ascii_lowercase if letter.islower() else string.ascii_uppercase if letter.isupper() else string.ascii_letters)
                    rest = "".join(known[c][0] if c != letter and c in known else c for c in word)
                    rows += [(letter, x, made, word) for x in some if LATIN.search(made := rest.replace(letter, x)) and not FOREIGN.search(made)]
            yield pd.DataFrame(rows, columns=["letter", "latin", "made", "word"])

    return words.mapInPandas(run, "letter string, latin string, made string, word string")


def votes(texts: DataFrame, column: str) -> dict[tuple[str, str], tuple[int, int]]:
    """For each imitating letter and Latin letter how often the words it would make occur in the corpus, and how many of its words those are.

    At most 52 for each code point, whatever the corpus. The corpus is read again for the words made, and only if there are any.
    """
    asked = cut(meant(mixed_words(texts, column)))
    if not asked.head(1):
        return {}
    made = asked.select("made").distinct()
    key = F.broadcast(made) if made.limit(200_001).count() <= 200_000 else made
    held = texts.select(F.explode(F.split(column, r"[^\p{L}]+")).alias("made")).join(key, "made").groupBy("made").agg(F.count(F.lit(1)).alias("n"))
    counted = asked.join(held, "made").groupBy("letter", "latin").agg(F.sum("n").alias("n"), F.countDistinct("word").alias("words"))
    return {(r.letter, r.latin): (r.n, r.words) for r in counted.toLocalIterator()}


def representatives(counts: dict[tuple[str, str], tuple[int, int]]) -> tuple[dict[str, str], dict[str, str]]:
    """The rewriting of each string: anywhere, and inside words of Latin letters."""
    anywhere, imitated = edges()
    inside = {x: max(some, key=lambda y: counts.get((x, y), (0, 0))[0]) for x, some in admissible().items()}  # the first of equals is its own shape
    unknown = defaultdict(dict)
    for (letter, latin), (n, words) in counts.items():
        if letter not in imitated and letter not in anywhere and words >= SUPPORT:
            unknown[letter][latin] = n
    for letter, some in unknown.items():
        best = min(some, key=lambda y: (-some[y], y))
        if some[best] >= SHARE * sum(n for (x, _), (n, _) in counts.items() if x == letter):
            inside[letter] = best
    return anywhere, inside


class Rewriter:
    """The automaton over all strings that may be rewritten; some only inside words that hold Latin letters."""

    def __init__(self, anywhere: dict[str, str], inside: dict[str, str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for a, b in inside.items():
            self.automaton.add_word(a, (len(a), b, True))
        for a, b in anywhere.items():
            self.automaton.add_word(a, (len(a), b, False))
        self.automaton.make_automaton()
        #: Every pattern holds one of these: it is one of them, or ends in an accent.
        self.odd = {a[-1] for a in (*anywhere, *inside)}
        self.stands = {a: b for a, b in anywhere.items() if len(a) == 1 and (not b or b[0].isalpha())}
        self.inside = inside

    def _in_word(self, c: str) -> bool:
        return c.isalpha() or c in self.stands or c in self.inside or "\u0300" <= c <= "\u036f"

    def _word(self, text: str, at: int) -> tuple[int, bool]:
        """Where the word at a place ends, and whether it holds a Latin letter, in whatever form."""
        first, last = at, at
        while first and self._in_word(text[first - 1]):
            first -= 1
        while last + 1 < len(text) and self._in_word(text[last + 1]):
            last += 1
        word = text[first : last + 1]
        return last, bool(LATIN.search(word)) or any(LATIN.match(self.stands.get(c, "")) for c in word)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        if not self.odd.isdisjoint(text):
            parts, at, until, mixed = [], 0, -1, False
            for end, (length, new, within) in self.automaton.iter_long(text):
                if within or new in self.inside:  # an imitating letter may itself stand in another form
                    if end > until:
                        until, mixed = self._word(text, end)
                    if within and not mixed:
                        continue
                    new = self.inside[new] if mixed and not within else new
                parts += (text[at : end - length + 1], new)
                at = end + 1
            text = "".join(parts) + text[at:]
        if ACCENT.search(text):  # accents that no single composed letter holds, in any order
            text = unicodedata.normalize("NFC", text)
        return text


_REWRITERS: dict[str, Rewriter] = {}


def pieces(rows: DataFrame) -> DataFrame:
    """Titles and single candidates of raw rows: ``id, field, cand_pos, text``."""
    title = F.struct(F.lit("title").alias("field"), F.lit(-1).cast("bigint").alias("cand_pos"), F.col("title").alias("text"))
    listed = F.transform("candidates", lambda t, i: F.struct(F.lit("candidates").alias("field"), i.cast("bigint").alias("cand_pos"), t.alias("text")))
    both = F.concat(F.array(title), F.coalesce(listed, F.array().cast("array<struct<field:string,cand_pos:bigint,text:string>>")))
    return rows.select("id", F.inline(both)).where(F.col("text").isNotNull())


def rewrite(texts: DataFrame, column: str, new: str = "rewritten") -> DataFrame:
    """The rows whose text isn't plain ASCII, each with its text in one consistent form."""
    tables, key = texts.sparkSession.sparkContext.broadcast(representatives(votes(texts, column))), uuid.uuid4().hex
    odd = texts.where(F.col(column).rlike(r"[^\x00-\x7f]"))

    @F.pandas_udf("string")
    def apply(values):
        if key not in _REWRITERS:
            _REWRITERS.clear()
            _REWRITERS[key] = Rewriter(*tables.value)
        return values.map(_REWRITERS[key], na_action="ignore")

    return odd.withColumn(new, apply(column))


def find(rows: DataFrame) -> DataFrame:
    """Titles and candidates that the rewriting changes, or that keep an accent for which no composed letter exists."""
    done = rewrite(pieces(rows), "text")
    changed = (F.col("rewritten") != F.col("text")) | F.col("rewritten").rlike(r"\p{L}[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff]")
    return done.where(changed).select("id", "field", "cand_pos")


def normalise(rows: DataFrame) -> DataFrame:
    """All titles and candidates in one form: ``id, field, cand_pos, text, changed``."""
    every = pieces(rows)
    done = rewrite(every, "text").select("id", "field", "cand_pos", F.col("rewritten").alias("text"), (F.col("rewritten") != F.col("text")).alias("changed"))
    plain = every.where(~F.col("text").rlike(r"[^\x00-\x7f]")).withColumn("changed", F.lit(False))
    return done.unionByName(plain)

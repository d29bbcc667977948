"""Text functions as column expressions, all inside the JVM.

Unicode rules are those of Python's ``\\w``, ``\\s`` and ``strip``; letter case is folded with ``lower``.
A null stays null; a null list element counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"
#: Headings that are boilerplate.
BOILERPLATE = ("vte", "v t e", "v\nt\ne", "external links", "references", "see also", "notes")
#: Markers of an introduction, and verbs of a statement.
INTRO_MARKERS = ("including", "include", "includes", "such as", "the following", "for example")
FACT_VERBS = (" is ", " was ", " are ", " were ", " has ", " had ", " consists ")
#: Types of headings, and types that go together.
HEADER_TYPES = ("list_definition", "section", "header")
LIST_OR_TABLE = ("list", "table")
#: Stop words of the analyzer.
STOPWORDS = "a an and are as at be by for from in is it of on or that the to was were with".split()
ASCII_TOKEN = r"[A-Za-z0-9]+(?:['-][A-Za-z0-9]+)?"
#: Endings the stemmer replaces, in this order.
ENDINGS = (("ies", "y"), ("ing", ""), ("edly", ""), ("ed", ""), ("ers", "er"), ("es", ""), ("s", ""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def normalize(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def optional(text: Column) -> Column:
    """Stripped; blank is null."""
    return F.nullif(strip(text), F.lit(""))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def first_words(text: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def tokens_lower(text: Column) -> Column:
    """Unicode words in one letter case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def stem(token: Column) -> Column:
    chain = F.when((F.length(token) <= 4) | token.rlike(r"^\d+$"), token)
    for ending, new in ENDINGS:
        fits = token.endswith(ending) & (F.length(token) - len(ending) >= 3)
        chain = chain.when(fits, F.concat(F.left(token, F.length(token) - len(ending)), F.lit(new)))
    return chain.otherwise(token)


def analyze(text: Column, analyzer: str = "regex_stem_stop") -> Column:
    """The tokens of one of four analyzers."""
    if analyzer == "whitespace":
        return words(F.lower(text))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(ASCII_TOKEN), 0), F.lower)
    if analyzer in ("regex_stem", "regex_stem_stop"):
        tokens = F.transform(tokens, stem)
    if analyzer == "regex_stem_stop":
        tokens = F.filter(tokens, lambda t: ~t.isin(STOPWORDS))
    return F.filter(tokens, lambda t: t != "")


def is_boilerplate(normalized: Column) -> Column:
    return F.lower(normalized).isin(*BOILERPLATE) | (F.length(normalized) <= 2)


def _any(text: Column, markers) -> Column:
    test = F.lit(False)
    for m in markers:
        test = test | F.contains(text, F.lit(m))
    return test


def is_intro(normalized: Column) -> Column:
    low = F.lower(normalized)
    return low.endswith(":") | ((token_count(low) <= 40) & _any(low, INTRO_MARKERS))


def is_intro_by_words(normalized: Column) -> Column:
    """As :func:`is_intro`, its length in words between white space."""
    low = F.lower(normalized)
    return low.endswith(":") | ((F.size(words(low)) <= 40) & _any(low, INTRO_MARKERS))


def is_intro_fragment(text: Column) -> Column:
    """The audit's form: a marker counts only before a final stop or colon."""
    return text.endswith(":") | (_any(F.lower(text), INTRO_MARKERS) & text.endswith("."))


def is_followup_fragment(text: Column) -> Column:
    return F.contains(text, F.lit("\n")) | F.size(words(text)).between(1, 16)


def is_fact(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return (token_count(text) >= 8) & _any(padded, FACT_VERBS) & text.rlike(r"[.!?][\s]*$")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def first_sentence(text: Column) -> Column:
    """The shortest start that ends in a stop before white space or the end; else everything."""
    found = F.regexp_extract(text, r"(?U)([^\n]+?[.!?])(?:\s|$)", 1)
    return strip(F.when(found != "", found).otherwise(text))


def display(text: Column, width: int = 220) -> Column:
    flat = normalize(text)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.left(flat, F.lit(width)), F.lit("...")))


def safe_url(url: Column) -> Column:
    """Scheme, host, port and path of a URL, without user, query and fragment."""
    return F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^?#]*)", 1))

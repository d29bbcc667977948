from __future__ import annotations

import pytest

from siftline.llm import lookalike as L

ROWS = "id string, title string, candidates array<string>, field string"


@pytest.fixture(scope="module")
def rewriter():
    return L.Rewriter(*L.representatives({}))


@pytest.mark.parametrize(
    "odd, plain",
    [
        ("onlу 719", "only 719"), ("ｄｉｓｔｒｉｃｔ， １２", "district, 12"), ("e\u0301te\u0301", "\u00e9t\u00e9"), ("a\u00a0b\u2003c\u3000d", "a b c d"), ("coun\ufeffcil s\u00ado", "council so"), ("Wenﬆow ﬁn", "Wenstow fin"), ("Kelvin", "Kelvin"),
        ("Кesѕamar", "Kessamar"), ("Μusic", "Music"),
    ],
)
def test_odd_forms(rewriter, odd, plain):
    assert rewriter(odd) == plain


@pytest.mark.parametrize("text", ["Corvíster Übung façade naïve", "Лимордия", "γή", "“x” ‘y’ „z“ – — ― «»", "12 × 40 at 51° north", "plain ascii\n\ttext", "", "港の灯台"])
def test_what_stays(rewriter, text):
    assert rewriter(text) == text


def test_rewriting_is_stable(rewriter):
    for odd in L.edges()[0]:
        once = rewriter(f"a{odd}b")
        assert rewriter(once) == once


def test_classes_are_transitive():
    u = L.UnionFind()
    u.join("a", "b")
    u.join("b", "c")
    u.join("x", "y")
    assert u.find("a") == u.find("c") != u.find("x")
    assert sorted(map(sorted, u.classes().values())) == [["a", "b", "c"], ["x", "y"]]


def test_other_scripts_and_forms(rewriter):
    odd = "Ꭰog ꓡondon ⅼetter ⅰdea ᴄat ԁog ѡater Ԍreat ѵery Ꮪchool ᑭark ⲟld ｈеllo Ꮯity ꓚity ᗷook ᕼouse ᖇoad Ⲃook Ꮮake ꓠorth ꓪest cl\u200bоud ᴠan ꜱun"
    plain = "Dog London letter idea cat dog water Great very School Park old hello City City Book House Road Book Lake North West cloud van sun"
    assert [rewriter(w) for w in odd.split()] == plain.split()
    for word in ("привет", "ΑΒΓ", "ᎠᎡᎢ", "β-carotene", "ⅻ", "Δt", "µm"):
        assert rewriter(word) == word


def texts(spark, *values):
    return spark.createDataFrame([(str(i), t, None, None) for i, t in enumerate(values)], ROWS)


@pytest.mark.parametrize("more, stands", [("london", "london"), ("Iondon", "Iondon")])
def test_counts_of_the_corpus_choose_the_representative(spark, more, stands):
    """One letter looks like capital i and like small l; the word that the corpus holds more often decides."""
    df = texts(spark, "the city of Ӏondon", "london", "Iondon", *[f"to {more} again"] * 3)
    got = {r.id: r.text for r in L.normalise(df).where("field = 'title'").collect()}
    assert got["0"] == f"the city of {stands}"


def test_letters_that_no_class_holds_are_learnt_from_words(spark):
    """Three words with one strange letter make words that the corpus knows; another strange letter has no support and stays."""
    df = texts(spark, "the riꓤer", "oꓤer seven bridges", "in ꓤ silꓤer dish", "a river of silver over all", "the тꓵo", "two")
    got = {r.id: r.text for r in L.normalise(df).where("field = 'title'").collect()}
    assert got["0"] == "the river" and got["1"] == "over seven bridges" and got["2"] == "in ꓤ silver dish"
    assert {r.id for r in L.find(df).collect()} == {"0", "1", "2", "4"}  # т imitates t


def test_find_and_normalise(spark):
    rows = [("r1", "Ｔitle", ["plain", None, "e\u0301te\u0301", "", "x\u200b"], "f"), ("r2", None, None, "f"), ("r3", "fine", [], None), ("r4", "x\u0302", ["e\u0301" * 50_000 + " "], None)]
    df = spark.createDataFrame(rows, ROWS)
    got = {tuple(r) for r in L.find(df).collect()}
    assert got == {("r1", "title", -1), ("r1", "candidates", 2), ("r1", "candidates", 4), ("r4", "title", -1), ("r4", "candidates", 0)}
    norm = {(r.id, r.field, r.cand_pos): (r.text, r.changed) for r in L.normalise(df).collect()}
    assert norm["r1", "title", -1] == ("Title", True) and norm["r1", "candidates", 3] == ("", False) and norm["r3", "title", -1] == ("fine", False)
    assert len(norm) == 8
    assert L.find(df.where("false")).count() == 0

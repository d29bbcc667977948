from __future__ import annotations

import pytest

from siftline.llm import residue as R
from siftline.llm import residue_seeds as S

ART = "The old tower of Selholm was repaired in 1802 by the council, and most visitors came from the coast to see it in summer."


@pytest.mark.parametrize(
    "text",
    [
        f"{ART} It was built by {{{{author}}}} in the north.", "Built in ${YEAR} by hand.", "It lies near [insert city name here] and the sea.", "The name <year goes here> is old.", "Near @@first_name@@ and %(author)s.",
        "From __CITY_NAME__ or *|place|* it came.", "At {% block title %} it ends.", "[date einfügen] war es alt.", "By [TBD: caption] and [[TODO item count]].", "It has [[CAPTION]] and &ITEM_COUNT; parts.", "Only {TITLE} of $ORG_NAME$ remained.",
    ],
)
def test_placeholders(text):
    assert S.has_placeholder(text)


@pytest.mark.parametrize(
    "text",
    [
        "A variable is written `{{ name }}` and is replaced when the page is built.", 'Tags such as "<%= author %>" and "%DATE%" were filled in.', "The line ```const row = `${city}: ${count}`;``` is an example.", "See [[Selholm]] and [[Drask|the mortar]].",
        "Let $x$ be the length and {0, 1, 2} the set.", "Sets, as in {12, 40} or {oak, elm}.", 'printf("%s is %d years old", name, age)', "[question] what is it\n[answer] a tower", "50% of all and 20% more", ART, "def f(x):\n    return {}[x]",
    ],
)
def test_no_placeholders(text):
    assert not S.has_placeholder(text)


@pytest.mark.parametrize(
    "text",
    [
        "You need to enable JavaScript to run this app.", "Home | News | Shop\nSelholm\n404 - Page not found. The page you asked for at a.example may have been moved or deleted.\n© 2014 Selholm House", "Lorem ipsum dolor sit amet, consectetur elit.",
        "dummy content. dummy content. dummy content. dummy content.", "asdf asdf asdf asdf", "Veuillez activer JavaScript pour afficher cette page.", "Access denied. You do not have permission to view \"X\" on this server. Reference #2baa9a2e60 Too many requests.",
        "Traceback (most recent call last):\n  File \"/srv/a.py\", line 3, in show\nKeyError: 'a'", "LOADING... IF NOTHING APPEARS, CHECK THAT SCRIPTING IS ALLOWED FOR A.EXAMPLE.",
    ],
)
def test_whole_residue(text):
    assert S.is_whole_residue(S.body_lines(text, "Selholm"))


@pytest.mark.parametrize(
    "text",
    [ART, "The guild teaches JavaScript to sailors at Selholm; scripts must be enabled in the first lesson.", "Room 404 of the tower was not found by farmers until 1654.", "The words lorem and ipsum, used by printers at Selholm as filler, were set in lead.", "Access to the tower was denied to masons in 1759, and the service was unavailable for 33 days.", "港の灯台は1876年に建てられた。", "   "],
)
def test_articles_are_kept(text):
    assert not S.is_whole_residue(S.body_lines(text, None))


DOCS = "doc_id bigint, text string, title string, label string"


def test_labels_spread_over_near_duplicates(spark):
    notice = "Error 503: the server could not complete your request. Please try again in 4 minutes."
    # a chain: each document shares most of its shingles with the one before, only the first is known
    w = [f"strange{i}" for i in range(60)]
    long = " ".join(w)
    docs = [
        (1, notice, None, "x"), (2, notice.replace("4", "9"), None, None), (3, ART, None, None), (4, None, None, None), (5, " \n", None, None), (6, "", None, None), (7, long, None, None), (8, long + " tail", None, None), (9, f"{ART} See ${{YEAR}}.", None, None), (10, f"{ART} See", None, None),
    ]
    got = {r.doc_id: r.label for r in R.residue(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {1: "whole", 2: "whole", 9: "placeholder"}
    assert {r.doc_id for r in R.clean(spark.createDataFrame(docs, DOCS)).collect()} == {3, 4, 5, 6, 7, 8, 10}


def test_links_are_verified(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    texts = {"a": words, "near": [*words[:398], "x", "y"], "half": words[:200] + [f"zed{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]}
    docs = spark.createDataFrame([(i, " ".join(w), None, None) for i, w in enumerate(texts.values())], DOCS)
    names = dict(enumerate(texts))
    bodies = R.screen(docs).select("body", "simhash", "doc_id")
    key = {r.body: names[r.doc_id] for r in bodies.collect()}
    met = {(key[r.a], key[r.b]) for r in R.candidates(bodies.where("doc_id = 0"), bodies.where("doc_id > 0")).collect()}
    assert ("a", "near") in met
    every = bodies.where("doc_id = 0").selectExpr("body a").crossJoin(bodies.where("doc_id > 0").selectExpr("body b"))
    assert [(key[r.a], key[r.b]) for r in R.verified(every, R.with_shingles(bodies, docs)).collect()] == [("a", "near")]


def test_propagation_through_a_chain(spark):
    sentences = [
        "This is a sample paragraph.", "Your story starts here; edit or delete this block.", "Placeholder copy for the layout.", "This text will be replaced before the launch.", "Write something about yourself.", "Replace it with your own words.",
        "Please enable JavaScript in your browser to view the whole of this long page.", "We are down for planned maintenance and will be back soon.", "Thank you for your patience.", "Your session has expired.", "Log in again to continue to the tower.",
        "Too many requests.", "You have been blocked for a short while.", "The page you asked for at the tower may have been moved or deleted.", "Please try again in 4 minutes.", "Access denied.", "Sorry, this content is not available in your region.",
    ]
    known = " ".join(sentences + sentences[::-1] + sentences[::2] + sentences[1::2])
    docs = [(1, known, None, None), (2, known + " A tower stands.", None, None), (3, ART, None, None)]
    got = {r.doc_id: r.label for r in R.residue(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] == "whole" and got.get(2) == "linked" and 3 not in got


def test_empty_table(spark):
    assert R.residue(spark.createDataFrame([], DOCS)).count() == 0


def filler(rng, size=200):
    """A text of which just enough is Latin filler, and one that has four words less of it and shares 176 of 216 shingles."""
    latin = sorted(S.LATIN)
    other = ["".join(rng.choice(list("bcdfghkz"), 9)) for _ in range(size // 5 + 4)]
    words = [str(w) for w in rng.choice(latin, size)]
    for i, at in enumerate(rng.permutation(size)[: size // 5]):
        words[at] = other[i]
    near = list(words)
    for i, at in enumerate((20, 60, 100, 140)):
        at = next(j for j in range(at, size) if near[j] in S.LATIN)
        near[at] = other[size // 5 + i]
    return " ".join(words), " ".join(near)


def test_every_link_of_the_least_similarity_is_found(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [filler(rng) for _ in range(40)]
    assert all(S.is_whole_residue([a]) and not S.is_whole_residue([b]) for a, b in texts)
    docs = spark.createDataFrame([(2 * i + j, t, None, None) for i, pair in enumerate(texts) for j, t in enumerate(pair)], DOCS)
    got = {r.doc_id: r.label for r in R.residue(docs).collect()}
    assert got == {2 * i + j: ("whole", "linked")[j] for i in range(40) for j in range(2)}


def test_prefix_join_meets_what_brute_force_finds(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    sets = {}
    for i in range(0, 400, 2):
        n = int(rng.integers(1, 80))
        a = [int(x) for x in rng.integers(0, 2**64, n, dtype=np.uint64)]
        drop, add = rng.integers(0, n // 6 + 1), rng.integers(0, n // 6 + 1)
        sets[i], sets[i + 1] = set(a), set(a[drop:]) | {int(x) for x in rng.integers(0, 2**64, add, dtype=np.uint64)}
    signed = lambda s: sorted(h - (1 << 64) if h >> 63 else h for h in s)
    rows = [(i, str(i), len(s), R.prefix(signed(s))) for i, s in sets.items() if s]
    df = spark.createDataFrame(rows, "doc_id bigint, body string, shingled bigint, prefix array<bigint>")
    met = {(r.a, r.b) for r in R.sharing(df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")).collect()}
    want = {(str(i), str(j)) for i in sets if i % 2 == 0 for j in sets if j % 2 and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 50 and want <= met


def test_long_tracebacks():
    frames = "".join(f'  File "/srv/app/part{i}.py", line {i + 3}, in step{i}\n    value = self.load(name, {i}) + other.find(key)\n    ^^^^^^^\n' for i in range(30))
    page = f"Selholm\nTraceback (most recent call last):\n{frames}KeyError: 'a'\n\nDuring handling of the above exception, another exception occurred:\n\nTraceback (most recent call last):\n{frames}app.errors.LoadError: no such part\n"
    assert S.is_whole_residue(S.body_lines(page, "Selholm"))
    assert S.is_whole_residue(S.body_lines(page + "Please try again later.", "Selholm"))
    assert not S.is_whole_residue(S.body_lines(page + ART, "Selholm"))
    assert not S.is_whole_residue(S.body_lines(f"{ART}\n{page}", None))


@pytest.mark.parametrize("few", [R.FEW, 0])
def test_company_tells_kinds_that_no_seed_knows(spark, monkeypatch, few):
    """Half of the notices are in a language without seeds; those that come with known ones are learnt, however they come later."""
    monkeypatch.setattr(R, "FEW", few)
    unknown = ["Tämä sivu vaatii selaimen komentosarjat.", "Sivua ei löytynyt palvelimelta tänään.", "Yhteys katkesi, yritä myöhemmin uudelleen.", "Istuntosi on vanhentunut, kirjaudu taas.", "Huoltokatko on käynnissä juuri nyt."]
    known = ["You need to enable JavaScript to run this app.", "Error 503: the server could not complete your request.", "Please try again in 4 minutes and reload this page.", "Access denied. You do not have permission to view this."]
    docs, want = [], set()
    for i in range(60):
        u, k = unknown[i % 5], known[i % 4]
        text = (f"Tower {i}\n{u}", f"{k} {u}", k, f"{u} {unknown[(i + 1) % 5]}")[i // 15]
        docs.append((i, text, f"Tower {i}", None))
        want.add(i)
    docs += [(100 + i, f"{ART} {ART.replace('1802', str(1803 + i))} The keeper wrote of {i} sheep.", None, None) for i in range(10)]
    docs += [(200 + i, f"{ART} {unknown[4]} The well was dug by {i} men in the year of the flood.", None, None) for i in range(2)]
    got = {r.doc_id: r.label for r in R.residue(spark.createDataFrame(docs, DOCS)).collect()}
    assert set(got) == want and sum(v == "linked" for v in got.values()) > 20  # articles that hold a notice are not residue


def test_links_make_up_for_seeds_that_are_left_out(spark):
    """Without the seeds of one concept, most of its pages are found by the company they keep in the test tables; nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "title")
    full = {r.doc_id for r in R.residue(docs).collect()}
    some = R.residue(docs, S.Seeds(("errors",))).collect()
    got = {r.doc_id for r in some}
    assert got <= full and len(got) >= 0.9 * len(full) and any(r.label == "linked" for r in some)


def test_seeds_of_other_kinds_and_languages():
    for text in (
        "500 Internal Server Error. The server encountered an internal error and was unable to complete your request.", "Sorry, this app doesn't work properly without scripts enabled.", "Per visualizzare questa pagina è necessario abilitare JavaScript.",
        "Страница не найдена. Запрашиваемая страница не существует.", "Notice: Undefined variable: title in /var/www/index.php on line 12", "Verifying you are human. This may take a few seconds.", "The service is temporarily overloaded.",
        "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium", "このページを表示するにはJavaScriptを有効にしてください。",
    ):
        assert S.is_whole_residue(S.body_lines(text, None)), text
    assert S.has_placeholder("Dear [CUSTOMER NAME], hello") and S.has_placeholder("Dear {{first_name}}")
    long = "You need to enable JavaScript to " + "run this part of the page and " * 40 + "go on."
    assert S.is_whole_residue([long])


def test_needed_strings():
    assert S.needed("(ab|cde)x?") == {"ab", "cde"} and S.needed("x{3,}") == {"xxx"} and S.needed(r"\d+") is None and S.needed("(a|)b?") is None


def test_shingles_of_short_and_long_bodies():
    import numpy as np

    words = [list("abcdefg"), ["x"], list("abcd"), list("abcde"), ["x"]]
    flat, sizes = R.word_hashes([w for x in words for w in x]), np.array([len(x) for x in words])
    together = R.shingle_hashes(flat, sizes)
    alone = [R.shingle_hashes(R.word_hashes(x), np.array([len(x)]))[0] for x in words]
    assert [len(x) for x in together] == [3, 1, 1, 1, 1] and all((a == b).all() for a, b in zip(together, alone, strict=True))
    assert together[1] == together[4] and together[3][0] in together[0] and R.simhash(together) == [R.simhash([x])[0] for x in alone]

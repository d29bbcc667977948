from __future__ import annotations

import os

import numpy as np
import pytest

from siftline.llm import boilerplate as B
from siftline.llm import boilerplate_teacher as teacher
from siftline.llm import boilerplate_train as train

ROWS = "id string, title string, candidates array<string>, passage_types array<string>, line_no int"
PROSE = "The old tower of Selholm was repaired in 1802 by the council, and most visitors came from the coast."
PAGE = ["Home | News | Search | Contact", PROSE, "History", PROSE + "\nWe use cookies to count visitors. Accept all", "References", None, " ", "Popular now\n- Treaty of Ostrille\n- Drum of Calloria"]


def run(spark, rows):
    return {tuple(r) for r in B.chrome_lines(spark.createDataFrame(rows, ROWS)).collect()}


def test_a_page(spark):
    got = run(spark, [("a", "Selholm", PAGE, None, 1), ("b", None, None, None, 1), ("c", None, [], [], 1), ("d", None, [None, "\n \n"], ["x"], 1)])
    assert got == {("a", 0, 0), ("a", 3, 1), ("a", 4, 0), ("a", 7, 0), ("a", 7, 1), ("a", 7, 2)}
    body = {(r.id, r.cand_pos): r.text for r in B.main_body(spark.createDataFrame([("a", "Selholm", PAGE, None, 1)], ROWS)).collect()}
    assert body == {("a", 1): PROSE, ("a", 2): "History", ("a", 3): PROSE}
    assert run(spark, []) == set()


def test_very_long_pages_are_read_whole(spark):
    lines = [PROSE] * 3000 + ["© 2019 Selholm House. All rights reserved."]
    assert ("a", 0, 3000) in run(spark, [("a", "x", ["\n".join(lines)], None, 1)])


def test_pages_do_not_change_each_other():
    a, b = B.Page(PAGE, None, "x"), B.Page([PROSE] * 30, ["paragraph"] * 30, "y")
    alone, both = B.labeller().scores([a])[0], B.labeller().scores([a, b, B.Page([], None, None)])
    assert np.allclose(alone, both[0], atol=1e-5) and len(both[2]) == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in train.start(rng).items()}
    pages = [B.Page(PAGE, None, "x"), B.Page([PROSE, "Home"], None, "y")]
    truth = [np.arange(len(p.words)) % 2 == 0 for p in pages]
    old, train.DROP = train.DROP, 0.0
    try:
        _, g = train.step(w, pages, truth, rng)
        for name, at in (("uf", (3, 5)), ("wb", (7, 40)), ("ox", (2, 0)), ("bf", (9,)), ("words", (pages[0].words[0][0], 1))):
            eps, was = 1e-2, w[name][at]
            w[name][at] = was + eps
            up, _ = train.step(w, pages, truth, rng)
            w[name][at] = was - eps
            down, _ = train.step(w, pages, truth, rng)
            w[name][at] = was
            assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 + 0.05 * abs(g[name][at]), name
    finally:
        train.DROP = old


def test_accuracy_on_rows_not_trained_on():
    import pyarrow.dataset as ds

    path = next(p for p in ("/root/testdata/check_s/nq_sample_rows.parquet", "/root/testdata/sf0.01/nq_sample_rows.parquet") if os.path.exists(p))
    rows = ds.dataset(path).to_table(columns=["candidates", "passage_types", "title"]).to_pylist()
    accuracy, precision, recall = train.accuracy(B.labeller(), train.labelled(rows))
    assert accuracy > 0.995 and precision > 0.99 and recall > 0.99


#: Lines of forms and words that no training page and no variant has.
UNSEEN = [
    "Departments | Directions | Opening hours | Membership", "Overview / Pricing / Docs / Changelog", "Front page · Politics · Opinion · Obituaries", "Main › Collections › Ceramics › Bowls", "Mens > Jackets > Waterproof", "Ana sayfa | Haberler | İletişim",
    "We and 43 partners process identifiers on your device. Agree Decline", "This website relies on cookies. By browsing further you consent to them. Dismiss", "© 2021 Harbour Gazette Ltd. All rights reserved.", "Copyright © 2008 Norwood Parish Council. Designed by Bright Pixel.",
    "Share via: Mail Telegram Messenger", "Tweet | Pin | Bookmark | Send by mail", "Sign up | Log on | Lost your password?", "Already a member? Log on to read the rest", "Leave a response", "Newer entries | Older entries", "« First ‹ Prev 4 5 6 Next › Last »",
    "Sponsored: garden sheds at half price", "Categories: pottery, glazing, kilns", "Last reviewed on 3 March 2017", "Hot right now\nTen walks near Selholm\nThe mill that moved\nWho built the tower?\nFive bridges", "More on this topic\n- Bridge of Calloria\n- Tannery at Ostrille\n- Drum of Pelvik",
]
#: Genuine lines that hold the words of menus and notices.
GENUINE = [
    "Search for gold", "Home ownership", "Contact with Rome", "News of the battle reached Selholm", "Privacy in medieval houses", "Archive of the wool guild", "Shops and markets", "Help from the coast", "Jobs in the mill", "Events of 1802", "Maps by Jorrit", "Login of the pilgrims",
    "Basalt\nGranite\nRed sandstone\nSlate", "- Oak beams\n- Iron nails\n- Lime mortar", "Search parties\nHelp from monks\nTools of stone", "The menu of the inn lists cookies, bread and cheese.", "In 1790 the society printed a newsletter and sold it at the gate.",
    "Visitors shared the page with the guild until 1702.", "The next page of the register is lost.", "Those who subscribed paid two crowns to the library.", "The contact of the two rocks is visible in the quarry.", "Terms of the treaty", "Library and reading room", "Gallery of the upper floor", "Register of births",
]


def test_unseen_chrome_and_genuine_lines_with_its_words():
    """Each block stands in a page of prose: at least 0.95 of the chrome is found, 0.9 of the lines that resemble it are kept, and all prose."""
    more = ["The keeper of the tower rowed to Pelvik each week, and the council paid him eleven crowns.", "Nobody knows why the mill was moved, though the guild kept a record of the cost."]
    pages, truth = [], []
    for bad, blocks in ((True, UNSEEN), (False, GENUINE)):
        for i, block in enumerate(blocks):
            at = (0, 3, 2)[i % 3] if bad else 1 + i % 2
            kind = "list" if block.count("\n") and not bad else "header" if not bad and len(block.split()) < 5 and i % 2 else "paragraph"
            body = [PROSE, *more]
            pages.append(B.Page([*body[:at], block, *body[at:]], [*["paragraph"] * at, kind, *["paragraph"] * (3 - at)], "Selholm Tower"))
            truth.append([bad if c == at else False for c, _ in pages[-1].at])
    got = [s >= 0.5 for s in B.labeller().scores(pages)]
    found = [(bool(g), t, p.at[i][0], n) for n, (gs, ts, p) in enumerate(zip(got, truth, pages, strict=True)) for i, (g, t) in enumerate(zip(gs, ts, strict=True))]
    chrome = [g for g, t, _, _ in found if t]
    at = lambda n: 1 + (n - len(UNSEEN)) % 2
    alike = [g for g, t, c, n in found if not t and n >= len(UNSEEN) and c == at(n)]
    prose = [g for g, t, c, n in found if not t and not (n >= len(UNSEEN) and c == at(n))]
    assert len(chrome) > 25 and sum(chrome) >= 0.95 * len(chrome)
    assert len(alike) > 30 and sum(alike) <= 0.1 * len(alike) and not any(prose)


def test_labels_for_training():
    assert teacher.labels("Popular now: A, B\n" + PROSE) == [True, False]
    assert teacher.labels("Shop\nTools\n\nMaps") == [True, True, False, True]
    assert teacher.labels("We use\ncookies to count\nvisitors. Accept all") == [True] * 3
    assert teacher.labels("Tags: stone, mills") == [True] and teacher.labels("Filed under mills\n" + PROSE) == [True, False]
    assert teacher.labels("The upper cookies baked at Zelmar were accepted as payment by monks until 1632.") == [False]

"""Blocks for the labeller's training that its pages don't hold: chrome of many forms, and genuine blocks that look like it.

Only the training uses this. Most words are drawn from the page itself or made up, so forms are learnt rather than words.
"""

from __future__ import annotations

import numpy as np

#: Words of user interfaces, and parts of notices.
SURFACE = "home news about contact search help tools topics shop jobs events visit library maps archive gallery login register account profile settings privacy terms blog forum media press careers support downloads video photos sport weather culture travel newsletter subscribe cart checkout wishlist stores donate members community calendar projects research teaching people services products pricing company team partners careers inicio noticias contacto ayuda tienda accueil actualites recherche aide boutique startseite aktuelles suche hilfe themen".split()
VERBS, THINGS = "use store set place keep rely-on collect save".split(), ("cookies", "cookies and similar technologies", "small files", "identifiers", "local storage", "trackers")
AIMS = ("to improve your visit", "to show you fitting adverts", "to count visits", "for analytics", "to personalise content", "so that this site works", "to remember your choices", "for the purposes described here", "and share data with our partners")
BUTTONS = ("Accept", "Accept all", "Reject", "I agree", "OK", "Got it", "Manage settings", "Learn more", "Close", "Allow all", "More information", "Cookie policy")
ASIDES = "Trending|Top stories|Latest|Recommended for you|Editors' picks|Read next|More stories|Most viewed|Also on this site|Latest posts|Related articles|Featured|From our partners|Popular posts|Recent comments|Keep reading|See more|Beliebt|Weitere Artikel|A lire aussi|Plus de sujets|Te puede interesar|Mas noticias".split("|")
ENDS = ("All rights reserved", "Terms and privacy", "Legal notice", "Reproduction without permission is forbidden", "Registered charity", "Site by {w}", "Hosted by {w}", "Contact us")
SHARES = "Share Tweet Email Print Facebook Twitter Pinterest WhatsApp LinkedIn Reddit Bookmark Copy-link Like Follow Save Pin".split()
BARS = ("Next", "Previous", "Older posts", "Newer posts", "First", "Last", "Next article", "Back", "Back to overview", "Load more", "Show more results", "Skip navigation", "To the top", "Read more", "View all")
DOORS = ("Sign in", "Create account", "Sign in to comment", "Subscribe now", "Start your free trial", "Forgot password?", "Become a member", "Join the discussion", "Register for free", "Leave a reply", "Post a comment", "Get our newsletter")
JOINS = ("for", "with", "of", "in", "and", "from", "among", "before", "after", "at", "under", "against", "by", "near", "without", "on")
NOUNS = "gold rome battle houses guild river wool stone iron salt trade war faith law land sea harvest plague bridge market king abbey mill silver glass grain copper timber harbour fishing mining farming weaving science music poetry travel water winter summer north south coast hills valley".split()
TELLS = (
    "The {u} of the {n} was {v} in {y} by the {m}.", "In {y} the {m} opened a {u} near the {n}.", "Its {u} lists the {n} and the {m} of {y}.", "{w} wrote of the {u} that the {m} {v} before {y}.", "A {u} for the {n} was {v} by {w}, who had come to {n} in {y}.",
    "Visitors could sign in the {u} book, and {w} did so in {y}.", "The {m} sold {u} and {n} at the gate until {y}.", "Nobody shared the {u} with the {m}, as {w} noted.", "Most pages of the {u} tell of the {n}; the last page is lost.", "Those who subscribed to the {n} paid {y} crowns for the {u}.",
)
DONE = "built moved sold painted described widened printed closed repaired founded".split()
GROUPS = "guild council union monks farmers board trust society sailors masons".split()


class _Words:
    """Words for a block: of the page, made up, or of user interfaces."""

    def __init__(self, texts: list, title: str | None, rng: np.random.Generator) -> None:
        self.rng = rng
        own = [w.strip(".,;:()") for t in texts if t for w in t.split()[:200]]
        self.names = [w for w in own if w[:1].isupper() and len(w) > 3] or ["Selholm"]
        self.own = [w for w in own if w.islower() and len(w) > 4] or NOUNS

    def one(self, some):
        return some[int(self.rng.integers(len(some)))]

    def name(self) -> str:
        if self.rng.random() < 0.5:
            return self.one(self.names)
        return "".join(self.one(("ba", "ko", "ri", "ven", "tor", "mil", "sa", "lun", "der", "pe")) for _ in range(int(self.rng.integers(2, 4)))).title()

    def noun(self) -> str:
        return self.one(NOUNS) if self.rng.random() < 0.5 else self.one(self.own)

    def item(self) -> str:
        x = self.rng.random()
        word = self.one(SURFACE) if x < 0.5 else self.noun() if x < 0.85 else self.name()
        word = word if self.rng.random() < 0.3 else word.capitalize()
        return word if self.rng.random() < 0.75 else f"{word} {self.one((self.noun(), self.one(SURFACE), 'us', '& more'))}"

    def many(self, low: int, high: int, make) -> list[str]:
        return [make() for _ in range(int(self.rng.integers(low, high)))]

    def heading(self) -> str:
        x = self.rng.random()
        word = (self.one(SURFACE) if x < 0.6 else self.noun()).capitalize()
        return f"{word} {self.one(JOINS)} {'the ' if self.rng.random() < 0.4 else ''}{self.name() if self.rng.random() < 0.3 else self.noun()}"

    def title(self) -> str:
        return self.one((f"Who {self.one(DONE)} the {self.noun()}?", f"The {self.noun()} that {self.one(DONE)}", f"Five {self.noun()} facts", f"{self.noun().capitalize()} of {self.name()}", f"{self.name()} {self.noun()}", f"{self.name()} {self.name()}", f"List of {self.noun()} near {self.name()}"))

    def sentence(self) -> str:
        return self.one(TELLS).format(u=self.one((*SURFACE, "cookies", "menu", "page")), n=self.noun(), v=self.one(DONE), y=int(self.rng.integers(1100, 1990)), m=self.one(GROUPS), w=f"{self.name()} {self.name()}")


def chrome(w: _Words) -> tuple[str, str | None]:
    """A block that is no main body, and its type."""
    r, kind = w.rng, w.one((None, "list", "paragraph", "paragraph"))
    sep = w.one((" | ", " / ", " · ", " > ", " - ", " » ", " › ", "\n", "   "))
    year = int(r.integers(1995, 2026))
    shape = int(r.integers(10))
    if shape == 0:
        return sep.join(w.many(3, 8, w.item)), kind
    if shape == 1:
        return w.one((" > ", " » ", " › ", " / ")).join([w.one(("Home", "Start", "Accueil", "Inicio", "Startseite")), *w.many(1, 4, w.item)]), kind
    if shape == 2:
        who = w.one(("We", "This site", "Our partners and we", f"{w.name()} Online", "By browsing you let us"))
        return f"{who} {w.one(VERBS).replace('-', ' ')} {w.one(THINGS)} {w.one(AIMS)}. {w.one((' | ', ' ')).join(w.many(1, 4, lambda: w.one(BUTTONS)))}", kind
    if shape == 3:
        mark = w.one(("©", "(c)", "Copyright", "Copyright ©"))
        return f"{mark} {year} {w.name()} {w.noun().capitalize()}. {w.one(ENDS).format(w=w.name())}.", kind
    if shape == 4:
        return f"{w.one(('Share', 'Share this', 'Share on', 'Teilen', 'Partager', 'Compartir', 'Follow us on'))}{w.one((': ', ' ', ' | '))}{w.one((' ', ' | ', ', ')).join(w.many(2, 6, lambda: w.one(SHARES)))}", kind
    if shape == 5:
        items = w.many(3, 8, w.title)
        bullet = w.one(("- ", "* ", "", "• "))
        head = w.one(ASIDES) if r.random() < 0.6 else w.one((f"{w.noun().capitalize()} this week", f"{w.noun().capitalize()} of the day", "What others read", "In case you missed it", "Don't miss", "Worth a look", f"Now on {w.name()}", f"New in {w.noun()}", f"Our {w.noun()} picks", "Today's links", "Discover", "Explore further", "You might like"))
        return (f"{head}: {', '.join(items)}" if r.random() < 0.3 else "\n".join([head, *[bullet + x for x in items]])), w.one((None, "list", "list"))
    if shape == 6:
        return sep.join(w.many(1, 4, lambda: w.one(BARS))), kind
    if shape == 7:
        return sep.join(w.many(1, 4, lambda: w.one(DOORS))), kind
    if shape == 8:
        what = w.one(("Tags", "Categories", "Topics", "Keywords", "Filed under", "Posted in", "Labels", "Sponsored", "Promoted", "Ad"))
        if what in ("Sponsored", "Promoted", "Ad"):
            return f"{what}: {w.noun()} {w.one(('offers near you', 'at half price', 'for less', 'deals of the week', 'delivered free'))}{w.one(('', f', up to {int(r.integers(5, 90))}% off'))}", kind
        return f"{what}{w.one((': ', ' '))}{', '.join(w.many(1, 5, lambda: w.one((w.noun(), w.name()))))}", kind
    last = w.one(("Last edited on", "Last updated", "Updated:", "Posted on", "Published by", "Page last modified", "Printed from", "Retrieved from"))
    return w.one((f"{last} {int(r.integers(1, 29))} {w.one(('May', 'June', 'October'))} {year}", f"{last} {w.name()}", f"{int(r.integers(2, 90))} comments | {w.one(DOORS)}", w.one(("Sponsored", "Advertisement", "Promoted content", "Ad", "Story continues below")))), kind


def genuine(w: _Words) -> tuple[str, str | None]:
    """A block of main body that holds the words, or has some of the form, of chrome, and its type."""
    shape = int(w.rng.integers(6))
    if shape in (0, 5):
        return w.heading(), w.one(("header", "section", "paragraph", None))
    if shape == 1:
        bullet = w.one(("- ", "* ", "", ""))
        make = w.one((lambda: w.noun().capitalize(), lambda: f"{w.noun().capitalize()} {w.one(JOINS)} {w.noun()}", w.heading))
        return "\n".join(bullet + x for x in w.many(3, 8, make)), w.one(("list", "list", None))
    if shape == 2:
        return " ".join(w.many(1, 4, w.sentence)), w.one(("paragraph", "paragraph", None))
    if shape == 3:
        return f"{w.name()} {w.noun()}, {int(w.rng.integers(1100, 2020))}", w.one(("paragraph", "paragraph", None))  # under a picture
    return "\n".join([w.sentence(), w.heading(), w.sentence()]), "paragraph"


def varied(texts: list, types: list | None, marks: list[list[bool]], title: str | None, rng: np.random.Generator) -> tuple[list, list, list[list[bool]]]:
    """The page with up to four more blocks: chrome anywhere, genuine ones beside a block of main body. Some types are forgotten."""
    w = _Words(texts, title, rng)
    kinds = [types[i] if types is not None and i < len(types) else None for i in range(len(texts))]
    out = [(t, k, m) for t, k, m in zip(texts, kinds, marks, strict=True)]
    for _ in range(int(rng.integers(0, 5))):
        bad = rng.random() < 0.5
        text, kind = (chrome if bad else genuine)(w)
        body = [i for i, (t, _, m) in enumerate(out) if m and not any(m)]
        at = int(rng.integers(len(out) + 1)) if bad or not body else w.one(body) + 1
        out.insert(at, (text, kind, [bad and bool(x.strip()) for x in text.split("\n")]))
    return [t for t, _, _ in out], [k if rng.random() > 0.1 else None for _, k, _ in out], [m for _, _, m in out]

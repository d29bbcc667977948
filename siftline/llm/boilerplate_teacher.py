"""Labels for training the block labeller: lines that are surely page chrome, by patterns of four languages.

Only the training uses this; the operator itself asks the trained network. A block is chrome if its lines, read as one text,
are. Lines under the heading of a sidebar list are chrome up to the first that reads as a sentence.
"""

from __future__ import annotations

import re

#: Entries of menus.
MENU = {
    *("home", "news", "about us", "contact", "search", "help", "tools", "topics", "shop", "jobs", "events", "visit", "library", "maps", "archive", "gallery"),
    *("log in", "register", "random page", "today's pick"),
    *("startseite", "aktuelles", "über uns", "kontakt", "suche", "hilfe", "themen", "archiv", "impressum", "karten", "anmelden"),
    *("accueil", "actualités", "à propos", "recherche", "aide", "archives", "boutique", "cartes", "connexion"),
    *("inicio", "noticias", "quiénes somos", "contacto", "buscar", "ayuda", "archivo", "tienda", "mapas", "entrar"),
}
#: Headings of sidebar lists.
SIDEBARS = (
    "popular now|most read this week|recently viewed|related pages|you may also like|in this section|more from [^:.]{3,60}|"
    "meistgelesen|verwandte themen|mehr von [^:.]{3,60}|les plus lus|articles liés|plus de [^:.]{3,60}|lo más leído|artículos relacionados|más de [^:.]{3,60}"
)
#: Whole lines of chrome.
LINES = re.compile(
    "|".join(
        (
            r"(we use cookies|cookies help us|this site stores cookies|our partners and we use cookies|diese seite nutzt cookies|wir verwenden cookies|nous utilisons des cookies|ce site dépose des cookies|usamos cookies|este sitio utiliza cookies)\b.{0,140}",
            r"(home|startseite|accueil|inicio)( ?[>»/|·-] ?[^>»|·]{2,80}){1,5}",
            r"download our app for the full story|enjoyed this\? send it to a friend\.?|loading comments, please wait|print \| save \| listen|log in or create an account to leave a comment",
            r"you have \d+ free pages left this month\. subscribe now|share this page: .{3,60}|next page »|« previous \| next »|\[edit\] \[view source\]|advertisement|reading time: \d+ min",
            r"\d+ comments \| report a problem with this page|jump to: navigation, search|page \d+ of \d+|was this page helpful\? yes / no|skip to main content|back to top",
            r"this page was last changed on .{3,30}|© \d{4} .{3,80}|copyright \d{4} by .{3,60}|powered by .{3,60}|imprint \| privacy \| terms of use \| .{3,60}|privacy policy - accessibility - site map",
            r".{3,60} is a registered charity, no\. ?\d+|text on this page may be reused under the terms of .{3,60}|follow .{3,60} for daily updates|sign up for our weekly letter and never miss a story about .{3,90}",
            r"anzeige|impressum \| datenschutz \| agb|zum inhalt springen|nach oben|seite \d+ von \d+|zuletzt geändert am .{3,30}|newsletter abonnieren und nichts über .{2,90} verpassen|kommentar schreiben|seite drucken \| seite empfehlen|ein angebot von .{3,60}",
            r"publicité|mentions légales \| .{3,60}|aller au contenu|haut de page|page \d+ sur \d+|dernière modification en \d{4} par .{3,60}|inscrivez-vous à la lettre de .{3,60}|partager cette page ?:? .{3,60}|laisser un commentaire",
            r"publicidad|aviso legal \| .{3,60}|saltar al contenido|volver arriba|página \d+ de \d+|última modificación: .{3,30}|suscríbase al boletín de .{3,60}|compartir esta página|dejar un comentario",
            r"(sponsored|promoted|anzeige|gesponsert|sponsorisé|patrocinado): [^.!?]{3,100}|filed under [^.!?]{2,60}|(tags|categories|topics|schlagwörter|kategorien|mots-clés|catégories|etiquetas|categorías): [^.!?]{2,140}",
            rf"({SIDEBARS})(: [^.!?]{{3,400}})?",
        )
    )
)
HEADING = re.compile(SIDEBARS)
#: The headings that count as boilerplate in the chunker too.
FIXED_HEADINGS = {"v t e", "vte", "v.t.e", "external links", "references", "see also", "notes"}


#: Lines that one block of a broken page is looked for in.
REACH = 40


def collapse(text: str) -> str:
    return " ".join(text.split()).lower()


def is_menu(text: str) -> bool:
    for sep in ("|", "/", ">", "·", " - ", "»", "  "):
        items = [x.strip() for x in text.split(sep)]
        if len(items) > 1 and all(x in MENU for x in items if x):
            return True
    return text.strip() in MENU


def is_chrome(text: str) -> bool:
    flat = collapse(text)
    return bool(LINES.fullmatch(flat)) or flat in FIXED_HEADINGS or is_menu(text.lower().strip())


def reads_as_sentence(line: str) -> bool:
    words = line.split()
    return len(words) > 9 or len(words) > 4 and line.rstrip().endswith((".", "!", "?", ":", '"'))


def labels(candidate: str) -> list[bool]:
    """For each line between line feeds whether it is chrome; blank lines are not."""
    lines = candidate.split("\n")
    out = [False] * len(lines)
    full = [i for i, x in enumerate(lines) if x.strip()]
    if not full:
        return out
    if is_chrome(candidate):
        for i in full:
            out[i] = True
    i = 0
    while i < len(full):
        for span in range(min(REACH, len(full) - i), 0, -1):
            text = " ".join(lines[j] for j in full[i : i + span])
            if is_chrome(text) and not (span > 1 and all(is_chrome(lines[j]) for j in full[i : i + span])):
                flat = collapse(text)
                if span > 1 and HEADING.match(flat) and ":" not in flat:
                    continue
                for j in full[i : i + span]:
                    out[j] = True
                i += span - 1
                break
        i += 1
    for k, i in enumerate(full):
        if HEADING.fullmatch(collapse(lines[i])):
            for j in full[k + 1 :]:
                if reads_as_sentence(lines[j]):
                    break
                out[j] = True
    return out

"""Trusted labels of problem 9: what one document shows by itself.

The seeds are few and meant to be sure. Placeholders are told by their syntax. A *message* is a sentence in which a concept and
what is said of it meet (a script and a demand, a page and its absence, ...), and which doesn't narrate: no quoted words, no year,
no verb of telling, no plain past. Lengths play no part.
"""

from __future__ import annotations

import re
import unicodedata

#: Code and short quotations, in which a placeholder is only spoken of.
QUOTED = re.compile(r"```.*?```|`[^`\n]*`|[\"“„«](?:[^\"“”„«»\s]+ ){0,5}[^\"“”„«»\s]+[\"”“»]|<(script|style|code|pre)\b.*?</\1>", re.S | re.I)
_NAME = r"[^\W\d][\w.]*(?: [\w.]+){0,4}"
#: Words with which an instruction to fill in a field begins or ends.
_FILL = r"insert|your|enter|add|tbd|todo|fill in|write|type|choose|insérer|votre|saisir|ajouter|introducir|insertar|añadir|su|einfügen|ihr|ihre|eintragen|hier"
PLACEHOLDER = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?[#/^&]?\s*{_NAME}\s*\}}\}}",
            rf"[$#]\{{\s*{_NAME}\s*\}}",
            rf"(?<![\w{{$#])\{{{_NAME}\}}(?!\}})",
            r"%\([^\W\d][\w.]*\)[sdrf]",
            r"(?<![\w%])%[^\W\d][\w.]*%(?![\w%])",
            rf"\[%-?\s*{_NAME}\s*-?%\]",
            rf"\{{%-?\s*{_NAME}\s*-?%\}}",
            rf"<%[=-]?\s*{_NAME}\s*-?%>",
            rf"<<\s*{_NAME}\s*>>",
            rf"@@{_NAME}@@",
            r"(?<!\w)__[^\W\d_][\w]*?__(?!\w)",
            rf"\*\|{_NAME}\|\*",
            r"&[A-Z][A-Z_]{2,};|&[a-z]+_[a-z_]+;",
            r"(?<![\w$])\$[^\W\d]\w{2,}\$(?![\w$])",
            rf"\[\[\s*(?i:{_FILL})\b[^\]|\n]*\]\]",
            r"\[\[[A-Z][A-Z_]*_[A-Z_]+\]\]|\[\[[a-z]+(?:_[a-z]+)*\]\]",
            rf"\[\s*(?i:{_FILL})\b:?[^\]\[\n]+\]",
            rf"\[[^\]\[\n]+\s(?i:{_FILL}|here|ici|aquí)\s*\]",
            r"<[^<>\n]+ (?i:goes here|here|ici|aquí|hier)>",
            r"_{3,}\s*\([^)\n]{2,}\)",
        )
    )
)
#: Fields whose names are all capitals or all small, as in ``[[CAPTION]]``, are told from links by these words. Fixed values.
FIELDS = {*"title date year place author summary section caption name city org user email count item first last page company phone address price".split()}
LINKED = re.compile(r"\[\[([^\]|\[\n]{2,})\]\]")

#: All-capital words in brackets are a field if one of them names one, as in ``[COMPANY NAME]``.
CAPITALS = re.compile(r"\[([A-Z][A-Z]+(?:[ _][A-Z]+)*)\]")
#: Every placeholder has one of these.
MARKS = re.compile(r"[{[<%@_*&$]")


def has_placeholder(text: str) -> bool:
    if not MARKS.search(text):
        return False
    plain = QUOTED.sub(" ", text)
    if PLACEHOLDER.search(plain):
        return True
    words = lambda m: [w for w in re.split(r"[\s_.]+", m.group(1).lower()) if w]
    return any(all(w in FIELDS for w in words(m)) for m in LINKED.finditer(plain)) or any(len(words(m)) > 1 and not FIELDS.isdisjoint(words(m)) for m in CAPITALS.finditer(plain))


#: A message is a sentence with a word of a left and one of a right pattern, in any order (or of the left one alone).
#: Letters are small and without accents.
CONCEPTS: dict[str, list[tuple[str, str | None]]] = {
    "scripts": [
        (
            r"java ?script|\bscripts?\b|\bscripting\b|\bno ?script\b|\bskripte?n?\b|скрипт|スクリプト",
            r"\b(en|dis)abl|requir|\bneed|\bmust\b|(turn|switch)(ed)? (it |them )?(on|off)|allow|activ|aktivier|habilit|necesit|benotig|erforderlich|notwendig|abgeschaltet|attiv|abilit|richiede|necess|\bativ|inschakel|vereist|wlacz|вклю|отключ|требу|необходим|有効|無効|必要|without|blocked|loaded by|prevent|support|unterstutz",
        ),
    ],
    "missing": [
        (
            r"\b(page|url|article|file|document|content|site|address|resource|link|results?|seite|datei|inhalt|artikel|adresse|pagina|contenido|articulo|archivo|fichier|contenu|contenuto|indirizzo|risorsa|conteudo|documento)s?\b|страниц|адрес|ページ",
            r"not (be )?found|can ?not be (found|shown|displayed)|(does|do)(n't| not) exist|no longer|may have been|has been (moved|removed|deleted)|\bstale\b|\bmissing\b|(not|un)[ -]?available|nicht (gefunden|verfugbar|vorhanden)|existiert nicht|introuvable|n'existe (pas|plus)|deplacee?s?|supprimee?s?|indisponible|non? (trouve|encontrad|encontro|existe|disponible|disponivel|esta disponible|e stat|esiste|trovat|e disponibile)|nao (foi )?(encontrad|existe)|не (найден|существует)|недоступн|見つかりません|存在しません|niet gevonden|nie znaleziono",
        ),
        (r"^no results\b|^\W*40[34]\b\W*\w+|\b(error|fehler|erreur|errore|erro|ошибка|エラー|http(/\d(\.\d)?)?)\W*(code\W*)?[45]\d\d(?=\W*$|\W*[:–—-]|\W+(the|die|der|le|la|il|el|not|internal|bad|service|gateway|forbidden|unauthorized|too|method|temporarily)\b)|^\W*[45]\d\d\W+(page|not|forbidden|unauthorized|bad|internal|service|gateway|too|method|error|fehler|erreur|seite|pagina|stranica|страница)\b", None),
    ],
    "errors": [
        (r"(something|what) went wrong|internal server error|bad (request|gateway)|gateway time-?out|timed? ?out\b.*\b(while|after|reading|gateway|response|waiting)|\b\d* ?gateway$|(unexpected|unerwarteter|interner|unknown|internal) (error|fehler)|(ist ein|ein) fehler|\bune erreur\b.*(survenue|produite)|\bun error\b|\berrore (imprevisto|interno|del server)|si e verificato un errore|ocorreu um erro|произошла .*ошибка|ошибка сервера|エラーが発生|er is een fout", None),
        (r"\b(server|service|site|database|connection|system|request|dienst|servicio|servizio|sitio|base de donnees|сервер\w*|сервис\w*|サーバー)\b", r"(temporar|momentan|voru?bergehend|curr?ent)\w* (\w+ )?(un|in|over|non|no|nicht|down)|(is|are) (down|offline|overloaded|unavailable|busy)|failed\b|refused|could not (complete|open|connect|be reached)|can ?not be reached|under maintenance|not responding|indisponible|no esta disponible|non (e )?disponibil|nicht erreichbar|перегружен|недоступ|временно"),
        (r"^\W*fatal error\b|^uncaught\b|^(php )?(notice|warning|deprecated|parse error|fatal error)\W.*\b(undefined|failed|unexpected|division|line \d)|traceback \(most recent call last\)|^file \".+\", line \d+|^at [\w.$<>]+\([\w.]+(:\d+)?\)|^[\w.]*(error|exception)(:|$)|^exception in thread|segmentation fault|^caused by: |^stack trace:?$|\bon line \d+$", None),
    ],
    "refusals": [
        (r"\baccess (is |was |has been )?denied|\bpermission (to|denied)|\b(you are|request) (forbidden|unauthori[sz]ed)|(have|has) been (temporarily )?blocked|too many requests|\bcaptcha\b|(verify|verifying|checking|confirm|prove)\b.*\b(you are|you're) (not |a |an )*(human|robot|bot)|are you (a robot|human)|(session|token|link) (has |is )?expired|(log|sign) ?in (again )?to (continue|view|read|see|proceed)|(you must|please) (be logged|log|sign) ?in|not available in your (region|country|area)|unusual (traffic|activity)", None),
        (r"zugriff (verweigert|nicht)|keine berechtigung|acces (refuse|interdit)|acceso (denegado|prohibido)|accesso (negato|vietato)|acesso negado|доступ (запрещ|закрыт|ограничен)|アクセスが拒否|trop de requetes|demasiadas solicitudes|zu viele anfragen|sitzung .*abgelaufen|session .*expire|sesion .*(caducado|expirado)", None),
        (r"\b(down|closed|offline)\b.*\bmaintenance|\bmaintenance\b.*\b(back|soon|progress|moment)|wartungsarbeiten|en maintenance|en mantenimiento|in manutenzione|em manutencao|техническ\w+ (работ|обслуж)|メンテナンス中", None),
    ],
    "filler": [
        (r"\b(sample|dummy|placeholder|example|filler|test|default) (paragraph|text|content|page|copy|post)\b|\b(text|content|title|headline|description|story|copy|image|caption|name)s? (starts |goes |here$)(here)?|edit (this|or delete)|text will be replaced|replace (it|this|the text) with|^\W*hello,? world\W*$|write something about|^(add|insert|enter|type|put|write|click|change)\b.*\b(here|own words|yourself)\b|platzhalter|beispieltext|blindtext|mustertext|texte (provisoire|d'exemple|de remplissage|factice)|texto (de (ejemplo|relleno|prueba|exemplo|preenchimento)|provisional)|testo (di (esempio|prova|riempimento)|segnaposto)|voorbeeldtekst|текст[ -]?заглушк|пример текста|ダミーテキスト|サンプルテキスト|^(page |site )?(is )?(coming soon|under construction)|(site|page) (is )?under construction|im aufbau$|en construccion$|en construction$|in costruzione$|^x{3,}$", None),
    ],
    "courtesy": [
        (r"^oops\b|^sorry$|try(ing)? again|will be back|be back (soon|later|shortly)|thank you for your patience|has been (told|notified|informed|logged)|\b(reload|refresh)\b|contact (the|your|us|support|our)|(go|return|take me) (back )?(to )?(the )?(home|start|previous)|^loading\b|please wait|^reference #|^request id|^ray \w|^server: |^version: |check (the|your|that|for)|works best|(turn|switch) (it|them) on|will not work without|(can|may) take .*(seconds?|minutes?|moment)|need to start again|redirect|^if you (believe|think|are|keep|see)", None),
        (r"(versuchen sie|versuche) es|spater (noch einmal|erneut|wieder)|bitte warten|wird geladen|abgeschaltet$|zur(uck zur)? startseite|merci de|veuillez (re|pat|ver|con)|reessaye[rz]|patientez|retour a l'accueil|intentelo|vuelva (a|al|mas)|compruebe|por favor,? espere|volver al inicio|riprova|attendere|torna alla|tente novamente|попробуйте|повторите|подождите|вернит|お待ち|お試し|もう一度|probeer het", None),
    ],
}
#: What makes a sentence one that tells of something: quoted words, years, verbs of telling, the plain past.
NARRATES = re.compile(
    r"[\"“„«][^\"“”„«»]+\s[^\"“”„«»]+[\"”“»].*\b(wrote|said|writes|says|explains?)\b|\b(explains?|teach(es)?|taught|says?|said|writes|wrote|describes?|mentions?|quotes?|discusses|recalls?|reports?|is quoted|is written|called|printed|erklart|lehrt|schrieb|explique|enseigne|escribio|ensena)\b.*\w"
    r"|\b(in|until|of|since|from|by|before|after|im jahr|seit|en|depuis|desde|bis) 1\d\d\d\b|\b(was|were|had)\b(?! (not found|unable|blocked|an (error|unexpected)|no response|denied\W*$|interrupted|reset))"
)
#: Words of the usual Latin fillers.
LATIN = {
    *"lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split(),
    *"perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora vero accusamus iusto odio dignissimos ducimus blanditiis praesentium".split(),
}


def _plain_letters() -> dict[str, str]:
    """Letters with an accent and the letter without."""
    apart = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    return {"\u2019": "'"} | {c: x[0] for c, x in apart.items() if len(x) > 1}


PLAIN_LETTERS = _plain_letters()
ACCENTED = re.compile("[\u00c0-\u024f\u1e00-\u1eff\u2019]")


def unaccented(text: str) -> str:
    return text if text.isascii() else ACCENTED.sub(lambda m: PLAIN_LETTERS.get(m[0], m[0]), text)


def needed(pattern) -> set[str] | None:
    """Strings of which every match of a pattern holds at least one: the longest such set of its parts; None if there is none."""
    best, run = None, ""

    def better(one):
        nonlocal best
        if one and (best is None or min(map(len, one)) > min(map(len, best))):
            best = one

    for op, value in (*(re._parser.parse(pattern) if isinstance(pattern, str) else pattern), (None, None)):
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "MAX_REPEAT" and len(value[2]) == 1 and str(value[2][0][0]) == "LITERAL" and value[0] > 0:
            run += chr(value[2][0][1]) * value[0]
        better({run} if run else None)
        run = ""
        if name == "SUBPATTERN":
            better(needed(value[3]))
        elif name == "MAX_REPEAT" and value[0] > 0:
            better(needed(value[2]))
        elif name == "BRANCH":
            parts = [needed(x) for x in value[1]]
            better(None if None in parts else set().union(*parts))
    return best


class Seeds:
    """The concepts in use. ``without``: names of concepts that are left out. An automaton over strings that the patterns need tells which to try."""

    def __init__(self, without: tuple[str, ...] = ()) -> None:
        import ahocorasick

        self.without = tuple(without)
        self.pairs, marks = [], {}
        for name, pairs in CONCEPTS.items():
            for a, b in pairs if name not in without else ():
                rule = len(self.pairs)
                for x in needed(unaccented(a)):
                    marks.setdefault(x, set()).add(2 * rule)
                right = needed(unaccented(b)) if b else None
                for x in right or ():
                    marks.setdefault(x, set()).add(2 * rule + 1)
                self.pairs.append((re.compile(unaccented(a)), re.compile(unaccented(b)) if b else None, right is not None))
        self.automaton = ahocorasick.Automaton()
        for x, found in marks.items():
            self.automaton.add_word(x, found)
        self.automaton.make_automaton()

    def __reduce__(self):
        return Seeds, (self.without,)

    def is_message(self, sentence: str) -> bool:
        return self.tells(unaccented(" ".join(sentence.lower().split())))

    def tells(self, low: str) -> bool:
        """As :func:`is_message`, of a sentence in small letters, without accents and with single blanks."""
        seen: set[int] = set()
        for _, marks in self.automaton.iter(low):
            seen |= marks
        told = False
        for mark in seen:
            if not mark & 1:
                left, right, asked = self.pairs[mark >> 1]
                if (not asked or mark + 1 in seen) and left.search(short := low.rstrip(" .!…")) and (right is None or right.search(short)):
                    told = True
                    break
        return told and not NARRATES.search(short)


FOOTER = re.compile(r"\s*(©|\(c\)|copyright\b|all rights reserved|alle rechte|tous droits|todos los derechos)[^\n]*", re.I)
REFERENCE = re.compile(r"(\b(?:reference #?|ray )\w{6,}\.?)", re.I)
WORD = re.compile(r"\w+")


#: Ends of sentences.
STOPS = (". ", "! ", "? ", "。")


def repeats(words: list[str]) -> bool:
    """Whether up to four words come again and again and nothing else."""
    return len(set(words)) <= 4 and any(len(words) >= 4 * n and all(w == words[i % n] for i, w in enumerate(words)) for n in range(1, 5))


#: Lines of a Python traceback: its head, a frame, marks under a source line and the error at its end. Fixed values.
TRACE_HEAD = re.compile(r"traceback \(most recent call last\):?|during handling of the above exception, another exception occurred:?|the above exception was the direct cause of the following exception:?", re.I)
TRACE_FRAME = re.compile(r"file \".+\", line \d+(, in .+)?", re.I)
TRACE_MARK = re.compile(r"[\^~][\^~ ]*|\[previous line repeated \d+ more times?\]", re.I)
TRACE_END = re.compile(r"[\w.]*(error|exception|exit|interrupt|warning|stopiteration|timeout)(: .*)?", re.I)


def without_tracebacks(lines: list[str]) -> list[str]:
    """The lines without tracebacks, of any length: a head, frames, each with its source line, and the error."""
    rest, i = [], 0
    if not any("raceback" in x or "RACEBACK" in x for x in lines):
        return lines
    while i < len(lines):
        at = i + 1 if TRACE_HEAD.fullmatch(lines[i]) else i
        while at > i and at < len(lines) and TRACE_FRAME.fullmatch(lines[at]):
            at += 1
            if at < len(lines) and not any(p.fullmatch(lines[at]) for p in (TRACE_HEAD, TRACE_FRAME, TRACE_MARK, TRACE_END)):
                at += 1
            while at < len(lines) and TRACE_MARK.fullmatch(lines[at]):
                at += 1
        if at > i + 1 and at < len(lines) and TRACE_END.fullmatch(lines[at]):
            at += 1
        if at == i:
            rest.append(lines[i])
        i = max(at, i + 1)
    return rest



def is_filler(words: list[str]) -> bool:
    """Latin filler, or the same words again and again."""
    return len(words) >= 4 and (sum(map(LATIN.__contains__, words)) >= 0.8 * len(words) or repeats(words))


def body_lines(text: str, title: str | None, message=None) -> list[str]:
    """The lines without menus (items of up to three words), footers and, above others, the title or a heading.

    A first line is a heading if it has no end of a sentence, is no message and is shorter than what follows it.
    """
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    keep = []
    name = " ".join((title or "").lower().split())
    for line in lines:
        if len(lines) > 1 and " ".join(line.lower().split()) == name or FOOTER.fullmatch(line):
            continue
        items = re.split(r"\s+[|·»>/-]\s+|\s{3,}", line) if line[-1] not in ".!?:" else []
        if len(items) > 2 and all(len(x.split()) <= 3 and not re.search(r"[\d:.!?]", x) for x in items):
            continue
        keep.append(line)
    if len(keep) > 1 and not re.search(r"[.!?:;…>\"]$|[:]", keep[0]) and len(keep[0]) < sum(map(len, keep[1:])) and not (message or SEEDS.is_message)(keep[0]) and not is_filler(WORD.findall(keep[0].lower())):
        keep = keep[1:]
    return keep


def sentences(lines: list[str]) -> list[str]:
    """The pieces of a body that are judged one by one, with single blanks."""
    out = []
    for line in lines:
        line = " ".join(line.split())
        if "ence #" in line or "ENCE #" in line or "ay " in line or "AY " in line:
            line = REFERENCE.sub(r"\1\n", line)
        for stop in STOPS:
            line = line.replace(stop, stop[0] + "\n")
        out += [x for x in line.split("\n") if x]
    return out


SEEDS = Seeds()


def is_whole_residue(lines: list[str], seeds: Seeds = SEEDS) -> bool:
    """Whether nothing but messages and filler is left."""
    words = WORD.findall("\n".join(lines).lower())
    if not words:
        return False
    return is_filler(words) or all(seeds.is_message(x) or is_filler(WORD.findall(x.lower())) for x in sentences(without_tracebacks(lines)) if WORD.search(x))

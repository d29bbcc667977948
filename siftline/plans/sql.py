"""Fragments of the SQL that says the same as the text functions, for DuckDB."""

from __future__ import annotations

from siftline.functions import text as T

WS = r"[\s\x0b\x{85}\p{Z}\x1c-\x1f]"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def normalize(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def optional(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def token_count(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+'))"


def words(x: str) -> str:
    return f"list_filter(string_split(trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' '), ' '), lambda w: w <> '')"


def unicode_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"


def stem(t: str) -> str:
    rules = " ".join(f"WHEN ends_with({t}, '{e}') AND length({t}) - {len(e)} >= 3 THEN left({t}, length({t}) - {len(e)}) || '{n}'" for e, n in T.ENDINGS)
    return f"CASE WHEN length({t}) <= 4 OR regexp_full_match({t}, '[0-9]+') THEN {t} {rules} ELSE {t} END"


def analyze(x: str, analyzer: str = "regex_stem_stop") -> str:
    if analyzer == "whitespace":
        return words(f"lower({x})")
    tokens = f"list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+(?:[''-][A-Za-z0-9]+)?'), lambda t: lower(t))"
    if analyzer != "regex":
        tokens = f"list_transform({tokens}, lambda t: {stem('t')})"
    if analyzer == "regex_stem_stop":
        tokens = f"list_filter({tokens}, lambda t: t NOT IN ({quoted(T.STOPWORDS)}))"
    return tokens


def boilerplate(x: str) -> str:
    return f"(lower({x}) IN ({quoted(T.BOILERPLATE)}) OR length({x}) <= 2)"


def contains_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in markers) + ")"


def intro(x: str) -> str:
    return f"(ends_with({x}, ':') OR ({token_count(f'lower({x})')} <= 40 AND {contains_any(f'lower({x})', T.INTRO_MARKERS)}))"


def intro_by_words(x: str) -> str:
    return f"(ends_with({x}, ':') OR (len({words(x)}) <= 40 AND {contains_any(f'lower({x})', T.INTRO_MARKERS)}))"


def fact(x: str) -> str:
    padded = f"(' ' || lower({x}) || ' ')"
    return rf"({token_count(x)} >= 8 AND {contains_any(padded, T.FACT_VERBS)} AND regexp_matches({x}, '[.!?]\s*$'))"


def role(x: str, kind: str) -> str:
    n = token_count(x)
    return f"""CASE WHEN {boilerplate(x)} THEN 'boilerplate' WHEN {intro(x)} THEN 'intro'
WHEN {kind} = 'table' THEN CASE WHEN {n} >= 40 THEN 'table_parent' ELSE 'table_child' END
WHEN {kind} = 'list' THEN CASE WHEN {n} >= 40 THEN 'list_parent' ELSE 'list_item' END
WHEN {kind} IN ({quoted(T.HEADER_TYPES)}) THEN 'header'
WHEN {fact(x)} THEN CASE WHEN {n} < 60 THEN 'short_fact_candidate' ELSE 'paragraph' END ELSE 'paragraph' END"""


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


#: Rows of raw candidates: row, position, normalised text, type.
CANDIDATES = f"""
cand AS (SELECT row_ordinal, i AS idx, {normalize('c')} AS text, {optional('passage_types[i + 1]')} AS ptype
  FROM (SELECT row_ordinal, passage_types, unnest(candidates) AS c, unnest(range(len(candidates)))::INT AS i FROM nq_sample_rows) WHERE c IS NOT NULL AND {strip('c')} <> '')"""

#: Annotations: candidates with position among those kept, tokens, role and containing parent.
ANNOTATIONS = f"""{CANDIDATES},
ann0 AS (SELECT row_ordinal, idx, row_number() OVER (PARTITION BY row_ordinal ORDER BY idx) AS pos, text, lower(text) AS low, ptype, {token_count('text')} AS tokens, {role('text', 'ptype')} AS role0 FROM cand),
par AS (SELECT a.row_ordinal, a.idx, arg_min(p.idx, p.pos) AS parent FROM ann0 a JOIN ann0 p ON a.row_ordinal = p.row_ordinal AND abs(a.pos - p.pos) <= 25 AND a.idx <> p.idx AND p.tokens >= 8 AND contains(p.low, a.low)
  WHERE a.role0 <> 'boilerplate' AND a.tokens <= 20 AND length(a.low) > 5 GROUP BY 1, 2),
ann AS (SELECT a.row_ordinal, a.idx, a.pos, a.text, a.low, a.ptype, a.tokens, CASE WHEN parent IS NOT NULL THEN 'duplicate_child' ELSE role0 END AS role, parent FROM ann0 a LEFT JOIN par USING (row_ordinal, idx))"""

"""SQL of detector families for an engine whose regular expressions have no lookaround.

A pattern's first lookbehind or word boundary becomes a character consumed before the match, its last lookahead a test of the character after it; classes are written out with
Unicode categories. Conditions of detectors are written again as SQL. Only patterns that this can express are offered.
"""

from __future__ import annotations

import re

from quillon import fixtures
from quillon.functions import word_lists as W
from quillon.functions.patterns import PATTERNS
from quillon.functions.regex import to_java
from quillon.operators import detectors as D
from quillon.operators.detect import LANGUAGES

WORD = r"\p{L}\p{N}\p{M}_"
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


class Unsupported(ValueError):
    """A lookaround that stands inside a pattern."""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def written_out(pattern: str) -> str:
    """Class escapes as Unicode categories, in classes and outside."""
    out, i, inside = [], 0, False
    names = {"d": r"\p{Nd}", "s": SPACE, "w": WORD}
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e in names:
                out.append(names[e] if inside else f"[{names[e]}]")
            elif e in "SWD" and not inside:
                out.append(f"[^{names[e.lower()]}]")
            else:
                out.append("\\" + e)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            i += 1
            if pattern[i] == "^":
                out.append("^")
                i += 1
            if pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        inside = inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def _class_of(body: str) -> str:
    """The inside of a class for a lookaround of one character: \\d, \\w, [...] or a plain character."""
    if re.fullmatch(r"\[[^\]]*\]|\\.|[^\\\[\]().*+?|]", body):
        return body[1:-1] if body.startswith("[") else body
    raise Unsupported(body)


def simple(pattern: str, group: str | int | None) -> tuple[str, int, int, list[tuple[bool, str]]]:
    """(pattern, groups before the kept part, kept group or 0, what must or must not follow, nothing for a word boundary): group 1 is the character before the match."""
    java = to_java(pattern, group, lead=False)
    flags, body = re.match(r"\(\?([a-zA-Z]+)\)", java.pattern), java.pattern
    body = body[flags.end() :]
    kept = "".join(sorted(set(flags[1]) & set("ims")))
    opening = ""
    if java.before and body.startswith("("):
        opening, body = "(", body[1:]
    start = r"(\A|[^{0}])"
    if (m := re.match(r"\(\?<!(\[[^\]]*\]|\\.|.)\)", body)) is not None:
        body, inside = body[m.end() :], written_out(f"[{_class_of(m[1])}]")[1:-1]
        lead = rf"(\A|[{inside[1:]}])" if inside.startswith("^") else start.format(inside)
        body = body[2:] if body.startswith("\\b") else body
    elif body.startswith("\\b"):
        body, lead = body[2:], start.format(WORD)
    else:
        lead = "()"
    after = []
    while True:
        if (m := re.search(r"\(\?([!=])((?:\[[^\]]*\]|\\.|[^()\\\[]|\(\?:(?:\[[^\]]*\]|\\.|[^()\\\[])*\))*)\)(\)?)$", body)) is not None:
            body = body[: m.start()] + m[3]
            after.append((m[1] == "=", r"\A(?:" + written_out(m[2]).replace("$", r"\n?\z") + ")"))
        elif body.endswith("\\b"):
            body = body[:-2]
            after.append((True, ""))
        else:
            break
    if re.search(r"\(\?(?:[=!]|<[=!])", body):
        raise Unsupported(pattern)
    head = f"(?{kept})" if kept else ""
    if lead != "()":
        lead = f"(?-i:{lead})" if "i" in kept else lead
    body = opening + written_out(body) if java.before else f"(?:{written_out(body)})"
    return head + lead + body, java.before, java.value[0] if java.value else 0, after


def hits(table: str, pattern: str, group: str | int | None = None, where: str = "") -> str:
    """A query for doc_id, t, i, start, m of the kept parts of all matches in `table(doc_id, t)`."""
    p, before, value, after = simple(pattern, group)
    every = lambda g: f"regexp_extract_all(t, {text(p)}, {g})"
    # the lead is group 1, so the groups of the translation stand one further
    kept = f"{every(value + 1)}[i]" if value else "substr(ms[i], length(ls[i]) + 1)"
    lead = "length(ls[i])" + (f" + length({every(before + 1)}[i])" if before else "")
    if value and not before:
        lead = f"CASE WHEN suffix(ms[i], {kept}) THEN length(ms[i]) - length({kept}) ELSE position({kept} IN ms[i]) - 1 END"
    rest = "substr(t, start + length(m) + tail + 1, 200)"
    is_word = lambda n: f"regexp_matches(substr(t, start + length(m) + tail{n}, 1), {text(f'[{WORD}]')})"
    follows = "".join(f" AND {'' if wanted else 'NOT '}regexp_matches({rest}, {text(a)})" if a else f" AND {is_word('')} <> {is_word(' + 1')}" for wanted, a in after)
    return f"""SELECT doc_id, t, i, start, m FROM (
  SELECT doc_id, t, i, m, CAST(pos + ahead AS BIGINT) AS start, whole - ahead - length(m) AS tail FROM (
    SELECT doc_id, t, i, {kept} AS m, {lead} AS ahead, length(ms[i]) AS whole,
      coalesce(list_sum(list_transform(gs[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS pos
    FROM (SELECT doc_id, t, ms, ls, regexp_split_to_array(t, {text(p)}) AS gs, unnest(range(1, len(ms) + 1)) AS i
      FROM (SELECT doc_id, t, {every(0)} AS ms, {every(1)} AS ls FROM {table}{where}) WHERE len(ms) > 0)))
WHERE m <> ''{follows}"""


def _exists(pattern: str) -> str:
    """A pattern with word boundaries at its ends, for a test only."""
    body = pattern
    head, tail = "", ""
    if body.startswith("\\b"):
        head, body = rf"(?:\A|[^{WORD}])", body[2:]
    if body.endswith(r"\.?\b"):
        body, tail = body[:-5], rf"(?:\.[{WORD}]|[^{WORD}]|\z)"
    elif body.endswith(r"\.\b"):
        body, tail = body[:-2], f"[{WORD}]"
    elif body.endswith("\\b"):
        body, tail = body[:-2], rf"(?:[^{WORD}]|\z)"
    return "(?i)" + head + written_out(body) + tail


CORPUS = "corpus AS (SELECT doc_id, text, lang FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, {text(t)}, {text(k)})" for i, k, t in fixtures.DOCUMENTS) + "))"


def languages() -> str:
    """Common table expressions `corpus` and `spoken`: doc_id, language, rank."""
    count = lambda ps: " + ".join(f"CAST(regexp_matches(text, {text(_exists(p))}) AS INT)" for p in ps) or "0"
    rows = ", ".join(
        f"CASE WHEN lang = '{k}' OR ({count(W.STRONG_MARKERS.get(k, ()))}) >= 1 OR ({count(W.WEAK_MARKERS.get(k, ()))}) >= 2 THEN '{k}' END" for k in LANGUAGES
    )
    return f"""{CORPUS}, marked AS (SELECT doc_id, lang, list_filter([{rows}], lambda x: x IS NOT NULL) AS ls FROM (SELECT doc_id, coalesce(text, '') AS text, lang FROM corpus)
), spoken AS (SELECT doc_id, unnest(CASE WHEN len(ls) = 0 THEN ['fr'] ELSE ls END) AS language FROM marked)"""


def _near(pattern: str, n: int) -> str:
    return f"regexp_matches(substr(t, greatest(start - {n}, 0) + 1, least({n}, start)), {text(_exists(pattern) if not pattern.startswith('(?i)') else written_out(pattern))})"


def _digits(n: int) -> str:
    return rf"length(regexp_replace(m, '\P{{Nd}}', '', 'g')) >= {n}"


def _lines(start: bool) -> str:
    """Text from three line ends before a match to four after."""
    head, tail = "substr(t, 1, start)", "substr(t, start + 1)"
    last = f"array_to_string(list_slice(string_split({head}, chr(10)), -{3}, -1), chr(10))"
    if not start:
        ends = f"(length({head}) - length(replace({head}, chr(10), '')))"
        last = f"CASE WHEN {ends} >= 3 THEN {last} WHEN {ends} = 0 THEN '' ELSE substr({head}, position(chr(10) IN {head})) END"
    return f"({last} || array_to_string(string_split({tail}, chr(10))[1:4], chr(10)))"


#: Conditions on a match (columns t, start, m) by pattern.
KEEPS = {
    "national_id": _digits(1), "uk_driver": _digits(1), "de_id": _digits(6), "cz_op": _digits(1), "cn_hkid": _digits(1), "bank_account": _digits(8), "capital": _digits(4),
    "socsec_fr": _near(PATTERNS["socsec_fr_context"], 60), "uk_ni": _near(PATTERNS["uk_ni_context"], 60), "es_dni": _near(PATTERNS["es_id_context"], 40), "pt_nif": _near(PATTERNS["pt_nif_context"], 30),
    "es_cif": _near(r"(?i)C\.?I\.?F\.?|N\.?I\.?F\.?", 40),
    "phone_fr": r"NOT regexp_full_match(m, '\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}')",
    "postal_city_fr": "NOT list_has_any(regexp_split_to_array(lower(m), '[ \\t\\-'']+'), [" + ", ".join(map(text, W.POSTAL_CITY_STOPS)) + "])",
    "postal_code_fr": f"m <> '00000' AND regexp_matches({_lines(False)}, {text(written_out(PATTERNS['address_context']))})",
    "ape_orphan": f"regexp_matches({_lines(True)}, {text(written_out(PATTERNS['ape_context']))})",
    "siren": " OR ".join(
        f"contains(upper({side}), {text(w)})" for side in ("substr(t, greatest(start - 30, 0) + 1, least(30, start))", "substr(t, start + length(m) + 1, 30)") for w in ("SIREN", "RCS", "RC ", "RC.", "B.", "B ", "REGISTRE")
    ),
}




def _words_before(words: tuple[str, ...], n: int) -> str:
    return "(" + " OR ".join(f"contains(lower(substr(t, greatest(start - {n}, 0) + 1, least({n}, start))), {text(w.lower())})" for w in words) + ")"


def _first_word(words: tuple[str, ...], case: str = "lower", strip: str = "") -> str:
    word = f"{case}(regexp_extract(m, '^[{SPACE}]*([^{SPACE}]+)', 1))"
    return f"{f'trim({word}, {text(strip)})' if strip else word} NOT IN ({', '.join(map(text, words))})"


def _distinctive() -> str:
    words = r"regexp_extract_all(m, '[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9\-]+')"
    known = ", ".join(map(text, W.TECHNICAL_ACRONYMS))
    return f"len(list_filter({words}, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND length(w) >= CASE WHEN upper(w) = w THEN 5 ELSE 4 END AND w NOT IN ({known}) AND upper(w) NOT IN ({known}))) > 0"


def _plant() -> str:
    tokens = f"list_transform(regexp_split_to_array(trim(m), '[{SPACE}]+'), lambda w: trim(lower(w), {text('.,:-/' + chr(39) + '’')}))"
    named = f"list_filter(({tokens})[2:], lambda w: w NOT IN ({', '.join(map(text, W.PLANT_LINKERS))}))"
    return f"len({named}) > 0 AND ({named})[1] NOT IN ({', '.join(map(text, W.PLANT_NOISE))})"


KEEPS |= {
    "bigram_fr": _words_before(W.PERSON_KEYWORDS_FR, 40), "bigram_en": _words_before(W.PERSON_KEYWORDS_EN, 40), "bigram_es": _words_before(W.PERSON_KEYWORDS_ES, 40),
    "bigram_it": _words_before(W.PERSON_KEYWORDS_IT, 40), "bigram_pt": _words_before(W.PERSON_KEYWORDS_PT, 40), "bigram_bg": _words_before(W.PERSON_KEYWORDS_BG, 40),
    "maiden_fr": _first_word(W.MAIDEN_STOPS), "maiden_other": _first_word(W.MAIDEN_STOPS), "commercial_cell": _first_word(W.CELL_NOT_A_NAME, "upper", ".,;:-_'"),
    "toponym_cardinal": _first_word(("notre", "votre", "leur", "bureau", "agence", "service", "departement", "direction")),
    "company_header": f"m NOT IN ({', '.join(map(text, W.HEADER_ACRONYMS))})", "paren": _distinctive(), "plant": _plant(),
    "bank_label": _first_word(W.BANK_STOPS), "bank_inline": _first_word(W.BANK_INLINE_STOPS), "tracking_labelled": _digits(4),
    "affair": f"{_digits(2)} AND upper(m) NOT IN ({', '.join(map(text, (*D.MONEY_WORDS, 'JOUR', 'JOURS', 'SEM', 'JANV', 'FEV', 'AVR')))})",
    "incoterm": f"{_first_word(W.INCOTERM_NOT_LOCATION)} AND NOT (length(m) <= 3 AND upper(m) = m AND lower(m) <> m)",
}

#: The same patterns with their inner lookaround moved to an end or left out where it never decides.
MOVED = {
    "url": PATTERNS["url"].replace(r"(?![^\W\d_])(?:/[^\s]*)?", r"(?:/[^\s]*)?(?!\p{L})"),
    "phone_fr_labelled": PATTERNS["phone_fr_labelled"].replace(r"(?<!\d)(?P<value>", "(?P<value>"),
}


def family(name: str) -> str:
    """Doc_id, seq and the span fields that the detectors of a family give over all documents and the invented ones."""
    parts = []
    order = [*D.UNIVERSAL, *D.ADDRESS, *D.PHONE, *D.NAMES, *D.INCOTERM, *D.FISCAL_FR, *D.SITES]
    for n, d in enumerate(x for x in order if x.family == name):
        if d.build or (d.keep and d.pattern not in KEEPS):
            raise Unsupported(d.tag)
        where = f" WHERE doc_id IN (SELECT doc_id FROM spoken WHERE language = '{d.languages[0]}')" if d.languages else ""
        keep = f" WHERE {KEEPS[d.pattern]}" if d.keep else ""
        score = repr(float(d.score))
        parts.append(f"SELECT doc_id, {n} AS det, i, start, m, '{d.entity}' AS entity_type, CAST({score} AS DOUBLE) AS score, '{d.tag}' AS recognizer FROM ({hits('texts', MOVED.get(d.pattern) or D.pattern_of(d.pattern), d.group, where)}){keep}")
    return f"""WITH {languages()}, texts AS (SELECT doc_id, text AS t FROM corpus WHERE text IS NOT NULL
), found AS ({' UNION ALL '.join(parts)})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY det, i) - 1 AS INT) AS seq, CAST(start AS INT) AS start, CAST(start + length(m) AS INT) AS "end", entity_type, m AS text, score, recognizer FROM found"""


#: Of the lists: entity, tag, score, how the alternation is made.
LISTS = {
    "organizations": ("ORGANIZATION", "OrganizationsDenyList", 1.0, {}), "organizations_loose": ("ORGANIZATION", "OrganizationsLooseDenyList", 0.75, {"whole_words": False}),
    "people": ("PERSON", "PeopleDenyList", 1.0, {}), "places": ("LOCATION", "PlacesDenyList", 0.95, {"accents": True}),
    "singleton": ("ORG_SINGLETON", "OrgSingleton", 1.0, {"accents": True}), "singleton_loose": ("ORG_SINGLETON", "OrgSingletonLoose", 0.85, {"whole_words": False}),
}


def union(rows: list[tuple[str, str | int | None, str, str, float]]) -> str:
    """Spans of (pattern, group, entity, tag, score) in this order, over all documents."""
    parts = [
        f"SELECT doc_id, {n} AS det, i, start, m, '{entity}' AS entity_type, CAST({float(score)!r} AS DOUBLE) AS score, '{tag}' AS recognizer FROM ({hits('texts', pattern, group)})"
        for n, (pattern, group, entity, tag, score) in enumerate(rows)
    ]
    return f"""WITH {CORPUS}, texts AS (SELECT doc_id, text AS t FROM corpus WHERE text IS NOT NULL
), found AS ({' UNION ALL '.join(parts)})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY det, i) - 1 AS INT) AS seq, CAST(start AS INT) AS start, CAST(start + length(m) AS INT) AS "end", entity_type, m AS text, score, recognizer FROM found"""


def listed(rows: list[tuple[str, str, str, float]]) -> str:
    return union([(pattern, None, entity, tag, score) for pattern, entity, tag, score in rows])


def dictionaries(names: tuple[str, ...], lists: list[tuple[str, str, str, float]], surnames: tuple[str, ...]) -> str:
    """Spans of listed entries by pattern, of initials before surnames, and of the entries `names` as runs of whole words."""
    edge = r"[^\s,.;:()\"]"
    whole = rf"(?i)(?<!{edge})(?:{'|'.join(n.replace(' ', r'\s+') for n in names)})(?!{edge})"
    rows = [(p, entity, tag, score, "") for p, entity, tag, score in lists]
    known = ", ".join(text(x.lower()) for x in surnames)
    rows.append((r"\b(?:[A-Z]\.|M\.|Mme|Mlle|Mr)[ \t]+[A-ZÀ-Þ][A-Za-zÀ-ÿ'\-]+", "PERSON", "InitialSurnameDict", 0.7, rf" WHERE lower(regexp_extract(m, '(\S+)$', 1)) IN ({known})"))
    rows.append((whole, "PERSON", "FirstnameDict_join", 0.6, ""))
    parts = [
        f"""SELECT doc_id, CAST(start AS INT) AS start, CAST(start + length(m) AS INT) AS "end", '{entity}' AS entity_type, m AS text, CAST({score!r} AS DOUBLE) AS score, '{tag}' AS recognizer FROM ({hits('texts', p)}){where}"""
        for p, entity, tag, score, where in rows
    ]
    return f"WITH {CORPUS}, texts AS (SELECT doc_id, text AS t FROM corpus WHERE text IS NOT NULL) {' UNION ALL '.join(parts)}"

"""Deny lists and dictionaries: listed names to one alternation, longest first."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.regex import matches
from quillon.functions.word_lists import ACCENT_CLASSES
from quillon.operators.spans import empty, make

BLANKS, QUOTES, LETTERS = " \t-_", "'’ʼ", r"A-Za-z0-9_À-ÖØ-öø-ÿ"


def flexible(item: str, accents: bool = False) -> str:
    """A literal as a pattern: runs of separators match any run or none, apostrophes each other, and letters their accented forms if asked."""
    out, gap = [], False
    for ch in item:
        if ch in BLANKS:
            if not gap:
                out.append(r"[ \t\-_]*")
            gap = True
            continue
        gap = False
        if ch in QUOTES:
            out.append("['’ʼ]")
        elif accents and ch.lower() in ACCENT_CLASSES:
            out.append(ACCENT_CLASSES[ch.lower()])
        else:
            out.append(ch if ch.isalnum() else "\\" + ch)
    return "".join(out)


def alternation(items: Iterable[str], case_sensitive: bool = False, whole_words: bool = True, accents: bool = False) -> str | None:
    """All items in one pattern, longest first; None if there are none."""
    chosen = sorted({i for i in items if i.strip()}, key=lambda i: (-len(i), i))
    if not chosen:
        return None
    body = "(?:" + "|".join(flexible(i, accents) for i in chosen) + ")"
    if whole_words:
        body = f"(?<![{LETTERS}]){body}(?![{LETTERS}])"
    return body if case_sensitive else "(?i)" + body


def listed(text: str, items: Iterable[str], entity: str, tag: str, score: float, case_sensitive: bool = False, whole_words: bool = True, accents: bool = False, least: int = 1) -> Column:
    """Spans of listed items of at least `least` characters."""
    pattern = alternation((i for i in items if len(i) >= least), case_sensitive, whole_words, accents)
    if pattern is None:
        return empty()
    return F.transform(matches(text, pattern), lambda m: make(m, entity, tag, score))


def singleton(text: str, variants: Iterable[str]) -> Column:
    return listed(text, variants, "ORG_SINGLETON", "OrgSingleton", 1.0, accents=True)


def singleton_loose(text: str, variants: Iterable[str]) -> Column:
    return listed(text, variants, "ORG_SINGLETON", "OrgSingletonLoose", 0.85, whole_words=False, least=6)


def organizations(text: str, items: Iterable[str]) -> Column:
    return listed(text, items, "ORGANIZATION", "OrganizationsDenyList", 1.0)


def organizations_loose(text: str, items: Iterable[str]) -> Column:
    return listed(text, items, "ORGANIZATION", "OrganizationsLooseDenyList", 0.75, whole_words=False, least=4)


def people(text: str, items: Iterable[str]) -> Column:
    return listed(text, items, "PERSON", "PeopleDenyList", 1.0)


def places(text: str, items: Iterable[str]) -> Column:
    return listed(text, items, "LOCATION", "PlacesDenyList", 0.95, accents=True)


def cities(text: str, items: Iterable[str], language: str) -> Column:
    return listed(text, items, "LOCATION", f"CityDict_{language}", 0.7, accents=True)


def first_names(text: str, items: Iterable[str], language: str) -> Column:
    return listed(text, items, "PERSON", f"FirstnameDict_{language}", 0.6, accents=True)


def makers(text: str, items: Iterable[str]) -> Column:
    return listed(text, items, "ORGANIZATION", "AutomotiveOemDict", 0.85, accents=True)


def initial_surname(text: str, surnames: Iterable[str]) -> Column:
    """An initial or French title before a listed surname."""
    known = [s.lower() for s in surnames]
    if not known:
        return empty()
    found = matches(text, r"\b(?:[A-Z]\.|M\.|Mme|Mlle|Mr)[ \t]+[A-ZÀ-Þ][A-Za-zÀ-ÿ'\-]+")
    hit = F.filter(found, lambda m: F.lower(F.regexp_extract(m["text"], r"(\S+)$", 1)).isin(*known))
    return F.transform(hit, lambda m: make(m, "PERSON", "InitialSurnameDict", 0.7))

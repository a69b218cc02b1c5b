"""Detection: languages, all detectors in order, the rules after them, and protection."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import word_lists as W
from quillon.functions.needs import literals
from quillon.functions.regex import quoted, to_java
from quillon.operators import detectors as D
from quillon.operators import lists
from quillon.operators import sequential as S
from quillon.operators.spans import SPANS

#: Order in which languages run, which decides ties.
LANGUAGES = ("fr", "de", "en", "es", "it", "pt", "bg", "nl")


@dataclass(frozen=True)
class Options:
    """Lists and switches of a run. Lists are driver-side and become literals of the plan; large ones belong in `dictionary_spans`."""

    singleton: tuple[str, ...] = ()
    organizations: tuple[str, ...] = ()
    people: tuple[str, ...] = ()
    places: dict[str, tuple[str, ...]] = field(default_factory=dict)
    cities: dict[str, tuple[str, ...]] = field(default_factory=dict)
    first_names: dict[str, tuple[str, ...]] = field(default_factory=dict)
    surnames: tuple[str, ...] = ()
    makers: tuple[str, ...] = ()
    lexicon: tuple[str, ...] = ()
    allow_patterns: tuple[str, ...] = ()
    primary_language: str | None = None
    propagate: bool = True
    expand: bool = True
    protect: bool = True
    families: tuple[str, ...] = ()
    opaque: bool = False
    clean_orphans: bool = True


def letters_first(pattern: str) -> str:
    """The pattern with the word boundary before its first letters tested after them, which is much quicker where they are rare."""
    head = re.match(r"\\b([^\W\d_]+)", pattern)
    return f"{head[1]}(?<=\\b{head[1]}){pattern[head.end() :]}" if head else pattern


def _hits(patterns: tuple[str, ...], text: str) -> str:
    """How many of the patterns the named column holds, as SQL over prepared rows."""

    def one(p: str) -> str:
        hit, needed = f"rlike({text}, {quoted(to_java('(?i)' + letters_first(p)).pattern)})", literals(p)
        first = " OR ".join(f"contains({D.LOWER}, {quoted(n)})" for n in needed)
        return f"IF({f'({first}) AND ' if needed else ''}{hit}, 1, 0)"

    return " + ".join(map(one, patterns)) or "0"


def marker_languages(text: str = "text", threshold: int = 2, known: str | None = None) -> Column:
    """Languages with one strong or `threshold` distinct weak markers in the named column of prepared rows; the one in column `known` is not looked for but given."""
    given = lambda k: f"{known} <=> '{k}' OR " if known else ""
    parts = [f"IF({given(k)}{_hits(W.STRONG_MARKERS.get(k, ()), text)} >= 1 OR {_hits(W.WEAK_MARKERS.get(k, ()), text)} >= {threshold}, '{k}', NULL)" for k in LANGUAGES]
    return F.expr(f"filter(array({', '.join(parts)}), x -> x IS NOT NULL)")


def active_languages(lang: str, primary: str | None = None, text: str = "text") -> Column:
    """The given and the primary language, if known, and those with markers; French if there is none."""
    given = F.filter(F.array(F.col(lang), F.lit(primary).cast("string")), lambda x: x.isNotNull() & x.isin(*LANGUAGES))
    found = F.array_union(given, marker_languages(text, known=lang))
    return F.when(F.size(found) == 0, F.array(F.lit("fr"))).otherwise(found)


def detect(languages: Column, o: Options = Options(), text: str = "text") -> Column:
    """Raw spans of all detectors that are patterns, over prepared rows, in the order that decides ties; `families` of the options narrows them."""
    chosen = lambda rows: [D.spans_of(d, text, languages) for d in rows if D.in_families(d, o.families)]
    gate = lambda k, c: F.when(F.array_contains(languages, k), c).otherwise(F.array().cast(SPANS))
    listed = [
        lists.singleton(text, o.singleton), lists.singleton_loose(text, o.singleton),
        lists.organizations(text, o.organizations), lists.organizations_loose(text, o.organizations), lists.people(text, o.people),
        *[gate(k, lists.places(text, v)) for k, v in o.places.items()],
    ]
    dictionaries = [
        *[gate(k, lists.cities(text, v, k)) for k, v in o.cities.items()],
        *[gate(k, lists.first_names(text, v, k)) for k, v in o.first_names.items()],
        lists.makers(text, o.makers), lists.initial_surname(text, o.surnames),
    ]
    return F.flatten(F.array(*chosen(D.UNIVERSAL), *chosen(D.ADDRESS), *chosen(D.PHONE), *chosen(D.NAMES), *chosen(D.INCOTERM), *chosen(D.FISCAL_FR), *listed, *chosen(D.SITES), *dictionaries))


#: Detectors that run in order through a text: rule, family, language.
IN_ORDER = ((S.enumerated_names, "person", None), (S.order_references, "reference", None), (S.table_columns, "reference", None), (S.german_names, "person", "de"))


def refine(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """Rows with text, languages and spans: adds what the detectors in order find, then propagation, line expansions, allow list and table bodies, in one pass."""
    chosen = [(rule, language) for rule, family, language in IN_ORDER if not o.families or family in o.families]
    if not (chosen or o.propagate or o.expand or o.protect):
        return docs

    def rule(t: str, found: list[S.Span], languages: list[str]) -> list[S.Span]:
        for find, language in chosen:
            if language is None or language in languages:
                found = found + find(t)
        if o.propagate:
            found = S.propagated(t, found)
        if o.expand:
            found = S.persons_on_line(t, S.organisations_on_line(t, found))
        if o.protect:
            found = S.outside_tables(t, S.allowed(t, found, o.lexicon, o.allow_patterns), o.lexicon)
        return found

    return S.revised(docs, rule, "languages")

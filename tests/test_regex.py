"""Native spans against Python's re, and the literal prefilter."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon import fixtures
from quillon.functions import needs
from quillon.functions.regex import matches, to_java
from quillon.operators import detectors as D

TEXTS = [t for _, _, t in fixtures.DOCUMENTS] + ["", "é" * 5, "a@b.fr, x.y@z-w.org\nTél. 0123456789 née Martin", "😀 mail: a@b.co 😀 +33 1 23 45 67 89"]
RULES = [d for d in D.ALL + D.OPTIONAL if not d.build]


def expected(d, text):
    out = []
    for m in re.finditer(D.pattern_of(d.pattern), text):
        groups = d.group.split("|") if isinstance(d.group, str) else [d.group or 0]
        if g := next((g for g in groups if m[g]), None) if groups != [0] else None:
            out.append((*m.span(g), m[g]))
        elif groups == [0]:
            out.append((*m.span(), m[0]))
    return out


@pytest.mark.parametrize("part", range(6))
def test_patterns_agree_with_re(spark, part):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rules = RULES[part::6]
    found = rows.select("id", *[matches("text", D.pattern_of(d.pattern), d.group).alias(f"r{i}") for i, d in enumerate(rules)]).collect()
    for row in found:
        for i, d in enumerate(rules):
            assert [tuple(s) for s in row[f"r{i}"]] == expected(d, TEXTS[row["id"]]), (d.tag, d.pattern, row["id"])


def test_column_and_name_forms_agree(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for pattern, group in ((r"(?P<a>\d+)x?", "a"), (r"\w+@(\w+)", 1), (r"[A-Z][a-z]+", None)):
        for a, b in rows.select(matches("text", pattern, group), matches(F.col("text"), pattern, group)).collect():
            assert a == b


def test_java_syntax():
    assert to_java(r"(?i)a[b[c]\Z").pattern == r"(?diu)a[b\[c]\z"
    assert to_java(r"x(?P<v>\d)", "v") == (r"(?Udu)(x)(\d)", 1, (2,))


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(RULES), st.sampled_from(TEXTS))
def test_needed_literals_occur_in_every_match(d, text):
    pattern = D.pattern_of(d.pattern)
    for m in re.finditer(pattern, text):
        found = needs.literals(pattern)
        assert not found or any(n in m[0].lower() or n in text.lower() for n in found)
        assert not needs.needs_digit(pattern) or any(c.isdigit() for c in m[0])

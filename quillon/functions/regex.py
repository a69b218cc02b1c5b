"""Spans by regular expression as Catalyst expressions: no UDF, whole texts, offsets in code points."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.needs import first_characters

MATCH = "array<struct<start:int,end:int,text:string>>"
#: Characters of words: numbers of every kind, unlike Java's, and neither joiners nor connectors besides `_`.
WORD = r"\p{L}\p{N}\p{M}_"
EDGE = f"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


class Java(NamedTuple):
    """A pattern in Java syntax; `before` and `value` are group numbers, 0 if the whole match is kept."""

    pattern: str
    before: int
    value: tuple[int, ...]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(None)
def to_java(pattern: str, group: str | int | None = None, lead: bool = True, words: bool = False) -> Java:
    """From Python's syntax to Java's, with Unicode classes and case folding, and newline as the only line end.

    `group` names the part that is kept: a group's name, several joined by `|` (the one that took part), or 1 for the first plain group. If it stands outside other groups, what precedes it becomes
    a group too, so that its offset is known exactly. `lead` puts a test of the first characters in front where that pays, `words` writes out what a word is.
    """
    flags, body = {"u", "d"}, pattern
    while body.startswith("(?") and (end := body.find(")")) > 0 and body[2:end].isalpha():
        flags |= set(body[2:end]) & set("imsx")
        body = body[end + 1 :]
    names = set(str(group).split("|")) if isinstance(group, str) else set()
    out, i, depth, seen, at_top, kept = [], 0, 0, 0, None, []
    while i < len(body):
        c = body[i]
        if c == "\\":
            out.append("\\z" if body[i + 1] == "Z" else body[i : i + 2])
            i += 2
        elif c == "[":
            j = i + 1 + (body[i + 1] == "^")
            j += body[j] == "]"
            cls = body[i + 1 : j].replace("]", "\\]")
            while body[j] != "]":
                cls += body[j : j + 2] if body[j] == "\\" else "\\" + body[j] if body[j] in "[&" else body[j]
                j += 2 if body[j] == "\\" else 1
            out.append("[" + cls + "]")
            i = j + 1
        elif c == "(":
            name, step = None, 1
            if body.startswith("(?P<", i):
                step = body.index(">", i) - i + 1
                name = body[i + 4 : i + step - 1]
            elif body.startswith("(?", i):
                out.append("(?")
                i, depth = i + 2, depth + 1
                continue
            seen += name is None
            if name in names or (group == 1 and name is None and seen == 1):
                at_top = len(out) if depth == 0 else at_top
                kept.append(len(out))
                out.append("(")
            else:
                out.append("(?:")
            i, depth = i + step, depth + 1
        else:
            depth -= c == ")"
            out.append(c)
            i += 1
    before = 0
    if at_top is not None and len(kept) == 1 and "|" not in _top_level(out[:at_top]):
        out[at_top] = ")("
        out.insert(0, "(")
        before = 1
    joined = "".join(out)
    if lead and (start := first_characters(pattern)):
        joined = f"(?=(?iu:{start})){joined}"
    if words:
        joined = _with_words(joined)
    if any(x in joined for x in ("\\w", "\\W", "\\b", "\\B", "\\d", "\\D", "\\s", "\\S")):
        flags.add("U")
    return Java(f"(?{''.join(sorted(flags))}){joined}", before, tuple(range(1 + before, 1 + before + len(kept))))


def _with_words(java: str) -> str:
    r"""A pattern in Java syntax with \b, \w and \W written out (\W and \B not in classes or at all)."""
    out, i, inside = [], 0, False
    while i < len(java):
        c = java[i]
        if c == "\\":
            e = java[i + 1]
            out.append(WORD if inside and e == "w" else f"[{WORD}]" if e == "w" else f"[^{WORD}]" if e == "W" and not inside else EDGE if e == "b" and not inside else c + e)
            i += 2
            continue
        inside = c == "[" or inside and c != "]"
        out.append(c)
        i += 1
    return "".join(out)


def _top_level(parts: list[str]) -> str:
    depth, out = 0, []
    for p in parts:
        depth += p.startswith("(") - (p == ")")
        if not depth:
            out.append(p if p in ("|",) else "")
    return "".join(out)


def quoted(value: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: Column | str, pattern: str, group: str | int | None = None, words: bool = False) -> Column:
    """All matches as array<struct<start, end, text>>; `text` is a column, or the name of one, which is much quicker to plan.

    The i-th match starts after the first i + 1 pieces between matches and the first i matches; a running fold adds these up. Patterns must not match the empty text.
    """
    if isinstance(text, str):
        return F.expr(matches_sql(text, pattern, group, words))
    return _matches(text, to_java(pattern, group, words=words))


def matches_sql(text: str, pattern: str, group: str | int | None = None, words: bool = False) -> str:
    """The same as SQL text."""
    java = to_java(pattern, group, words=words)
    p = quoted(java.pattern)
    every = lambda g: f"regexp_extract_all({text}, {p}, {g})"
    none, start, whole = f"CAST(array() AS {MATCH})", "st.at + length(get(st.gaps, i))", "get(m, i)"
    kept = "get(st.vals, i)" if java.value else whole
    if java.before:
        first = f"{start} + length(get(st.befores, i))"
    elif java.value:
        first = f"{start} + IF(endswith({whole}, {kept}), length({whole}) - length({kept}), position({kept}, {whole}) - 1)"
    else:
        first = start
    vals = every(java.value[0]) if java.value else "CAST(array() AS array<string>)"
    if len(java.value) > 1:
        rest = ", ".join(f"nullif(get({every(g)}, k), '')" for g in java.value[1:])
        vals = f"transform({vals}, (v, k) -> coalesce(nullif(v, ''), {rest}, ''))"
    befores = every(java.before) if java.before else "CAST(array() AS array<string>)"
    return (
        f"element_at(transform(array(coalesce({every(0)}, CAST(array() AS array<string>))), m -> IF(size(m) = 0, {none}, aggregate(sequence(0, size(m) - 1), "
        f"named_struct('at', 0, 'out', {none}, 'gaps', split({text}, {p}, -1), 'vals', {vals}, 'befores', {befores}), "
        f"(st, i) -> named_struct('at', {start} + length({whole}), 'out', concat(st.out, array(named_struct('start', {first}, 'end', {first} + length({kept}), 'text', {kept}))), "
        f"'gaps', st.gaps, 'vals', st.vals, 'befores', st.befores), st -> filter(st.out, s -> s.text != '')))), 1)"
    )


def _matches(text: Column, java: Java) -> Column:
    p, none, words = F.lit(java.pattern), F.array().cast(MATCH), F.array().cast("array<string>")
    every = lambda g: F.regexp_extract_all(text, p, F.lit(g))

    def placed(m: Column) -> Column:
        def step(st: Column, i: Column) -> Column:
            start, whole = st["at"] + F.length(F.get(st["gaps"], i)), F.get(m, i)
            kept = F.get(st["vals"], i) if java.value else whole
            if java.before:
                first = start + F.length(F.get(st["befores"], i))
            else:
                first = start + F.when(F.endswith(whole, kept), F.length(whole) - F.length(kept)).otherwise(F.position(kept, whole) - 1) if java.value else start
            span = F.struct(first.alias("start"), (first + F.length(kept)).alias("end"), kept.alias("text"))
            return F.struct((start + F.length(whole)).alias("at"), F.concat(st["out"], F.array(span)).alias("out"), *[st[c].alias(c) for c in ("gaps", "vals", "befores")])

        vals = every(java.value[0]) if java.value else words
        if len(java.value) > 1:
            first = vals
            vals = F.transform(first, lambda v, k: F.coalesce(F.nullif(v, F.lit("")), *[F.nullif(F.get(every(g), k), F.lit("")) for g in java.value[1:]], F.lit("")))
        state = F.struct(F.lit(0).alias("at"), none.alias("out"), F.split(text, java.pattern, -1).alias("gaps"), vals.alias("vals"), (every(java.before) if java.before else words).alias("befores"))
        return F.when(F.size(m) == 0, none).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), state, step, lambda st: F.filter(st["out"], lambda s: s["text"] != "")))

    return let(F.coalesce(every(0), words), placed)


def before(text: Column, start: Column, n: int) -> Column:
    """The n characters before an offset."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(F.lit(n), start))


def after(text: Column, end: Column, n: int) -> Column:
    return F.substring(text, end + 1, F.lit(n))


def lines_around(text: Column, at: Column, n: int, from_start: bool = True) -> Column:
    """Text from n line ends before an offset to n + 1 after; with fewer before, from the text's start or, if not `from_start`, from the first line end."""
    head, tail = F.substring(text, F.lit(1), at), F.substring(text, at + 1, F.length(text))
    left = F.substring_index(head, "\n", -n)
    if not from_start:
        ends = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        left = F.when(ends >= n, left).when(ends == 0, F.lit("")).otherwise(F.substring(head, F.position(F.lit("\n"), head), F.length(head)))
    return F.concat(left, F.substring_index(tail, "\n", n + 1))


def digits(value: Column) -> Column:
    return F.regexp_count(value, F.lit(r"(?U)\d"))


def contains_any(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(value, F.lit(w))
    return out

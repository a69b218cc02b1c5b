"""What a text must hold for a pattern to match at all: literals found by reading the pattern, so that most texts never meet most patterns."""

from __future__ import annotations

from functools import lru_cache
from re import _constants as C
from re import _parser

#: Characters whose lower case depends on the library.
UNSURE = set("İıſKß")


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets of alternatives the more telling: longer shortest literal, then fewer."""
    rank = lambda s: (min(map(len, s)), -len(s))
    return max((x for x in (a, b) if x), key=rank, default=None)


def _required(parsed) -> frozenset[str] | None:
    best, run = None, ""

    def ended() -> None:
        nonlocal best, run
        if run:
            best = _better(best, frozenset([run]))
        run = ""

    for op, arg in parsed:
        if op is C.LITERAL and chr(arg) not in UNSURE and chr(arg).lower() not in UNSURE:
            run += chr(arg).lower()
            continue
        ended()
        inner = None
        if op is C.SUBPATTERN:
            inner = _required(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            inner = _required(arg[2])
        elif op is C.BRANCH:
            parts = [_required(p) for p in arg[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif op is C.ATOMIC_GROUP:
            inner = _required(arg)
        best = _better(best, inner)
    ended()
    return best


@lru_cache(None)
def literals(pattern: str, most: int = 60) -> tuple[str, ...]:
    """Lower-cased literals of which every match holds one; empty if there is no such set of at most `most` that tells more than a letter."""
    found = _required(_parser.parse(pattern)) or frozenset()
    short = {x for x in found if not any(y != x and y in x for y in found)}
    return tuple(sorted(short)) if short and len(short) <= most and min(map(len, short)) >= 1 and not all(len(x) == 1 and x.isspace() for x in short) else ()


def _prefixes(parsed, length: int) -> set[str] | None:
    """Strings, of `length` characters or of fewer where the rest is open (marked by a final NUL), one of which begins every match; None if that is any."""
    done: set[str] = set()
    open_: set[str] = {""}

    def extended(by: set[str]) -> None:
        nonlocal open_
        joined = {a + b for a in open_ for b in by}
        done.update(j[:length] if "\0" not in j[:length] else j[: j.index("\0") + 1] for j in joined if len(j) >= length or "\0" in j)
        open_ = {j for j in joined if len(j) < length and "\0" not in j}

    for op, arg in parsed:
        if not open_ or len(done) + len(open_) > 400:
            break
        if op is C.LITERAL:
            extended({chr(arg).lower() if len(chr(arg).lower()) == 1 else "\0"})
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            extended({chr(a).lower() if len(chr(a).lower()) == 1 else "\0" for _, a in arg})
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        elif op is C.SUBPATTERN:
            extended(_prefixes(arg[3], length) or {"\0"})
        elif op is C.BRANCH:
            extended(set().union(*(_prefixes(b, length) or {"\0"} for b in arg[1])))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
            inner = _prefixes(arg[2], length) or {"\0"}
            extended(inner | {""} if arg[0] == 0 else inner)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            extended({x if "\0" in x else x + "\0" for x in _prefixes(arg[2], length) or {"\0"}})
        else:
            extended({"\0"})
    found = done | {x + "\0" for x in open_}
    return None if len(found) > 400 else found


@lru_cache(None)
def first_characters(pattern: str) -> str | None:
    """A pattern for the first two characters of every match, as a cheap test before a pattern of many branches; None where it would tell little."""
    found = _prefixes(_parser.parse(pattern), 2)
    if not found or any(x[0] == "\0" for x in found):
        return None
    after: dict[str, set[str]] = {}
    for x in found:
        after.setdefault(x[0], set()).add(x[1])
    if len(found) < 4:
        return None
    quote = lambda c: c if c.isalnum() else "\\" + c
    return "|".join(quote(c) if "\0" in rest else f"{quote(c)}[{''.join(map(quote, sorted(rest)))}]" for c, rest in sorted(after.items()))


@lru_cache(None)
def needs_digit(pattern: str) -> bool:
    """Whether every match holds a digit."""

    def some(parsed) -> bool:
        for op, arg in parsed:
            if op is C.IN and all(o is C.CATEGORY and a is C.CATEGORY_DIGIT or o is C.RANGE and a == (48, 57) for o, a in arg):
                return True
            if op is C.LITERAL and 48 <= arg <= 57:
                return True
            if op is C.SUBPATTERN and some(arg[3]):
                return True
            if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1 and some(arg[2]):
                return True
            if op is C.BRANCH and all(some(p) for p in arg[1]):
                return True
        return False

    return some(_parser.parse(pattern))

"""Checksums and offset collectors of bank identifiers as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.regex import let
from quillon.functions.word_lists import IBAN_LENGTHS


def iban_valid(text: Column) -> Column:
    """Remainder 1 modulo 97 of the rotated number, taken digit by digit so that no large number is formed."""
    clean = F.regexp_replace(F.upper(text), r"[^A-Z0-9]", "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return let(
        clean,
        lambda x: F.length(x).between(15, 34)
        & (F.aggregate(F.split(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4)), ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1),
    )


def iban_length(country: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, n in IBAN_LENGTHS.items() for x in (k, n)]), country)


def collected(text: Column, start: Column, length: Column) -> Column:
    """From an offset, text up to the length-th letter or digit, passing over blanks and line ends; empty if something else comes first or blanks exceed the length."""
    rest = F.substring(text, start + 1, length * 2 + 1)
    got = F.call_function("regexp_extract", rest, F.concat(F.lit(r"^((?:[ \t\r\n]*[A-Za-z0-9]){"), length, F.lit("})")), F.lit(1))
    return let(got, lambda g: F.when(F.length(g) - length <= length, g).otherwise(F.lit("")))


def rib_valid(text: Column) -> Column:
    """89 * bank + 15 * branch + 3 * account + key is a multiple of 97; account letters count as digits 1 to 9."""
    clean = F.upper(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))

    def key(x: Column) -> Column:
        account = F.translate(F.substring(x, 11, 11), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "12345678912345678923456789")
        part = lambda c: F.try_to_number(c, F.lit("99999999999")).cast("bigint")
        return F.when(
            F.length(x).eqNullSafe(23) & F.regexp_like(x, F.lit(r"^[0-9]{10}[0-9A-Z]{11}[0-9]{2}$")),
            F.pmod(part(F.substring(x, 1, 5)) * 89 + part(F.substring(x, 6, 5)) * 15 + part(account) * 3 + part(F.substring(x, 22, 2)), F.lit(97)) == 0,
        ).otherwise(F.lit(False))

    return let(clean, key)

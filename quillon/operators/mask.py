"""Masking: every value gets one placeholder per document, the text is rewritten, and the vault keeps what was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import word_lists as W
from quillon.functions.regex import let, to_java

SINGLETONS = ("ORG_SINGLETON",)
ENTRY = "array<struct<placeholder:string,original:string>>"


def prefix_of(entity: Column, prefixes: dict[str, str] | None = None) -> Column:
    table = W.PLACEHOLDER_PREFIX if prefixes is None else prefixes
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), entity), entity) if table else entity


def _opaque(prefix: Column, text: Column, used: Column) -> Column:
    """Prefix and the first four hex digits of the value's SHA-256, more while they are taken, eight at most."""
    name = lambda n: F.concat(F.lit("["), prefix, F.lit("_"), F.substring(F.sha2(text.cast("binary"), 256), 1, n), F.lit("]"))
    free = lambda c: ~F.exists(used, lambda e: e["placeholder"] == c)
    out = name(8)
    for n in range(7, 3, -1):
        out = F.when(free(name(n)), name(n)).otherwise(out)
    return out


def vault_entries(spans: Column, prefixes: dict[str, str] | None = None, opaque: bool = False, singletons: tuple[str, ...] = SINGLETONS) -> Column:
    """Placeholders of a document's resolved spans in order of first appearance: array of (placeholder, original).

    A value keeps its placeholder whatever type it has later; the first type names it. Numbers count per prefix; a singleton type has none,
    so all its variants share one placeholder, which stands for the first.
    """
    state = F.struct(F.array().cast(ENTRY).alias("out"), F.create_map().cast("map<string,int>").alias("n"))

    def step(st: Column, s: Column) -> Column:
        prefix = prefix_of(s["entity_type"], prefixes)
        n = F.coalesce(F.element_at(st["n"], prefix), F.lit(0)) + 1
        numbered = F.concat(F.lit("["), prefix, F.lit("_"), n.cast("string"), F.lit("]"))
        alone = s["entity_type"].isin(*singletons) if singletons else F.lit(False)
        name = F.when(alone, F.concat(F.lit("["), prefix, F.lit("]"))).otherwise(_opaque(prefix, s["text"], st["out"]) if opaque else numbered)
        known = F.exists(st["out"], lambda e: e["original"] == s["text"])
        counted = F.map_concat(F.map_filter(st["n"], lambda k, v: k != prefix), F.create_map(prefix, n))
        return (
            F.when(known, st)
            .otherwise(F.struct(F.concat(st["out"], F.array(F.struct(name.alias("placeholder"), s["text"].alias("original")))).alias("out"), F.when(alone, st["n"]).otherwise(counted).alias("n")))
        )

    return F.aggregate(spans, state, step, lambda st: st["out"])


def with_placeholders(spans: Column, entries: Column) -> Column:
    """Spans with their placeholder in the metadata."""
    lookup = lambda s: F.get(F.filter(entries, lambda e: e["original"] == s["text"]), F.lit(0))["placeholder"]
    names = ("start", "end", "entity_type", "text", "score", "recognizer")
    return F.transform(
        spans,
        lambda s: F.struct(*[s[n].alias(n) for n in names], F.map_concat(F.map_filter(s["metadata"], lambda k, v: k != "placeholder"), F.create_map(F.lit("placeholder"), lookup(s))).alias("metadata")),
    )


def rewritten(text: Column, spans: Column, clean_orphans: bool = True) -> Column:
    """The text with each span (in order, disjoint) replaced by its placeholder; then single capitals left over after one go, if asked."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda st, s: F.struct(
        s["end"].alias("at"), F.concat(st["out"], F.array(F.substring(text, st["at"] + 1, s["start"] - st["at"]), F.element_at(s["metadata"], "placeholder"))).alias("out")
    )
    end = lambda st: F.concat(F.array_join(st["out"], ""), F.substring(text, st["at"] + 1, F.length(text)))
    out = F.aggregate(spans, state, step, end)
    if clean_orphans:
        for p in (W.TRAILING_LETTER, W.ADJACENT_LETTER):
            java = to_java(p, 1)
            out = F.regexp_replace(out, F.lit(java.pattern), F.lit(f"${java.value[0]}"))
    return out


def by_category(spans: Column) -> Column:
    """Spans per entity type: a map."""
    types = F.transform(spans, lambda s: s["entity_type"])
    count = lambda k: F.size(F.filter(types, lambda t: t == k)).cast("long")
    return let(F.array_sort(F.array_distinct(types)), lambda keys: F.map_from_arrays(keys, F.transform(keys, count)))


def mask(docs: DataFrame, prefixes: dict[str, str] | None = None, opaque: bool = False, clean_orphans: bool = True, singletons: tuple[str, ...] = SINGLETONS) -> DataFrame:
    """Adds anonymized_text, by_category and vault to rows with `text` and resolved `spans`; a projection, so no row leaves its task."""
    # bound once each: an alias used inside a lambda would otherwise be computed for every element
    keyed = let(F.col("spans"), lambda s: let(vault_entries(s, prefixes, opaque, singletons), lambda v: F.struct(v.alias("vault"), with_placeholders(s, v).alias("spans"))))
    columns = [c for c in docs.columns if c not in ("spans", "vault")]
    known = docs.withColumn("__masked", keyed).select(*columns, F.col("__masked.vault").alias("vault"), F.col("__masked.spans").alias("spans"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return known.withColumns(
        {
            "anonymized_text": let(text, lambda t: rewritten(t, F.col("spans"), clean_orphans)),
            "by_category": by_category(F.col("spans")),
        }
    )

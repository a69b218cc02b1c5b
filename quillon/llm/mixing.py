"""Mixing sources to target weights.

Tokens (words) are summed per source, targets follow from weights by filling up to a cap, and every document
is emitted floor(rate) times plus one more copy drawn from a hash of its id and text with the fraction as probability.

Defined results: a null text has no words; a null source is a source of its own, last in order; a source
without words gets target and rate 0; rows without an id, or with one id, draw by their texts, and equal rows
share one draw, so they are taken alike; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import count_words, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources up to which their table is broadcast; a row takes under 200 bytes, so the broadcast is under 2 MB.
BROADCAST_SOURCES = 10_000


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id and the text: the first 52 bits of an MD5 sum."""
    of_text = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), of_text)), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """source, source_size, target of each source in `sized(source, size)`.

    One level L gives every target as min(cap * size, weight * L): sources are ranked by how soon they
    reach their cap, and L comes from the first prefix that leaves the others below theirs. Windows run over one row
    per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    soonest = Window.orderBy((cap * F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - cap * F.col("capped")) / F.col("rest_weight"))
        .withColumn("open", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    )
    return levels.withColumn("row", F.row_number().over(soonest)).withColumn(
        "chosen", F.min(F.when(F.col("open"), F.struct("row", "level"))).over(everything)["level"]
    ).select("source", "source_size", F.least(cap * F.col("source_size"), F.col("chosen") * F.col("weight")).alias("target"))


def _with_targets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    t = targets.select(F.col("source").alias("__source"), "source_size", "target")
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    return docs.join(t, docs["__row"]["source"].eqNullSafe(t["__source"]), "left")


def _copies() -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return whole + F.when(F.col("__draw") < rate - whole, 1).otherwise(0)


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken (words taken, repeats counted)."""
    # stored, so that the texts are read once
    rows = stored(docs.select(F.struct("doc_id", "source").alias("__row"), count_words(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("__draw")))
    targets = source_targets(rows.select(F.col("__row")["source"].alias("source"), "size"), weights, cap)
    return _with_targets(rows, targets).withColumn("copies", _copies().cast("long")).select(
        F.col("__row")["doc_id"].alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"),
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed rows themselves, each as often as its plan says, with the columns of `docs`."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), draw(docs["doc_id"], docs["text"], seed).alias("__draw"))
    targets = stored(source_targets(docs.select("source", count_words(F.col("text")).alias("size")), weights, cap))
    taken = _with_targets(rows, targets).withColumn("copies", _copies().cast("int"))
    return taken.where("copies > 0").select(F.explode(F.array_repeat(F.col("__row"), F.col("copies"))).alias("__row")).select(
        *[F.col("__row")[c].alias(c) for c in docs.columns]
    )

"""Sharding by a k-d tree over document metadata.

A node is split along its widest metadata dimension at the weighted quantile that gives each side its share of the
shards, until every leaf is one shard of the target bytes. Quantiles come from distributed histograms of weights, refined until
the cut is exact in (coordinate, tie-breaker) order; the driver sees histograms of fixed size only, for all nodes of a level at once.

Dimensions are functions of the text alone, so equal texts have equal coordinates and fall together. A group of copies over
`lump` of a shard's bytes is dealt over its own tie-breakers instead: at most shards / lump groups can be that large, so
their list is broadcast. Then a cut inside them is as even as any other.

Defined results: null texts have 8 bytes and the checksum of no bytes; rows with a null id are sharded by their text and ordered
first within their shard; repeated rows fall together and get different slots; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import stored

#: Steps of a histogram, and the share of a shard by which a cut may miss its quantile.
BINS, TOLERANCE = 4096, 0.001
DIMENSIONS = ("size", "lines", "wide", "hash")


@dataclass
class Node:
    """A part of the rows: its range of shards and, once split, the dimension and the cut in (coordinate, tie) order."""

    number: int
    first: int
    shards: int
    dimension: str = ""
    cut: tuple[int, int] = (0, 0)
    left: "Node | None" = None
    right: "Node | None" = None


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the coordinates and the hash that names a group of equal texts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", t.alias("t")).select(
        "doc_id",
        (F.octet_length("t") + 8).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"),
        (F.length("t") - F.length(F.translate("t", "\n", ""))).cast("long").alias("lines"),
        (F.octet_length("t") - F.length("t")).cast("long").alias("wide"),
        F.shiftrightunsigned(F.xxhash64("t"), 24).alias("hash"),
    )


def _tied(rows: DataFrame, shards: int, lump: float) -> DataFrame:
    """Adds `tie`: the group's own hash, or for a group over `lump` of a shard a hash of the row."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = rows.groupBy("hash", "text_crc32").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > lump * total / shards)
    known = F.broadcast(large.select("hash", "text_crc32", F.lit(True).alias("large")))
    row = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("tie")), 32)
    own = F.shiftrightunsigned(F.xxhash64("hash", "text_crc32"), 32)
    return rows.join(known, ["hash", "text_crc32"], "left").withColumn("tie", F.when(F.col("large"), row).otherwise(own)).drop("large")


def _before(node: Node) -> Column:
    """Whether a row lies left of the node's cut."""
    value, tie = node.cut
    c = F.col(node.dimension)
    return (c < F.lit(value)) | ((c == F.lit(value)) & (F.col("tie") < F.lit(tie)))


def _where(node: Node, leaf) -> Column:
    """The tree as one conditional expression."""
    if node.left is None:
        return F.lit(leaf(node))
    return F.when(_before(node), _where(node.left, leaf)).otherwise(_where(node.right, leaf))


def _histogram(rows: DataFrame, at: Column, bounds: dict[int, tuple[str, int, int]]) -> dict[int, dict[int, int]]:
    """Per node the bytes in each of at most BINS equal steps of its column from low (inclusive) to high (exclusive)."""
    step = {k: max(1, -(-(hi - lo) // BINS)) for k, (_, lo, hi) in bounds.items()}
    bin_of = F.lit(None).cast("long")
    for k, (name, lo, hi) in bounds.items():
        c = F.col(name)
        inside = (F.col("__node") == k) & (c >= F.lit(lo)) & (c < F.lit(hi))
        bin_of = F.when(inside, F.floor((c - F.lit(lo)) / F.lit(step[k]))).otherwise(bin_of)
    out: dict[int, dict[int, int]] = {k: {} for k in bounds}
    got = rows.withColumn("__node", at).withColumn("__bin", bin_of).where("__bin IS NOT NULL").groupBy("__node", "__bin").agg(F.sum("size").alias("bytes"))
    for r in got.collect():
        out[r["__node"]][r["__bin"]] = r["bytes"]
    return out


def _exact(rows: DataFrame, at: Column, nodes: list[Node], spans: dict[int, dict[str, tuple[int, int]]], bytes_of: dict[int, int]) -> None:
    """Set each node's cut: first along its dimension, then along the tie-breakers of the value that the cut falls on."""
    want = {n.number: bytes_of[n.number] * (n.shards // 2) // n.shards for n in nodes}
    enough = {n.number: int(TOLERANCE * bytes_of[n.number] / n.shards) for n in nodes}
    value = _descend(rows, at, {n.number: (n.dimension, *spans[n.number][n.dimension]) for n in nodes}, want, enough)
    same = F.lit(False)
    for n in nodes:
        same = F.when(F.col("__n") == n.number, F.col(n.dimension) == F.lit(value[n.number][0])).otherwise(same)
    ties = rows.withColumn("__n", at).where(same).drop("__n")
    left = {n.number: want[n.number] - value[n.number][1] for n in nodes}
    far = [n for n in nodes if left[n.number] > enough[n.number]]
    tie = _descend(ties, at, {n.number: ("tie", 0, 1 << 32) for n in far}, left, enough)
    for n in nodes:
        n.cut = (value[n.number][0], tie[n.number][0] if n in far else 0)


def _descend(
    rows: DataFrame, at: Column, bounds: dict[int, tuple[str, int, int]], want: dict[int, int], enough: dict[int, int]
) -> dict[int, tuple[int, int]]:
    """Per node the value where the running bytes first exceed the wanted ones, to within `enough` bytes, and the bytes before it."""
    passed, found = dict.fromkeys(bounds, 0), {}
    while bounds:
        got, later = _histogram(rows, at, bounds), {}
        for k, (name, lo, hi) in bounds.items():
            step, chosen = max(1, -(-(hi - lo) // BINS)), None
            for b in sorted(got[k]):
                if passed[k] + got[k][b] > want[k]:
                    chosen = b
                    break
                passed[k] += got[k][b]
            if chosen is None:
                found[k] = (hi, passed[k])
            elif step == 1 or want[k] - passed[k] <= enough[k]:
                found[k] = (lo + chosen * step, passed[k])
            else:
                later[k] = (name, lo + chosen * step, min(hi, lo + (chosen + 1) * step))
        bounds = later
    return found


def grow(rows: DataFrame, shards: int, dimensions: tuple[str, ...] = DIMENSIONS) -> Node:
    """The tree for `rows(size, tie, dimensions...)`: level by level, all nodes of a level in the same few jobs."""
    root = Node(1, 0, shards)
    level = [root] if shards > 1 else []
    scale: dict[str, int] = {}
    while level:
        at = _where(root, lambda n: n.number)
        parts = rows.groupBy(at.alias("__node")).agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{d}_{k}") for d in dimensions for k, f in (("lo", F.min), ("hi", F.max))]
        ).collect()
        seen = {r["__node"]: r for r in parts}
        live = [n for n in level if n.number in seen]
        spans, bytes_of = {}, {}
        for n in live:
            r = seen[n.number]
            spans[n.number] = {d: (r[f"{d}_lo"], r[f"{d}_hi"] + 1) for d in dimensions}
            bytes_of[n.number] = r["bytes"]
            width = {d: hi - lo for d, (lo, hi) in spans[n.number].items()}
            scale = scale or {d: max(1, w) for d, w in width.items()}
            n.dimension = max(dimensions, key=lambda d: (width[d] / scale[d], -dimensions.index(d)))
        for n in level:
            if n not in live:
                n.dimension = dimensions[0]
        if live:
            _exact(rows, at, live, spans, bytes_of)
        after = []
        for n in level:
            k = n.shards // 2
            n.left, n.right = Node(2 * n.number, n.first, k), Node(2 * n.number + 1, n.first + k, n.shards - k)
            after += [x for x in (n.left, n.right) if x.shards > 1]
        level = after
    return root


def shard(docs: DataFrame, shards: int = 24, lump: float = 0.02, per_slice: int = 200_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Slots count on from slices of each shard, so no task sorts a whole shard.
    """
    rows = stored(_tied(stored(metadata(docs)), shards, lump))
    root = grow(rows, shards)
    n = rows.count()
    slices = max(1, -(-n // (shards * per_slice)), min(16, n // 1000))
    placed = rows.select(
        "doc_id", "size", "text_crc32", _where(root, lambda x: x.first).cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "hash"), F.lit(slices)).cast("int").alias("slice")
    )
    counts = placed.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("shard", "slice").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32")
    # one row per slice of about per_slice rows
    return placed.withColumn("at", F.row_number().over(within) - 1).join(F.broadcast(starts) if shards * slices <= 100_000 else starts, ["shard", "slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

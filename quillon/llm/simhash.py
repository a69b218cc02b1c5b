"""SimHash near-dedup by bit-sliced comparison.

1. Each text becomes a 64-bit fingerprint: a majority vote over the bits of its shingles' hashes.
2. Distinct fingerprints are put in buckets by every choice of equal blocks that the pigeonhole principle
   requires, so each pair within the radius meets in a bucket at least once. The number of blocks follows the number
   of fingerprints, which keeps buckets small; the result does not depend on it.
3. A bucket is compared bit-sliced: 64 bit planes stand vertically, one machine word holding one bit of 64
   fingerprints; a carry-save adder counts differing bits, and blocks whose 64 lanes all exceed the radius are abandoned.
   Buckets over CHUNK fingerprints are cut into pairs of chunks, compared by different tasks.
4. Each task returns a forest of stars that joins what its links join; min-label propagation with pointer jumping joins them.

Defined results: a text without words has fingerprint 0 and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows fall together by equal fingerprints; rows with a null id get the class of
their fingerprint, and null where no row of the class has an id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import small, stored

#: Fingerprints compared in one block at most, and gathered into one block at least where buckets are small.
CHUNK, GATHER = 8192, 512
#: Rows up to which a counted table is broadcast: large buckets (12 bytes a row), ids of texts to be compared (8 bytes a row).
LARGE, WANTED = 200_000, 1_000_000


def shingle_hashes(text: str | None, width: int = 4, seed: int = 42) -> list[int]:
    """Unsigned XXH64 of the word shingles of a text with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [*(s - 1 for s in starts[width:]), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes, the 64-bit word whose bits are set in over half of the group."""
    out = np.zeros(len(counts), np.uint64)
    at = 0
    for i, n in enumerate(counts):
        if n == 1:
            out[i] = hashes[at]
        elif n:
            ones = np.zeros(64, np.int64)
            for lo in range(at, at + n, 4096):
                part = hashes[lo : min(lo + 4096, at + n)]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]
        at += n
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        prints = np.zeros(len(ids), np.uint64)
        for i, text in enumerate(batch.column(1)):
            h = shingle_hashes(text.as_py(), width)
            if h:
                prints[i] = majority(np.array(h, np.uint64), np.array([len(h)]))[0]
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and its fingerprint as a signed long `fp`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lambda it: _fingerprint_batches(it, width), f"doc_id {kind}, fp long")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n words each): row b holds bit b of all fingerprints, 64 to a machine word."""
    prints = prints.reshape(len(prints), -1)
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-len(prints) // 64) * 64), np.uint8)
    padded[:, : len(prints)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def within(queries: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, fingerprint) at `radius` or fewer differing bits; fingerprints have one word or several.

    Two planes at a time pass an adder with the counter of ones; its carry ripples up vertical counters just wide enough for the radius, and
    a lane whose count goes beyond them is dead. Every few planes lanes over the radius die too, and only blocks with a live lane go on.
    """
    planes = planes_of(prints)
    n_bits, n_words, width = len(planes), planes.shape[1], int(radius + 1).bit_length()
    queries = queries.reshape(len(queries), -1)
    found_q, found_p = [], []
    for lo in range(0, len(queries), 256):
        part = np.ascontiguousarray(queries[lo : lo + 256])
        q, w = np.repeat(np.arange(len(part)), n_words), np.tile(np.arange(n_words), len(part))
        counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
        dead = np.zeros(len(q), np.uint64)
        if len(prints) % 64:
            dead[w == n_words - 1] = FULL << np.uint64(len(prints) % 64)
        set_bits = np.where(np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").T, FULL, np.uint64(0))
        for b in range(0, n_bits, 2):
            x, y = planes[b][w] ^ set_bits[b][q], planes[b + 1][w] ^ set_bits[b + 1][q]
            half = x ^ y
            carry = (x & y) | (half & counters[0])
            counters[0] ^= half
            for c in counters[1:]:
                over = c & carry
                c ^= carry
                carry = over
            dead |= carry
            if b % 8 == 6 and b >= 2 * radius or b == n_bits - 2:
                dead |= _over(counters, radius)
                live = dead != FULL
                if live.mean() < 0.7 or b == n_bits - 2:
                    q, w, dead, counters = q[live], w[live], dead[live], [c[live] for c in counters]
                    if not len(q):
                        break
        if not len(q):
            continue
        lanes = np.unpackbits((~dead).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        found_q.append(q[row] + lo)
        found_p.append(w[row] * 64 + lane)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_p)


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count exceeds the radius."""
    over, equal = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for i in range(len(counters) - 1, -1, -1):
        if (radius + 1) >> i & 1:
            equal = equal & counters[i]
        else:
            over |= equal & counters[i]
            equal = equal & ~counters[i]
    return over | equal


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n nodes reaches by the links, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            break
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _stars(prints: np.ndarray, nodes: np.ndarray, radius: int) -> pa.RecordBatch | None:
    """A link (a, b) from each node to the first that it reaches within the block. Links are folded as they are found, so a dense block holds no more than those of 256 queries."""
    root = np.arange(len(prints))
    for lo in range(0, len(prints), 256):
        a, b = within(prints[lo : lo + 256], prints, radius)
        keep = a + lo < b
        linked = np.flatnonzero(root != np.arange(len(prints)))
        root = forest(np.concatenate([linked, a[keep] + lo]), np.concatenate([root[linked], b[keep]]), len(prints))
    linked = root != np.arange(len(prints))
    if not linked.any():
        return None
    return pa.RecordBatch.from_arrays([pa.array(nodes[root[linked]]), pa.array(nodes[linked])], names=["a", "b"])


def _compare(block: pa.Table, radius: int) -> pa.RecordBatch | None:
    return _stars(block.column("fp").to_numpy().view(np.uint64), block.column("node").to_numpy(), radius)


def _block_links(batches: Iterator[pa.RecordBatch], radius: int, compare) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (bucket, block); runs of one block are gathered, small ones with their neighbours.

    Rows of different buckets that share a block may link too: what is within the radius is a link wherever it is found.
    """
    held: list[pa.RecordBatch] = []
    n, last = 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        if n > 1 and (out := compare(pa.Table.from_batches(held), radius)):
            yield out

    for batch in batches:
        bucket, block = batch.column("bucket").to_numpy(), batch.column("block").to_numpy()
        edges = np.flatnonzero((bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(bucket)]):
            if hi == lo:
                continue
            key = (bucket[lo], block[lo])
            if key != last and n >= GATHER:
                yield from flush()
                held, n = [], 0
            held.append(batch.slice(lo, hi - lo))
            n, last = n + hi - lo, key
    yield from flush()


def _blocks(n: int, radius: int) -> tuple[int, int]:
    """(blocks, of which equal): the fewest tables whose buckets hold about 4096 fingerprints or fewer."""
    for extra in range(1, 5):
        blocks = radius + extra
        if n / 2 ** (64 * extra // blocks) <= 4096:
            break
    return blocks, extra


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between nodes of `prints(fp, node)`, of distinct fp: a spanning forest of each block's links."""
    n = prints.count()
    blocks, equal = _blocks(n, radius)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(blocks), equal)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(
        "fp", "node",
        F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])).alias("bucket"),
    )
    dealt = dealt_blocks(keyed, CHUNK)
    return dealt.mapInArrow(lambda it: _block_links(it, radius, _compare), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of `edges(a, b)` reaches.

    A round takes the least label among a node and its neighbours, then the label of that label. Minima are combined before
    the shuffle and joins on a hot node are ones that Spark can split, so no node's neighbours meet in a task.
    """
    both = stored(edges.where("a != b").unionByName(edges.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels["node"] == heard["a"]).select("node", "label", F.least("label", "heard").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        after = stored(lower.join(up, "low").select("node", F.least("low", "up").alias("new"), "label"))
        labels = after.select("node", F.col("new").alias("label"))
        if after.where("new < label").isEmpty():
            return labels


def classes(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id of the class) for every row."""
    prints = stored(fingerprints(docs, width))
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # a node is known by its fingerprint, so that rows without an id still link
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    labelled = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = stored(labelled.groupBy("label").agg(F.min("least").alias("component_id")))
    of_print = labelled.select("fp", "label").join(named, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


# ---- near-duplicates by similarity -------------------------------------------------------------------------------------

#: Words of a wide fingerprint, and the chance with which a pair at the wanted similarity may be missed.
WIDE, MISS = 4, 0.02
#: Fingerprints compared in one block at most when they are wide.
WIDE_CHUNK = 4096
#: Rows and bytes of text in about one chunk of a family compared by its texts, and members of a larger family that all its chunks meet first.
FAMILY_ROWS, FAMILY_BYTES, PIVOTS = 2048, 16 << 20, 64


def wide_fingerprint(hashes: set[int]) -> np.ndarray:
    """Majority votes of WIDE families of hashes, each mixed from the shingles' own."""
    h = np.fromiter(hashes, np.uint64, len(hashes))
    out = np.zeros(WIDE, np.uint64)
    for k in range(WIDE if len(h) else 0):
        x = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[k] = majority(x ^ (x >> np.uint64(31)), np.array([len(h)]))[0]
    return out


def _wide_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text to rows with a wide fingerprint in its place."""
    for batch in batches:
        *others, texts = batch.columns
        prints = np.array([wide_fingerprint(set(shingle_hashes(t.as_py(), width))) for t in texts], np.uint64).reshape(len(batch), WIDE).view(np.int64)
        yield pa.RecordBatch.from_arrays([*others, *(pa.array(prints[:, k]) for k in range(WIDE))], names=[*batch.schema.names[:-1], *(f"f{k}" for k in range(WIDE))])


def expected_bits(similarity: float) -> float:
    """Chance that a bit differs between sets of this Jaccard similarity: the angle of vectors whose cosine is at least 2s / (1 + s)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def radius_of(similarity: float) -> int:
    """Differing bits up to which a pair may have the similarity: the mean and 2.6 deviations."""
    p, n = expected_bits(similarity), 64 * WIDE
    return int(np.ceil(n * p + 2.6 * np.sqrt(n * p * (1 - p))))


def bit_samples(n: int, similarity: float, seed: int = 11) -> list[list[int]]:
    """Masks of random bits, one list of WIDE signed words per table.

    More bits as there are more fingerprints, so that a bucket holds about 64 unrelated ones; as many tables as it takes for a pair at the similarity to agree in one but for
    a chance of MISS.
    """
    bits = int(np.clip(round(np.log2(max(n, 2) / 64)), 10, 24))
    tables = int(np.ceil(np.log(MISS) / np.log1p(-((1 - expected_bits(similarity)) ** bits))))
    rng, out = np.random.default_rng(seed), []
    for _ in range(tables):
        chosen = np.zeros(64 * WIDE, np.uint8)
        chosen[rng.choice(64 * WIDE, bits, replace=False)] = 1
        out.append(np.packbits(chosen, bitorder="little").view(np.int64).tolist())
    return out


def _compare_wide(block: pa.Table, radius: int) -> pa.RecordBatch | None:
    """Links of a block that join the families in which texts are compared."""
    block = block.sort_by("node")
    return _stars(np.stack([block.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WIDE)], axis=1), block.column("node").to_numpy(), radius)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that join the same nodes: a node keeps the edge to its least neighbour, and its other neighbours are joined to that one instead.

    Blocks that met one family give many edges to few nodes; all but one a member fall together here.
    """
    least = edges.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    others = least.where("a > least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("least").alias("a"), "b").unionByName(others).distinct()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have the Jaccard similarity."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < similarity * len(y):  # not even if one holds the other
        return False
    if not len(x):
        return True
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= similarity * (len(x) + len(y) - common)


def _compare_texts(block: pa.Table, radius: int, width: int, similarity: float) -> pa.RecordBatch | None:
    """A spanning forest of a block's pairs of the similarity: every pair within the radius is held against the texts, unless its ends are joined already."""
    prints = np.stack([block.column(f"f{k}").to_numpy().view(np.uint64) for k in range(WIDE)], axis=1)
    nodes, labels, texts = block.column("node").to_numpy(), block.column("label").to_numpy(), block.column("text")
    sets: dict[int, np.ndarray] = {}

    def set_of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(texts[i].as_py(), width)
        return sets[i]

    # rows of one label are joined beforehand
    _, first, group = np.unique(labels, return_index=True, return_inverse=True)
    root = first[group].tolist()

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    lefts, rights = [], []
    for lo in range(0, len(prints), 64):
        a, b = within(prints[lo : lo + 64], prints, radius)
        keep = a + lo < b
        a, b = a[keep] + lo, b[keep]
        for at in np.argsort(np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1), kind="stable"):
            i, j = int(a[at]), int(b[at])
            x, y = find(i), find(j)
            if x != y and similar(set_of(i), set_of(j), similarity):
                root[max(x, y)] = min(x, y)
                lefts.append(i)
                rights.append(j)
    if not lefts:
        return None
    x, y = nodes[lefts], nodes[rights]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _compare_members(members: DataFrame, radius: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) among rows `members(family, node, label, f0.., text, chunks, outer, chunks_outer)`.

    Each outer row meets every row of its family: the blocks of a family are pairs of a chunk of its outer rows and a chunk of all its rows.
    """
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    as_outer = F.pmod(F.xxhash64("node", F.lit(8)), F.col("chunks_outer")).cast("int")
    own = F.transform(F.sequence(F.lit(0), F.col("chunks_outer") - 1), lambda o: o * F.col("chunks") + mine)
    across = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: as_outer * F.col("chunks") + c)
    blocks = F.when(F.col("outer"), F.array_union(own, across)).otherwise(own)
    dealt = (
        members.withColumn("block", F.explode(blocks)).select(F.col("family").alias("bucket"), "block", "node", "label", *[f"f{k}" for k in range(WIDE)], "text")
        .repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    )
    return dealt.mapInArrow(lambda it: _block_links(it, radius, lambda block, r: _compare_texts(block, r, width, similarity)), "a long, b long").distinct()


def similar_links(found: DataFrame, nodes: DataFrame, texts: DataFrame, radius: int, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join just the nodes joined by pairs of the similarity, given `found(a, b)` that join those joined by pairs within the radius.

    A family is what `found` joins; every pair within the radius lies in one. Families of one chunk are compared whole. In a larger one about PIVOTS members first
    meet all the others, which joins most of a true class; then all members outside the largest class found meet the whole family.
    """
    names = [f"f{k}" for k in range(WIDE)]
    families = components(found).withColumnRenamed("label", "family")
    picked = families.join(nodes, "node")
    members = stored(texts.join(small(families.select(F.col("node").alias("id")), WANTED), "id", "left_semi").join(picked, F.col("id") == F.col("node")).select("family", "node", *names, "text"))
    sizes = members.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    chunks = F.ceil(F.greatest(F.col("n") / FAMILY_ROWS, F.col("bytes") / FAMILY_BYTES)).cast("int")
    large = stored(sizes.withColumn("chunks", F.greatest(chunks, F.lit(1))).where("chunks > 1").select("family", "n", "chunks"))
    cut = members.join(small(large, LARGE), "family", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("node", F.lit(9)), F.ceil(F.col("n") / PIVOTS)) == 0)
    first = cut.select("family", "node", F.col("node").alias("label"), *names, "text", "chunks", F.coalesce(pivot, F.lit(False)).alias("outer"), F.lit(1).alias("chunks_outer"))
    links = stored(_compare_members(first, radius, width, similarity))
    if large.isEmpty():
        return links
    in_large = families.join(small(large, LARGE), "family")
    labelled = stored(in_large.join(components(links), "node", "left").select("family", "node", F.coalesce("label", "node").alias("label")))
    classes_of = stored(labelled.groupBy("family", "label").agg(F.count("*").alias("size")))
    most = classes_of.groupBy("family").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("n"))
    # as many chunks of outer rows as rows of the family would fill in proportion
    split = stored(most.join(large.select("family", "chunks"), "family").where("n > top.size").select("family", "chunks", F.col("top.label").alias("top"), F.ceil((F.col("n") - F.col("top.size")) * F.col("chunks") / F.col("n")).cast("int").alias("chunks_outer")))
    if split.isEmpty():
        return links
    split_labels = labelled.join(small(split, LARGE), "family").select("node", "label", "chunks", "chunks_outer", (F.col("label") != F.col("top")).alias("outer"))
    again = members.join(small(split_labels, WANTED), "node").select("family", "node", "label", *names, "text", "chunks", "outer", "chunks_outer")
    return stored(links.unionByName(_compare_members(again, radius, width, similarity)))


def dealt_blocks(keyed: DataFrame, chunk: int) -> DataFrame:
    """Rows of `keyed(bucket, id, ...)` with a block: buckets over `chunk` rows are cut into pairs of chunks, each pair a block."""
    large = stored(keyed.groupBy("bucket").count().where(F.col("count") > chunk).select("bucket", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")))
    # at most one bucket in `chunk` rows is large: up to LARGE of them (12 bytes each) are sent to all tasks, which saves a shuffle of all rows
    cut = keyed.join(small(large, LARGE), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(mine, o) * F.col("chunks") + F.greatest(mine, o))
    return cut.withColumn("block", F.explode(blocks)).drop("chunks").repartition("bucket", "block").sortWithinPartitions("bucket", "block")


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for every row, stored so that it stays the same, and the name of that column."""
    name, taken = "row_id", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def near_rows(rows: DataFrame, row_id: str, width: int, similarity: float) -> DataFrame:
    """node (the number of the row), doc_id, label (a node of its class) of every row: texts of `similarity` or more (Jaccard, on sets of shingles of `width` words)
    share a class.

    A fingerprint of 64 bits cannot tell 0.8 from chance at a small radius, so fingerprints have WIDE words; buckets are samples of their bits; a bucket is compared bit-sliced; and in the
    families that this joins every pair within the radius is held against the texts themselves. A pair at exactly the wanted similarity is missed with a chance of about MISS.
    """
    names = [f"f{k}" for k in range(WIDE)]
    texts = rows.select(F.col(row_id).alias("id"), "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = stored(texts.mapInArrow(lambda it: _wide_batches(it, width), f"id long, doc_id {kind}, " + ", ".join(f"{n} long" for n in names)))
    nodes = stored(prints.groupBy(*names).agg(F.min("id").alias("node")))
    samples, radius = bit_samples(nodes.count(), similarity), radius_of(similarity)
    keys = [F.xxhash64(F.lit(i), *[F.col(n).bitwiseAND(F.lit(m).cast("long")) for n, m in zip(names, masks)]) for i, masks in enumerate(samples)]
    dealt = dealt_blocks(nodes.select("node", *names, F.explode(F.array(*keys)).alias("bucket")), WIDE_CHUNK)
    found = stored(contracted(dealt.mapInArrow(lambda it: _block_links(it, radius, _compare_wide), "a long, b long").distinct()))
    links = similar_links(found, nodes, texts.select("id", "text"), radius, width, similarity)
    of_print = nodes.join(components(links), "node", "left").select(*names, F.coalesce("label", "node").alias("label"))
    return prints.join(of_print, names).select(F.col("id").alias("node"), "doc_id", "label")


def near_classes(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id (the least doc_id of the class, null where no row of it has one) of every row."""
    found = stored(near_rows(*with_row_ids(docs), width, similarity))
    named = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return found.join(named, "label").select("doc_id", "component_id")


def hex_digits(fp):
    """16 lowercase hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class: one of the least doc_id, nulls last; columns as in `docs`.

    A row is known by a number of its own: rows without an id, and rows that share one, stay if their texts differ.
    """
    rows, row_id = with_row_ids(docs)
    found = near_rows(rows, row_id, width, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "node"))["node"]
    chosen = stored(found.groupBy("label").agg(first.alias(row_id)).select(row_id))
    return rows.join(small(chosen, WANTED), row_id, "left_semi").drop(row_id)

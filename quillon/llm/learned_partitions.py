"""Approximate nearest neighbours by learned partitions.

On a bounded sample: the neighbour graph is built and cut into balanced parts with few edges between them, and a small network learns, for each
vector, in which parts its neighbours lie. Every row is then indexed under its most probable part; a query goes to its most probable parts
until they hold a share of its probability, the least share that finds the wanted recall on a part of the sample kept out of training, and all
candidates there are ranked by exact inner product. The number of parts grows with the rows, up to one per PER_SAMPLE sampled vectors.

Parts that lie side by side are joined into cells where queries would visit more than VISITS of them, so a query meets about VISITS tasks at most and each returns its k best: the rows
made grow with the queries, not with the parts they ask. Inside a cell a query still meets only the parts it asks.

Skew: a cell is cut into chunks by hash of the row, and its queries into blocks, so a task reads at most about CHUNK candidates, sorted by part and held a batch at a time, and holds BLOCK
queries, however many rows are alike; candidates go only to blocks of queries that visit their cell, and of equal vectors in a batch only those that can be among the nearest are ranked.
Past CHUNK rows a cell, a query meets a task more for every further CHUNK rows of it.

Defined results: vectors that are null, zero, without components, or hold null or non-finite components, rows without
an id, and vectors not of the usual length take no part; a query's own id is never its neighbour; ties go to the smaller id; a
repeated id is two candidates; as a query it is asked once for each different vector, and each is ranked on its own; with fewer candidates
than asked for, all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample, stored

#: Candidates that a task reads and queries that it holds, rows per part, sampled vectors per part at least, and cells that a query visits in the mean.
CHUNK, BLOCK, PER_PART, PER_SAMPLE, VISITS = 1 << 20, 8192, 2048, 32, 8


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def nearest(queries: np.ndarray, candidates: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k candidates of largest inner product per query (unordered)."""
    out = []
    for lo in range(0, len(queries), 512):
        s = queries[lo : lo + 512] @ candidates.T
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def _halved(x: np.ndarray, at: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Start of the partitioning: equal shares along the direction of most spread, again and again."""
    if parts == 1:
        out[at] = first
        return
    y = x[at] - x[at].mean(axis=0)
    v = np.ones(y.shape[1])
    for _ in range(20):
        v = y.T @ (y @ v)
        v /= np.linalg.norm(v) or 1.0
    order, left = at[np.argsort(y @ v, kind="stable")], parts // 2
    cut = len(at) * left // parts
    _halved(x, order[:cut], left, first, out)
    _halved(x, order[cut:], parts - left, first + left, out)


def balanced_parts(x: np.ndarray, neighbours: np.ndarray, parts: int, rounds: int = 8, slack: float = 0.05) -> np.ndarray:
    """Cut the neighbour graph into parts of near equal size: nodes move to the part of most of their neighbours while it has room."""
    n, k = neighbours.shape
    part = np.zeros(n, np.int64)
    _halved(x, np.arange(n), parts, 0, part)
    size, room = np.bincount(part, minlength=parts), int(np.ceil(n / parts * (1 + slack)))
    low = int(n / parts * (1 - slack))
    left, right = np.repeat(np.arange(n), k), neighbours.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (left, part[right]), 1)
        np.add.at(votes, (right, part[left]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            a, b = part[i], best[i]
            if size[b] < room and size[a] > low:
                part[i] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from vector to the parts of its neighbours, and the share of probability that a query's parts must hold."""

    weights: list[np.ndarray]
    scale: float
    share: float
    width: int
    sample_recall: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        z = np.maximum(x / self.scale @ w1 + b1, 0) @ w2 + b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by falling probability, and the probability of all before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p

    @property
    def parts(self) -> int:
        return self.weights[3].shape[0]


def _learn(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 20) -> list[np.ndarray]:
    """Adam on the cross entropy between the network's parts and `target`, each row's shares of the parts."""
    parts = target.shape[1]
    w = [rng.normal(0, 1, (x.shape[1], hidden)) / np.sqrt(x.shape[1]) * 1.4, np.zeros(hidden), rng.normal(0, 0.1, (hidden, parts)), np.zeros(parts)]
    m, s = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step, steps = 0, epochs * max(1, len(x) // 128)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            at = order[lo : lo + 128]
            h = x[at] @ w[0] + w[1]
            a = np.maximum(h, 0)
            z = a @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p = (p - target[at]) / len(at)
            dh = (p @ w[2].T) * (h > 0)
            step += 1
            rate = 0.005 * max(0.05, 1 - step / (steps + 1))
            for i, g in enumerate((x[at].T @ dh, dh.sum(axis=0), a.T @ p, p.sum(axis=0))):
                m[i] += 0.1 * (g - m[i])
                s[i] += 0.001 * (g * g - s[i])
                w[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return w


def fit(vectors: DataFrame, sample_rows: int = 8192, k: int = 20, recall: float = 0.94, degree: int = 10, parts: int | None = None, seed: int = 5) -> Router | None:
    """Learn from at most `sample_rows` vectors: the bound on what the driver holds.

    The share that a query's parts must hold is the least one at which an eighth of the sample, kept out of the network's training, finds `recall` of its true neighbours in the sample.
    """
    rows = bounded_sample(vectors.select("vec_id", "embedding"), "vec_id", sample_rows).toArrow()
    found = [np.asarray(v, np.float64) for v in rows.column("embedding").to_pylist()]
    if not found:
        return None
    widths, counts = np.unique([len(v) for v in found], return_counts=True)
    width = int(widths[counts.argmax()])
    x = np.stack([v for v in found if len(v) == width])
    rng = np.random.default_rng(seed)
    scale = float(np.linalg.norm(x, axis=1).mean() / np.sqrt(width))
    wanted = parts or int(np.clip(vectors.count() // PER_PART, 4, max(4, len(x) // PER_SAMPLE)))
    parts = min(wanted, len(x) // (k + 1))
    if parts < 2:  # a part would not hold the candidates that are asked for
        return Router([np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], scale, 1.0, width, 1.0)
    graph = nearest(x, x, degree + 1)
    part = balanced_parts(x, graph, parts)
    target = np.eye(parts)[part][graph].mean(axis=1)
    out = rng.permutation(len(x))
    test, rest = out[: len(x) // 8], out[len(x) // 8 :]
    router = Router(_learn(x[rest] / scale, target[rest], rng), scale, 1.0, width, 1.0)
    home = router.probabilities(x).argmax(axis=1)
    order, before = router.ranked(x[test])
    share_of = np.empty_like(before)
    np.put_along_axis(share_of, order, before, axis=1)
    true = nearest(x[test], x, k + 1)
    need = np.take_along_axis(share_of, home[true], axis=1)[true != test[:, None]]
    # a neighbour is found if the parts before its own hold less than the share
    router.share = float(np.nextafter(np.quantile(need, recall, method="higher"), 2.0))
    router.sample_recall = float((need < router.share).mean())
    return router


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def index(vectors: DataFrame, router: Router, is_query: Column) -> DataFrame:
    """vec_id, embedding, part of every row of the usual length; `ranked` (parts by falling probability) and `probes` (how many of them it asks) for queries."""
    held = vectors.sparkSession.sparkContext.broadcast(router)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        for batch in batches:
            if not len(batch):
                continue
            order, before = r.ranked(_matrix(batch.column(1), r.width))
            probes = (before < r.share).sum(axis=1)
            ranked = [o if asked else None for o, asked in zip(order.astype(np.int32), batch.column(2).to_pylist())]
            columns = [batch.column(0), batch.column(1), pa.array(order[:, 0], pa.int32()), pa.array(ranked, pa.list_(pa.int32())), pa.array(probes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "embedding", "part", "ranked", "probes"])

    kept = vectors.schema["embedding"].dataType.simpleString()
    kept = kept if kept == "array<float>" else "array<double>"
    rows = vectors.where(F.size("embedding") == router.width).select("vec_id", F.col("embedding").cast(kept).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    return rows.mapInArrow(run, f"vec_id long, embedding {kept}, part int, ranked array<int>, probes int")


def _best_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Indices of candidates without those of equal vectors that cannot be among a query's k best.

    An id counts k times at most, and of the rest the 2k least ids leave k whichever id the query excludes.
    """
    order = np.lexsort((ids, *x.T[::-1]))
    new = np.concatenate([[True], (x[order[1:]] != x[order[:-1]]).any(axis=1)])
    if new.all():
        return np.arange(len(ids))
    new_id = new | np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]])

    def position(starts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(starts)
        return np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))

    few = position(new_id) < k
    order, new = order[few], new[few]
    return order[position(new) < 2 * k]


class _Best:
    """The k best candidates so far of a block of queries."""

    def __init__(self, queries: pa.Table, k: int, width: int) -> None:
        self.k, self.row, self.qid, self.q = k, queries.column("row").to_numpy(), queries.column("id").to_numpy(), _matrix(queries.column("embedding"), width)
        self.score, self.vec_id = np.full((len(self.q), k), -np.inf), np.zeros((len(self.q), k), np.int64)
        taken = queries.column("taken").combine_chunks()
        parts, asker = taken.flatten().to_numpy(), np.repeat(np.arange(len(self.q)), taken.value_lengths().to_numpy())
        self.asking = {p: asker[parts == p] for p in np.unique(parts)}

    def add(self, part: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Rank candidates of one part for the queries that ask it."""
        at = self.asking.get(part)
        if at is None:
            return
        kept = _best_of_equals(ids, x, self.k)
        ids, x = ids[kept], x[kept]
        step = max(1, min(1024, 2_000_000 // len(ids)))
        for lo in range(0, len(at), step):
            self._add(at[lo : lo + step], ids, x)

    def _add(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        q, k = self.q[at], self.k
        s = q @ x.T
        s[self.qid[at][:, None] == ids[None, :]] = -np.inf
        floor = self.score[at, k - 1][:, None]
        if s.shape[1] > k:
            floor = np.maximum(floor, -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
        # rounding may differ by position in a matrix product, so near ties all go on and are summed anew
        i, j = np.nonzero((s >= floor - 1e-9 * (1 + np.abs(floor))) & (s > -np.inf))
        if not len(i):
            return
        exact = np.concatenate([(q[i[a : a + 100_000]] * x[j[a : a + 100_000]]).sum(axis=1) for a in range(0, len(i), 100_000)])
        old_i, old_j = np.nonzero(self.score[at] > -np.inf)
        who, score, found = np.concatenate([old_i, i]), np.concatenate([self.score[at[old_i], old_j], exact]), np.concatenate([self.vec_id[at[old_i], old_j], ids[j]])
        order = np.lexsort((found, -score, who))
        who, score, found = who[order], score[order], found[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        best = place < k
        self.score[at[who[best]], place[best]], self.vec_id[at[who[best]], place[best]] = score[best], found[best]

    def table(self) -> pa.RecordBatch:
        i, j = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.row[i], self.qid[i], self.vec_id[i, j], self.score[i, j])], names=["row", "query_id", "vec_id", "score"])


def _rank(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query in each task's groups; rows come sorted by group and part, queries first (part -1)."""
    group, waiting, best = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        for lo, hi in zip(starts, [*starts[1:], len(batch)]):
            here, part, rows = tuple(keys[:3, lo]), int(keys[3, lo]), batch.slice(lo, hi - lo)
            if here != group:
                if best is not None:
                    yield best.table()
                group, waiting, best = here, [], None
            if part < 0:
                waiting.append(rows)
                continue
            if best is None and waiting:
                best, waiting = _Best(pa.Table.from_batches(waiting), k, width), []
            if best is not None:
                best.add(part, rows.column(5).to_numpy(), _matrix(rows.column(6), width))
    if best is not None:
        yield best.table()


def _cells(asked: DataFrame, parts: int) -> list[int]:
    """The cell of each part: as many cells as leave queries at most VISITS of them in the mean."""
    counts = [parts]
    while counts[-1] > VISITS:
        counts.append(-(-counts[-1] // 2))
    ways = [[p * c // parts for p in range(parts)] for c in counts]
    if len(ways) == 1:
        return ways[0]
    means = asked.agg(*[F.avg(F.size(_cells_of("taken", way))).alias(str(i)) for i, way in enumerate(ways)]).first()
    return next((way for way, mean in zip(ways, means) if (mean or 0) <= VISITS), ways[-1])


def _cells_of(taken: str, cell: list[int]) -> Column:
    return F.array_distinct(F.transform(taken, lambda p: F.get(F.array(*[F.lit(c) for c in cell]), p)))


def found(asked: DataFrame, rows: DataFrame, sizes: dict[int, int], k: int, router: Router) -> DataFrame:
    """row, query_id, vec_id, score: for each query of `asked` the k best of every chunk of every cell that it visits."""
    cell = _cells(asked, router.parts)
    cell_of = lambda p: F.get(F.array(*[F.lit(c) for c in cell]), p)
    visits = asked.select("row", F.col("query_id").alias("id"), "embedding", "taken", F.explode(_cells_of("taken", cell)).alias("cell"))
    asking = {r["cell"]: r["count"] for r in visits.groupBy("cell").count().collect()}
    held = [sum(sizes.get(p, 0) for p in range(router.parts) if cell[p] == c) for c in range(max(cell) + 1)]
    chunks = F.array(*[F.lit(max(1, -(-n // CHUNK))) for n in held])
    blocks = F.array(*[F.lit(-(-asking.get(c, 0) // BLOCK)) for c in range(len(held))])
    order = ["cell", "chunk", "block", "part", "row", "id", "embedding", "taken"]
    sent = (
        visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.get(chunks, "cell") - 1)))
        .withColumn("block", F.pmod(F.xxhash64("row"), F.get(blocks, "cell")).cast("int"))
        .withColumns({"part": F.lit(-1), "taken": F.filter("taken", lambda p: cell_of(p) == F.col("cell"))})
    )
    dealt = (
        rows.select(F.col("vec_id").alias("id"), "embedding", "part", cell_of(F.col("part")).alias("cell")).where(F.get(blocks, "cell") > 0)
        .withColumns({"chunk": F.pmod(F.xxhash64("id", "embedding"), F.get(chunks, "cell")).cast("int"), "row": F.lit(None).cast("long"), "taken": F.lit(None).cast("array<int>")})
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, "cell") - 1)))
    )
    keys = ["cell", "chunk", "block"]
    mixed = sent.select(*order).unionByName(dealt.select(*order)).repartition(*keys).sortWithinPartitions(*keys, "part")
    return mixed.mapInArrow(lambda batches: _rank(batches, k, router.width), "row long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 20, router: Router | None = None, **fitting) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of every query row against all other rows."""
    spark = vectors.sparkSession
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    router = router or fit(good, k=k, **fitting)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(index(good, router, is_query))
    sizes = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    # parts beyond the probes are added while those before them hold too few candidates
    size_of = F.array(*[F.lit(sizes.get(p, 0)).cast("long") for p in range(router.parts)])
    before = lambda i: F.aggregate(F.slice("ranked", 1, i), F.lit(0).cast("long"), lambda a, p: a + F.get(size_of, p))
    taken = F.filter("ranked", lambda p, i: (i < F.col("probes")) | (before(i) < 2 * k))
    once = rows.where("ranked IS NOT NULL").select(F.col("vec_id").alias("query_id"), "embedding", taken.alias("taken")).dropDuplicates(["query_id", "embedding"])
    asked = stored(once.withColumn("row", F.monotonically_increasing_id()))
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return found(asked, rows, sizes, k, router).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors: one per word and one per character n-gram of a word, each found by hash
in a table of fixed size. A softmax over two outputs is trained on top by stochastic gradient descent in numpy.
After training the table is folded with the output weights into one number per bucket, so scoring adds up numbers.

Bounds: training takes at most ``sample_rows`` labelled documents; the folded table has 2**BITS numbers (1 MB), whatever
the corpus. Defined results: null and blank texts have no features and score by the bias alone; repeated rows score alike;
without labelled rows every score is the prior of one half; rows with a null id are scored, never learned from.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_sample, id_residue

BITS = 18
GRAMS = (3, 4)
#: Words that a worker remembers, and the longest of which all n-grams are made; of longer words, words of this length are cut.
MEMO, LONG = 200_000, 40


def word_features(word: bytes) -> list[int]:
    """Buckets of a word: itself, then its n-grams with its ends marked."""
    mask, marked = (1 << BITS) - 1, b"<" + word + b">"
    out = [crc32(word) & mask]
    for n in GRAMS:
        out.extend(crc32(marked[i : i + n], n) & mask for i in range(len(marked) - n + 1))
    return out


def words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; a line's end is a word of its own, and overlong words are cut so that all of them count."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    found = data.replace(b"\n", b" <line> ").split()
    if any(len(w) > LONG for w in found):
        found = [w[i : i + LONG] for w in found for i in range(0, len(w), LONG)]
    return found


@dataclass
class Model:
    """One number per bucket, the bias, and the threshold-free logistic score."""

    weight: np.ndarray
    bias: float

    def __post_init__(self):
        self.memo: dict[bytes, tuple[float, int]] = {}

    def _of(self, word: bytes) -> tuple[float, int]:
        f = word_features(word)
        return float(self.weight[f].sum(dtype=np.float64)), len(f)

    def score(self, text: str | None) -> float:
        """Probability of label 1: the average weight of all features of the whole text, through the logistic function."""
        found = Counter(words(text))
        memo, total, n = self.memo, 0.0, 0
        if len(memo) > MEMO:
            memo.clear()
        for w, c in found.items():
            got = memo.get(w)
            if got is None:
                got = memo[w] = self._of(w)
            total += c * got[0]
            n += c * got[1]
        z = self.bias + (total / n if n else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts to (y, distinct buckets, their share of the text's features)."""
    for batch in batches:
        ids, shares = [], []
        for text in batch.column(1):
            total: Counter[int] = Counter()
            for w, c in Counter(words(text.as_py())).items():
                for f in word_features(w):
                    total[f] += c
            n = sum(total.values())
            ids.append(list(total))
            shares.append([c / n for c in total.values()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["y", "ids", "shares"]
        )


def embed(examples: list[tuple[int, np.ndarray, np.ndarray]], dim: int = 8, epochs: int = 12, rate: float = 8.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Bucket vectors and output weights by stochastic gradient descent, one document a step; classes are weighted to count alike."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << BITS, dim)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    ys = np.array([y for y, _, _ in examples])
    share = np.clip(np.array([(ys == k).mean() for k in (0, 1)]), 1e-3, None)
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            y, ids, part = examples[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(ids):
                continue
            rows = table[ids]
            h = part @ rows
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= 0.5 / share[y]
            back = out @ p
            out -= (0.02 * lr) * np.outer(h, p)
            bias -= (0.01 * lr) * p
            table[ids] = rows - (lr * part)[:, None] * back
    return table, out


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], **settings) -> Model:
    """The embedding folded with its output weights, calibrated so that scores are probabilities."""
    if not examples:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    table, out = embed(examples, **settings)
    ys = np.array([y for y, _, _ in examples])
    weight = (table @ (out[:, 1] - out[:, 0])).astype(np.float32)
    raw = np.array([float(part @ weight[ids]) if len(ids) else 0.0 for _, ids, part in examples])
    slope, offset = _calibrated(raw, ys)
    return Model((weight * slope).astype(np.float32), offset)


def _calibrated(raw: np.ndarray, ys: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of the label on the raw score, with a little ridge, by Newton steps."""
    x = np.stack([raw / max(raw.std(), 1e-9), np.ones_like(raw)], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - ys) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return max(w[0], 1e-3) / max(raw.std(), 1e-9), w[1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 3000, seed: int = 7) -> Model:
    """Learn from at most `sample_rows` labelled documents whose id does not leave 0 modulo 5."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_residue(F.col("doc_id"), 5) != 0))
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")), "doc_id", sample_rows)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("y", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("place"))
        .mapInArrow(_with_place, "y int, ids array<int>, shares array<float>, place long")
        .toArrow()
    )
    order = np.argsort(rows.column("place").to_numpy(), kind="stable")
    ys, ids, shares = rows.column("y").to_pylist(), rows.column("ids").combine_chunks(), rows.column("shares").combine_chunks()
    as_numpy = lambda a, i: a[i].values.to_numpy(zero_copy_only=False)
    return train([(int(ys[i]), as_numpy(ids, i), as_numpy(shares, i)) for i in order.tolist()], seed=seed)


def _with_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for out in _features(iter([batch])):
            yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=["y", "ids", "shares", "place"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*held.value)
        for batch in batches:
            found = pa.array([mine.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows that score `threshold` or more, with their own columns; no join, so repeated rows and null ids stay right."""
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*held.value)
        for batch in batches:
            yield batch.filter(pa.array([mine.score(t.as_py()) >= threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

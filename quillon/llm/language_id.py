"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word from both ends, labels every position with a distribution over languages, and
a document pools the log probabilities of all its positions. Its state starts anew at every white space, so equal words have equal
labels and a worker computes each once (words over CUT bytes are read in pieces of CUT). Training is backpropagation
through time in numpy on word types of a bounded sample, each weighted by how often its languages use it.

Bounds: about ``per_language`` documents a language (each taken by a hash of its id, so the number is an expected one) give at most ``types`` word types;
the network has a few thousand numbers. Defined results: a null text, or one without a letter, is `und` with score 0; repeated rows are labelled
alike; without training rows every text is `und`; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_residue

UNKNOWN = "und"
CUT, MEMO = 24, 300_000
#: Padding, beside the 256 bytes.
PAD = 256


def pieces(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, long ones cut."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if any(len(w) > CUT for w in words):
        words = [w[i : i + CUT] for w in words for i in range(0, len(w), CUT)]
    return words


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights of both directions and the output; `labels` in output order."""

    labels: list[str]
    p: dict[str, np.ndarray]
    sharpness: float = 1.0

    @classmethod
    def fresh(cls, labels: list[str], width: int, rng: np.random.Generator) -> Network:
        p = {}
        for side in "fb":
            p[f"x{side}"] = rng.normal(0, 0.3, (257, 3 * width))
            p[f"h{side}"] = rng.normal(0, 1 / np.sqrt(width), (width, 3 * width))
            p[f"c{side}"] = np.zeros(3 * width)
        p["out"] = rng.normal(0, 0.3, (2 * width, len(labels)))
        p["bias"] = np.zeros(len(labels))
        return cls(labels, {k: v.astype(np.float32) for k, v in p.items()})

    @staticmethod
    def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes by position and word, with room for both ends, and which positions are real."""
        n = max(map(len, words))
        codes = np.full((n, len(words)), PAD, np.int64)
        for j, w in enumerate(words):
            codes[: len(w), j] = np.frombuffer(w, np.uint8)
        return codes, codes != PAD

    def _run(self, codes: np.ndarray, real: np.ndarray, side: str, kept: list | None) -> np.ndarray:
        """Hidden states of one direction; padding leaves the state as it is."""
        x, u, c = self.p[f"x{side}"], self.p[f"h{side}"], self.p[f"c{side}"]
        width = u.shape[0]
        h = np.zeros((codes.shape[1], width), np.float32)
        out = np.zeros((*codes.shape, width), np.float32)
        for t in range(len(codes)) if side == "f" else range(len(codes) - 1, -1, -1):
            a, g = x[codes[t]] + c, h @ u
            z = _sigmoid(a[:, :width] + g[:, :width])
            r = _sigmoid(a[:, width : 2 * width] + g[:, width : 2 * width])
            m = np.tanh(a[:, 2 * width :] + r * g[:, 2 * width :])
            on = real[t][:, None]
            new = np.where(on, (1 - z) * h + z * m, h)
            if kept is not None:
                kept.append((t, h, z, r, m, g[:, 2 * width :], on))
            h = out[t] = new
        return out

    def positions(self, codes: np.ndarray, real: np.ndarray) -> np.ndarray:
        """log probability of every language at every position."""
        h = np.concatenate([self._run(codes, real, "f", None), self._run(codes, real, "b", None)], axis=2)
        s = h @ self.p["out"] + self.p["bias"]
        s -= s.max(axis=2, keepdims=True)
        return s - np.log(np.exp(s).sum(axis=2, keepdims=True))

    def of_words(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum of its positions' log probabilities."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for lo in range(0, len(words), 2048):
            at = order[lo : lo + 2048]
            codes, real = self.padded([words[i] for i in at])
            out[at] = np.where(real[:, :, None], self.positions(codes, real), 0).sum(axis=0)
        return out

    def gradients(self, codes: np.ndarray, real: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (weighted cross entropy, averaged over positions) and its gradients, by backpropagation through time."""
        kept: dict[str, list] = {"f": [], "b": []}
        hs = {s: self._run(codes, real, s, kept[s]) for s in "fb"}
        h = np.concatenate([hs["f"], hs["b"]], axis=2)
        s = h @ self.p["out"] + self.p["bias"]
        s -= s.max(axis=2, keepdims=True)
        e = np.exp(s)
        q = e / e.sum(axis=2, keepdims=True)
        scale = (real * weight) / max((real * weight).sum(), 1e-9)
        loss = -(scale[:, :, None] * target * np.log(np.maximum(q, 1e-9))).sum()
        ds = (scale[:, :, None] * (q - target)).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = np.einsum("tbi,tbj->ij", h, ds, optimize=True)
        grads["bias"] = ds.sum(axis=(0, 1))
        dh_all = ds @ self.p["out"].T
        width = self.p["hf"].shape[0]
        for side, part in (("f", slice(0, width)), ("b", slice(width, None))):
            u, carry = self.p[f"h{side}"], np.zeros((codes.shape[1], width), np.float32)
            for t, before, z, r, m, g3, on in reversed(kept[side]):
                d = dh_all[t][:, part] + carry
                live = np.where(on, d, 0)
                dm = live * z * (1 - m * m)
                dz = live * (m - before) * z * (1 - z)
                dr = dm * g3 * r * (1 - r)
                da = np.concatenate([dz, dr, dm], axis=1)
                dg = np.concatenate([dz, dr, dm * r], axis=1)
                np.add.at(grads[f"x{side}"], codes[t], da)
                grads[f"c{side}"] += da.sum(axis=0)
                grads[f"h{side}"] += before.T @ dg
                carry = np.where(on, live * (1 - z), d) + dg @ u.T
        return float(loss), grads


def train(types: list[tuple[bytes, np.ndarray]], labels: list[str], width: int = 16, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Network:
    """Adam on shuffled batches of word types (word, times each language used it); languages weigh alike."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, width, rng)
    if not types:
        return net
    counts = np.stack([c for _, c in types]).astype(np.float64)
    counts /= np.maximum(counts.sum(axis=0, keepdims=True), 1)
    target = (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    weight = np.sqrt(counts.sum(axis=1) / counts.sum(axis=1).mean()).astype(np.float32)
    order = np.argsort([len(w) for w, _ in types], kind="stable")
    groups = [order[lo : lo + batch] for lo in range(0, len(order), batch)]
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, steps = 0, epochs * len(groups)
    for _ in range(epochs):
        for g in rng.permutation(len(groups)):
            at = groups[g]
            codes, real = net.padded([types[i][0] for i in at])
            _, grads = net.gradients(codes, real, target[at], weight[at])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            lr = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in grads.items():
                v = v * min(1.0, 1.0 / max(norm, 1e-9))
                mean[k] += 0.1 * (v - mean[k])
                square[k] += 0.001 * (v * v - square[k])
                net.p[k] -= (lr * mean[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
    return net


def word_types(docs: DataFrame, held_modulus: int, held: int, per_language: int, types: int, seed: str) -> tuple[list[str], list[tuple[bytes, np.ndarray]]]:
    """Languages, and word types of a bounded sample with their counts per language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (id_residue(F.col("doc_id"), held_modulus) != held))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    labels = sorted(sizes)
    if not labels:
        return [], []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for k in labels for x in (k, min(1.0, per_language / sizes[k]))])
    sampled = known.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.update((lang, w) for w in pieces(text))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found]), pa.array([w for _, w in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"]
            )

    per = sampled.mapInArrow(split, "lang string, word binary, n long").groupBy("word").pivot("lang", labels).agg(F.sum("n"))
    total = sum((F.coalesce(F.col(f"`{k}`"), F.lit(0)) for k in labels), F.lit(0))
    rows = per.orderBy(-total, "word").limit(types // 2).unionByName(per.orderBy(F.xxhash64("word"), "word").limit(types // 2)).distinct().orderBy("word").collect()
    return labels, [(bytes(r["word"]), np.array([r[k] or 0 for k in labels])) for r in rows]


def fit(docs: DataFrame, held_modulus: int = 3, held: int = 1, per_language: int = 600, types: int = 8000, seed: int = 3) -> Network:
    """Learn from documents with a language whose id does not leave `held`."""
    labels, found = word_types(docs, held_modulus, held, per_language, types, f"languages {seed}")
    return train(found, labels, seed=seed)


class Labeller:
    """Labels texts; the memo recalls words labelled before."""

    def __init__(self, net: Network):
        self.net = net
        self.memo: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(net.labels)), np.float32)

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its probability per text: the sum of all positions' log probabilities over the square root of their number, through a softmax."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.net.labels:
            return labels, scores
        split = [pieces(t) if t and any(map(str.isalpha, t)) else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.rows = {}, self.rows[:0]
        new = list(set().union(*split) - self.memo.keys()) if split else []
        if new:
            self.memo.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, self.net.of_words(new)])
        for i, words in enumerate(split):
            if not words:
                continue
            total = self.rows[list(map(self.memo.__getitem__, words))].sum(axis=0, dtype=np.float64)
            z = (total - total.max()) / np.sqrt(sum(map(len, words)))
            p = np.exp(z) / np.exp(z).sum()
            best = int(p.argmax())
            labels[i], scores[i] = self.net.labels[best], float(p[best])
        return labels, scores


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                labels, scores = labeller.label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")

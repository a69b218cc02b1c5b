"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token. Tier two, for the
misses: a heap of adjacent pairs by rank over a linked list of bytes. Pre-tokens repeat, so a bounded memo per worker
holds the ids of those met before; it never decides a result, it only recalls one.

Defined results: null texts are empty; an empty text has no ids; repeated rows encode alike; a text of any length is
encoded whole; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens that a worker remembers; an entry takes about 250 bytes.
MEMO = 200_000
#: Pre-tokens over this many bytes are not remembered.
MEMO_BYTES = 64
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


@dataclass
class PerfectHash:
    """Minimal perfect hash: levels of bit arrays, each holding the keys that met no other there; a key's number is the rank of its bit."""

    sizes: list[int]
    offsets: list[int]
    bits: np.ndarray
    before: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, slack: float = 2.0) -> PerfectHash:
        left, sizes, arrays = hashes, [], []
        while len(left):
            if len(sizes) > 60:
                raise ValueError("two keys share a hash")
            size = max(64, int(slack * len(left)))
            at = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64).tolist() if sizes else []
        return cls(sizes, offsets, bits, np.cumsum(bits) - bits)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each key, from 0 without gaps; for other hashes any number, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, (size, offset) in enumerate(zip(self.sizes, self.offsets)):
            at = (_mixed(hashes[todo], level) % np.uint64(size)).astype(np.int64) + offset
            here = self.bits[at]
            out[todo[here]] = self.before[at[here]]
            todo = todo[~here]
            if not len(todo):
                break
        return out


class Codec:
    """Encodes and decodes with a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # white space by Unicode property, which leaves out the four separators that Python's \s adds
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.ranks = ranks
        keys = list(ranks)
        hashes = self._hashes(keys)
        self.hash = PerfectHash.build(hashes)
        self.key_at: list[bytes] = [b""] * len(keys)
        self.rank_at: list[int] = [0] * len(keys)
        for key, n in zip(keys, self.hash.number(hashes).tolist()):
            self.key_at[n], self.rank_at[n] = key, ranks[key]
        self.bytes_of = dict(zip(ranks.values(), ranks))
        self.memo: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _hashes(keys: Iterable[bytes]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the lowest-ranked adjacent pair, leftmost first, until none is in the table."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def resolve(self, pieces: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens: the perfect hash for all at once, the heap for what it misses."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: dict[str, tuple[int, ...]] = {}
        for piece, data, n in zip(pieces, raw, self.hash.number(self._hashes(raw)).tolist()):
            out[piece] = (self.rank_at[n],) if n >= 0 and self.key_at[n] == data else self.merge(data)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, each match of the pattern on its own."""
        pieces = self.split.findall(text or "")
        known = self.memo
        new = {p for p in pieces if p not in known}
        if new:
            found = self.resolve(list(new))
            if len(known) + len(found) > MEMO:
                known = {p: known[p] for p in set(pieces) if p in known}
                self.memo = dict(known)
            self.memo.update((p, ids) for p, ids in found.items() if len(p) <= MEMO_BYTES)
            get = known.get
            return list(chain.from_iterable([get(p) or found[p] for p in pieces]))
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[str, Codec] = {}


def codec_of(key: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec per worker process and table."""
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _table(spark, path: str, pattern: str):
    """The rank table as a broadcast: it has the size of the vocabulary file, whatever the corpus."""
    ranks = read_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode() + pattern.encode()).hexdigest()
    return key, spark.sparkContext.broadcast(ranks)


def encode_table(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of every text."""
    key, ranks = _table(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(key, ranks.value, pattern)
        for batch in batches:
            ids = pa.array([codec.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_table(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that each row's ids stand for."""
    key, ranks = _table(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(key, ranks.value, pattern)
        for batch in batches:
            data = pa.array([codec.decode(x.as_py() or ()) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes).

    Ids are made, digested and decoded in one pass, so they never leave the worker.
    """
    key, ranks = _table(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(key, ranks.value, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        decimal = {r: str(r) for r in codec.bytes_of}
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                of_ids.append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                of_bytes.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

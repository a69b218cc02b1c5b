"""Language-model scoring by context-tree weighting over bytes.

A text is read as its words with A-Z lower-cased, each followed by a space, and an end mark. Every byte is eight binary
decisions; each decision has a tree of contexts (the 0 to DEPTH bytes before), every node of which holds a
Krichevsky-Trofimov estimate. A node's weighted probability is half its own estimate plus half the product of its children's;
from these follow the weights with which a prediction mixes the estimates of all depths on its path. A context
never seen leaves its weight to the node above it.

The tree holds every context of the training texts and grows with them; no worker and not the driver holds it whole:

1. Tasks cut texts into slabs of about SLAB bytes. A slab is one row with its texts and, for each of CELLS cells, one row with its distinct grams
   (a byte and the DEPTH bytes before it) in order and how often training texts hold them. A cell has all contexts that end in some pairs of bytes, so it has
   whole subtrees below depth LOW.
2. A cell merges its rows one by one and weighs its subtrees. What the levels above need of it are sums per node of depth
   LOW - 1, of which there are at most 256 * 255 whatever the corpus; the driver weighs those.
3. A cell answers each of its rows with the log probability of every gram, and each slab is scored with its answers. Answers are rounded to 16 significant bits.

Words of the unigram base model go the same way, in cells by hash. A task holds one slab, or one cell's merged table and one row. Grams and words are
counted once a slab, so a frequent one is no more than one entry a slab.

Defined results: null texts are empty and consist of the end mark; rows with a null id are scored, never learned from, and
count as held out; repeated rows score alike and each counts in learning; a text longer than a slab is a slab of its own; an empty table gives no rows; without
training texts every bit has probability one half, and N and V are 0, which makes the base score 0; other columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import id_residue, stored

#: Depth of the tree, and depth from which on a cell has whole subtrees.
DEPTH, LOW, END = 6, 2, 10
#: Cells of grams (as many again are of words), bytes of text in a slab, and entries that a cell gathers before it merges them.
CELLS, SLAB, GATHERED = 256, 8 << 20, 1 << 21

CODEC = pa.Codec("zstd", compression_level=1)


def packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: high bytes of small numbers cost next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return struct.pack("<Q", len(values)) + CODEC.compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    (n,), width = struct.unpack("<Q", data[:8]), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    raw = CODEC.decompress(data[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as the packed differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def packed_text(data: bytes) -> bytes:
    return struct.pack("<Q", len(data)) + CODEC.compress(data, asbytes=True)


def unpacked_text(data: bytes) -> bytes:
    (n,) = struct.unpack("<Q", data[:8])
    return CODEC.decompress(data[8:], n, asbytes=True) if n else b""


def normal(text: str | None) -> bytes:
    """The symbols of a text: words with A-Z lower-cased, a space after each, and the end mark."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return b" ".join([*words, b"\n"])


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """Per symbol of all texts the number made of its `depth` bytes of context, the nearest first, and itself. A text begins in a context of end marks."""
    if not texts:
        return np.zeros(0, np.uint64)
    pad = bytes([END]) * depth
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    n = len(data) - depth
    keys = np.zeros(n, np.uint64)
    for back in [*range(1, depth + 1), 0]:
        keys <<= np.uint64(8)
        keys |= data[depth - back : depth - back + n]
    sizes = np.array([len(t) for t in texts], np.int64) + depth
    real, starts = np.ones(n, bool), np.cumsum(sizes)[:-1] - depth
    for j in range(depth):
        real[starts + j] = False
    return keys[real]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts; without counts `keys` are sorted in place."""
    if counts is None:
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def cell_of(keys: np.ndarray, depth: int) -> np.ndarray:
    """The cell of each gram, by its LOW nearest bytes of context."""
    near = keys >> np.uint64(8 * (depth - LOW + 1))
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def by_cell(keys: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that sorts keys, themselves in order, by cell, and (cell, from, to) of each cell that has any."""
    cells = cell_of(keys, depth)
    ends = np.cumsum(np.bincount(cells, minlength=CELLS))
    return np.argsort(cells, kind="stable"), [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if a < b]


def words_by_cell(words: Iterable[bytes]) -> list[tuple[int, list[bytes]]]:
    """Distinct words in order by cell."""
    out: list[list[bytes]] = [[] for _ in range(CELLS)]
    for w in words:
        out[crc32(w) % CELLS].append(w)
    return [(CELLS + i, sorted(ws)) for i, ws in enumerate(out) if ws]


_LOGS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 16)))])
_HALF_LOGS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(0, 1 << 16) + 0.5))])[: 1 << 16]


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """ln of gamma(n + 1), or of gamma(n + 1/2) / gamma(1/2): a table, then Stirling's series."""
    low = np.minimum(n, (1 << 16) - 1)
    out = (_HALF_LOGS if half else _LOGS)[low]
    big = n > low
    if big.any():
        x = n[big] + (0.5 if half else 1.0)
        out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - (0.5 * math.log(math.pi) if half else 0)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False)


def _firsts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a decision (context and the bits of the byte before it) with their zeros and ones, from grams of one depth in order."""
    node = keys >> np.uint64(8 - bit)
    first = _firsts(node)
    total = np.add.reduceat(counts, first) if len(first) else counts[:0]
    ones = np.add.reduceat(counts * ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64), first) if len(first) else counts[:0]
    return node[first], total - ones, ones


def _parent(node: np.ndarray, bit: int) -> np.ndarray:
    """The node whose context lacks the farthest byte."""
    return ((node >> np.uint64(bit + 8)) << np.uint64(bit)) | (node & np.uint64((1 << bit) - 1))


def _at_depth(keys: np.ndarray, depth: int, d: int) -> np.ndarray:
    """Grams cut to the d nearest bytes of context."""
    return ((keys >> np.uint64(8 * (depth - d + 1))) << np.uint64(8)) | (keys & np.uint64(255))


def _found(nodes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted nodes, and which of them are there."""
    if not len(nodes):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(nodes, wanted), len(nodes) - 1)
    return at, nodes[at] == wanted


def _stop(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of nodes with children, and the weight of their own estimate in it."""
    weighted = np.logaddexp(own, below) - math.log(2)
    return weighted, np.exp(np.minimum(own - math.log(2) - weighted, 0.0))


@dataclass
class Top:
    """The levels above LOW. Per bit and depth the nodes, the probability of a zero where the path ends there, and what a child starts from: the mixed estimate and the weight left."""

    nodes: list[list[np.ndarray]] = field(default_factory=lambda: [[np.zeros(0, np.uint64)] * 8 for _ in range(LOW)])
    zero: list[list[np.ndarray]] = field(default_factory=lambda: [[np.zeros(0)] * 8 for _ in range(LOW)])
    mixed: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * 8)
    left: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0)] * 8)

    @classmethod
    def of(cls, bit: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> Top:
        """From the nodes of depth LOW - 1, each with its counts and the sum of its children's weighted probabilities."""
        top = cls()
        for b in range(8):
            mine = np.flatnonzero(bit == b)
            mine = mine[np.argsort(node[mine])]
            levels = [(node[mine], zeros[mine], ones[mine], below[mine])]
            ups = []
            while len(levels) < LOW:
                n, z, o, under = levels[0]
                weighted, _ = _stop(log_kt(z, o), under)
                parents, up = np.unique(_parent(n, b), return_inverse=True)
                add = lambda v: np.bincount(up, v, len(parents))
                levels.insert(0, (parents, np.rint(add(z)).astype(np.int64), np.rint(add(o)).astype(np.int64), add(weighted)))
                ups.insert(0, up)
            mixed, left = np.zeros(len(levels[0][0])), np.ones(len(levels[0][0]))
            for d, (n, z, o, under) in enumerate(levels):
                if d:
                    mixed, left = mixed[ups[d - 1]], left[ups[d - 1]]
                kt, (_, stop) = (z + 0.5) / (z + o + 1.0), _stop(log_kt(z, o), under)
                top.nodes[d][b], top.zero[d][b] = n, mixed + left * kt
                mixed, left = mixed + left * stop * kt, left * (1 - stop)
            top.mixed[b], top.left[b] = mixed, left
        return top

    def zeros_of(self, keys: np.ndarray, depth: int, bit: int) -> np.ndarray:
        """Probability of a zero for grams whose path ends above LOW."""
        out, todo = np.full(len(keys), 0.5), np.arange(len(keys))
        for d in range(LOW - 1, -1, -1):
            at, hit = _found(self.nodes[d][bit], _at_depth(keys[todo], depth, d) >> np.uint64(8 - bit))
            out[todo[hit]] = self.zero[d][bit][at[hit]]
            todo = todo[~hit]
        return out


class Cell:
    """The subtrees of one cell, from its distinct grams in order and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.depth, self.keys = depth, keys
        self.levels = [summed(_at_depth(keys, depth, d), counts) for d in range(LOW, depth + 1)]
        self.weigh()

    def weigh(self) -> None:
        self.nodes, self.up, self.kt, self.stop, self.sums = [], [], [], [], []
        for bit in range(8):
            nodes, zeros, ones = zip(*(_nodes(k, c, bit) for k, c in self.levels))
            up = [None, *(np.searchsorted(nodes[i - 1], _parent(nodes[i], bit)) for i in range(1, len(nodes)))]
            stop, weighted = [None] * len(nodes), None
            for i in range(len(nodes) - 1, -1, -1):
                own = log_kt(zeros[i], ones[i])
                if weighted is None:
                    weighted, stop[i] = own, np.ones(len(own))
                else:
                    weighted, stop[i] = _stop(own, np.bincount(up[i + 1], weighted, len(own)))
            above, at = np.unique(_parent(nodes[0], bit), return_inverse=True)
            self.sums.append((above, *(np.bincount(at, v, len(above)) for v in (zeros[0], ones[0], weighted))))
            self.nodes.append(nodes)
            self.up.append(up)
            self.stop.append(stop)
            self.kt.append([(z + 0.5) / (z + o + 1.0) for z, o in zip(zeros, ones)])

    def predict(self, top: Top) -> None:
        """Set the probability of a zero at every node, and the log10 probability of every gram of the cell."""
        self.top, self.zero = top, []
        for bit in range(8):
            at, _ = _found(top.nodes[LOW - 1][bit], _parent(self.nodes[bit][0], bit))
            mixed, left, zero = top.mixed[bit][at], top.left[bit][at], []
            for i, (kt, stop) in enumerate(zip(self.kt[bit], self.stop[bit])):
                if i:
                    mixed, left = mixed[self.up[bit][i]], left[self.up[bit][i]]
                zero.append(mixed + left * kt)
                mixed, left = mixed + left * stop * kt, left * (1 - stop)
            self.zero.append(zero)
        self.known = self._log10(self.keys)

    def _log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        for bit in range(8):
            p, todo = np.empty(len(keys)), np.arange(len(keys))
            for d in range(self.depth, LOW - 1, -1):
                at, hit = _found(self.nodes[bit][d - LOW], _at_depth(keys[todo], self.depth, d) >> np.uint64(8 - bit))
                p[todo[hit]] = self.zero[bit][d - LOW][at[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
            p[todo] = self.top.zeros_of(keys[todo], self.depth, bit)
            one = ((keys >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            out += np.log10(np.where(one, 1.0 - p, p))
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others; keys in order are quickest."""
        at, hit = _found(self.keys, keys)
        out = np.empty(len(keys))
        out[hit] = self.known[at[hit]]
        out[~hit] = self._log10(keys[~hit])
        return out


def rounded(values: np.ndarray) -> np.ndarray:
    """Single precision numbers of 16 significant bits."""
    bits = values.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


# ---- tasks -------------------------------------------------------------------------------------------------------------

ROW = ["slab", "cell", "keys", "counts", "ids", "held", "sizes", "text"]


def _slab_rows(slab: int, ids: list, held: list[bool], texts: list[bytes], depth: int, kind: pa.DataType) -> pa.RecordBatch:
    """The row of a slab's texts, and a row per cell with its grams or words and their counts in training texts."""
    learned, rest = ([t for t, h in zip(texts, held) if h == which] for which in (False, True))
    keys, counts = summed(grams(learned, depth))
    if rest:
        trained = keys
        keys = summed(np.concatenate([keys, summed(grams(rest, depth))[0]]))[0]
        place, counts_of = np.searchsorted(keys, trained), counts
        counts = np.zeros(len(keys), np.int64)
        counts[place] = counts_of
    order, parts = by_cell(keys, depth)
    keys, counts = keys[order], counts[order].astype(np.uint32)
    rows = [(c, packed_keys(keys[a:b]), packed(counts[a:b])) for c, a, b in parts]
    words: Counter = Counter()
    for t in learned:
        words.update(t.split())
    for c, ws in words_by_cell(words.keys() | {w for t in rest for w in t.split()}):
        rows.append((c, packed_text(b" ".join(ws)), packed(np.array([words[w] for w in ws], np.uint32))))
    n = len(rows)
    last = lambda v, t: pa.concat_arrays([pa.nulls(n, t), pa.array([v], t)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([slab] * (n + 1), pa.int64()), pa.array([*(r[0] for r in rows), None], pa.int32()), pa.array([*(r[1] for r in rows), None], pa.binary()), pa.array([*(r[2] for r in rows), None], pa.binary()),
            last(ids, pa.list_(kind)), last(held, pa.list_(pa.bool_())), last([len(t) for t in texts], pa.list_(pa.int64())), last(packed_text(b"".join(texts)), pa.binary()),
        ],
        names=ROW,
    )


def _slab_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held, text) to slabs."""
    from pyspark import TaskContext

    slab = TaskContext.get().partitionId() << 32
    ids, held, texts, n, kind = [], [], [], 0, None
    for batch in batches:
        kind = batch.column(0).type
        for i, h, t in zip(batch.column(0), batch.column(1), batch.column(2)):
            ids.append(i.as_py())
            held.append(h.as_py())
            texts.append(normal(t.as_py()))
            n += len(texts[-1])
            if n >= SLAB:
                yield _slab_rows(slab, ids, held, texts, depth, kind)
                ids, held, texts, n, slab = [], [], [], 0, slab + 1
    if texts:
        yield _slab_rows(slab, ids, held, texts, depth, kind)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows in order of `cell` to runs of one cell; a run has to be read to its end before the next."""
    rows = ({n: c[i].as_py() for n, c in zip(b.schema.names, b.columns)} for b in batches for i in range(len(b)))
    ahead = next(rows, None)

    def run(cell: int) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead["cell"] == cell:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        cell = ahead["cell"]
        yield cell, run(cell)


def _merged(rows: Iterator[dict]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for r in rows:
        k, c = unpacked_keys(r["keys"]), unpacked(r["counts"], np.uint32).astype(np.int64)
        keys.append(k[c > 0])
        counts.append(c[c > 0])
        n += len(keys[-1])
        if n > GATHERED + 2 * len(keys[0]):
            k, c = summed(np.concatenate(keys), np.concatenate(counts))
            keys, counts, n = [k], [c], len(k)
    return summed(np.concatenate(keys), np.concatenate(counts))


MODEL = "cell int, keys binary, counts binary, bit int, node long, zeros long, ones long, below double"


def _model_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, keys, counts) in order of cells to one row a cell with its merged table, and rows of what the levels above need; of words, their number and sum."""
    kinds = pa.schema([("cell", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("bit", pa.int32()), ("node", pa.int64()), ("zeros", pa.int64()), ("ones", pa.int64()), ("below", pa.float64())])

    def out(cell: int, keys: bytes, counts: bytes, sums: list[tuple]) -> pa.RecordBatch:
        size = sum(len(s[1]) for s in sums)
        first = lambda v, t: pa.concat_arrays([pa.array([v], t), pa.nulls(size, t)])
        rest = lambda i, t: pa.concat_arrays([pa.nulls(1, t), pa.array(np.concatenate([s[i] for s in sums]), t)])
        bits = pa.array(np.repeat([s[0] for s in sums], [len(s[1]) for s in sums]), pa.int32())
        whole = lambda v: np.rint(v).astype(np.int64)
        sums = [(b, n.astype(np.int64), whole(z), whole(o), w.astype(np.float64)) for b, n, z, o, w in sums]
        return pa.RecordBatch.from_arrays(
            [first(cell, pa.int32()), first(keys, pa.binary()), first(counts, pa.binary()), pa.concat_arrays([pa.nulls(1, pa.int32()), bits]), rest(1, pa.int64()), rest(2, pa.int64()), rest(3, pa.int64()), rest(4, pa.float64())],
            schema=kinds,
        )

    for cell, rows in _cells(batches):
        if cell < CELLS:
            keys, counts = _merged(rows)
            if len(keys):
                yield out(cell, packed_keys(keys), packed(counts), [(b, *s) for b, s in enumerate(Cell(keys, counts, depth).sums)])
            continue
        words: Counter = Counter()
        for r in rows:
            for w, c in zip(unpacked_text(r["keys"]).split(), unpacked(r["counts"], np.uint32).tolist()):
                if c:
                    words[w] += c
        if words:
            one = np.ones(1)
            yield out(cell, packed_text(b" ".join(words)), packed(np.array(list(words.values()), np.int64)), [(8, 0 * one, len(words) * one, words.total() * one, 0 * one)])


def _answer_batches(batches: Iterator[pa.RecordBatch], top: Top, depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, slab, keys, counts) in order of cells, a cell's table first with no slab, to (slab, cell, values)."""
    for cell, rows in _cells(batches):
        words: dict[bytes, int] = {}
        tree = None
        slabs, values = [], []
        for r in rows:
            if r["slab"] is None:
                if cell < CELLS:
                    tree = Cell(unpacked_keys(r["keys"]), unpacked(r["counts"], np.int64), depth)
                    tree.predict(top)
                else:
                    words = dict(zip(unpacked_text(r["keys"]).split(), unpacked(r["counts"], np.int64).tolist()))
                continue
            if cell < CELLS:
                if tree is None:  # nothing was learned in this cell
                    tree = Cell(np.zeros(0, np.uint64), np.zeros(0, np.int64), depth)
                    tree.predict(top)
                found = packed(rounded(tree.log10(unpacked_keys(r["keys"]))))
            else:
                found = packed(np.array([words.get(w, 0) for w in unpacked_text(r["keys"]).split()], np.int64))
            slabs.append(r["slab"])
            values.append(found)
            if len(slabs) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(slabs, pa.int64()), pa.array([cell] * len(slabs), pa.int32()), pa.array(values, pa.binary())], names=["slab", "cell", "values"])
                slabs, values = [], []
        if slabs:
            yield pa.RecordBatch.from_arrays([pa.array(slabs, pa.int64()), pa.array([cell] * len(slabs), pa.int32()), pa.array(values, pa.binary())], names=["slab", "cell", "values"])


def _scores(texts: list[bytes], answers: dict[int, bytes], depth: int) -> np.ndarray:
    """log10 probability of each text from the answers to its slab's grams.

    Of 256 texts at a time grams and the text's number share a machine word, so one sort groups equal grams and keeps apart whose they are.
    """
    tagged, distinct = [], []
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        keys = grams(part, depth) << np.uint64(8)
        keys |= np.repeat(np.arange(len(part), dtype=np.uint64), [len(t) for t in part])
        keys.sort()
        tagged.append(keys)
        keys = keys >> np.uint64(8)
        distinct.append(keys[_firsts(keys)])
    known = summed(np.concatenate(distinct))[0]
    by, parts = by_cell(known, depth)
    value = np.empty(len(known), np.float32)
    for c, a, b in parts:
        value[by[a:b]] = unpacked(answers[c], np.float32)
    out = []
    for lo, keys, own in zip(range(0, len(texts), 256), tagged, distinct):
        first = _firsts(keys >> np.uint64(8))
        each = np.repeat(value[np.searchsorted(known, own)], np.diff(np.append(first, len(keys))))
        out.append(np.bincount((keys & np.uint64(255)).astype(np.uint8), each, min(256, len(texts) - lo)))
    return np.concatenate(out)


def _score_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of slabs, a slab's answers before its texts, to one row per text."""
    answers: dict[int, bytes] = {}
    for batch in batches:
        slabs, cells, values = batch.column("slab").to_pylist(), batch.column("cell").to_pylist(), batch.column("values")
        for i, (_, cell) in enumerate(zip(slabs, cells)):
            if cell is not None:
                answers[cell] = values[i].as_py()
                continue
            whole, texts, at = unpacked_text(batch.column("text")[i].as_py()), [], 0
            for size in batch.column("sizes")[i].as_py():
                texts.append(whole[at : at + size])
                at += size
            split = [t.split() for t in texts]
            count: dict[bytes, int] = {}
            for c, ws in words_by_cell(set().union(*split)):
                count.update(zip(ws, unpacked(answers[c], np.int64).tolist()))
            log = {w: math.log10(c + 0.1) for w, c in count.items()}
            ids, held = batch.column("ids")[i].values, batch.column("held")[i].as_py()
            known = [sum(count[w] > 0 for w in ws) if h else len(ws) for ws, h in zip(split, held)]
            logs = [sum(map(log.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held, pa.bool_()), pa.array(list(map(len, split)), pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(_scores(texts, answers, depth), pa.float64())],
                names=["doc_id", "held_out", "n_words", "known", "logs", "score"],
            )
            answers = {}


# ---- the operator ------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, depth: int = DEPTH, held_modulus: int = 10) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. `depth` is from LOW to 6, so that a gram and a text's number fit in a machine word."""
    if not LOW <= depth <= 6:
        raise ValueError(f"depth is from {LOW} to 6")
    held = F.coalesce(id_residue(F.col("doc_id"), held_modulus) == 0, F.lit(True))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(
        docs.select("doc_id", held.alias("held"), "text").mapInArrow(
            lambda it: _slab_batches(it, depth), f"slab long, cell int, keys binary, counts binary, ids array<{kind}>, held array<boolean>, sizes array<long>, text binary"
        )
    )
    asked, slabs = rows.where("cell IS NOT NULL"), rows.where("cell IS NULL")
    n_slabs = slabs.count()
    model = stored(asked.select("cell", "keys", "counts").repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda it: _model_batches(it, depth), MODEL))
    sums = model.where("bit IS NOT NULL").groupBy("bit", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    bit, node, zeros, ones, below = (sums.column(c).to_numpy() for c in ("bit", "node", "zeros", "ones", "below"))
    of_words = bit == 8
    v, n = int(zeros[of_words].sum()), int(ones[of_words].sum())
    tree = ~of_words
    top = docs.sparkSession.sparkContext.broadcast(Top.of(bit[tree], node[tree].astype(np.uint64), zeros[tree].astype(np.int64), ones[tree].astype(np.int64), below[tree].astype(np.float64)))
    ends = docs.where(~held).count()
    v, n = v + (ends > 0), n + ends
    tables = model.where("keys IS NOT NULL").select("cell", F.lit(None).cast("long").alias("slab"), "keys", "counts")
    answers = (
        tables.unionByName(asked.select("cell", "slab", "keys", F.lit(None).cast("binary").alias("counts"))).repartition("cell").sortWithinPartitions("cell", F.col("slab").asc_nulls_first())
        .mapInArrow(lambda it: _answer_batches(it, top.value, depth), "slab long, cell int, values binary")
    )
    whole = slabs.select("slab", "cell", F.lit(None).cast("binary").alias("values"), "ids", "held", "sizes", "text")
    scored = (
        answers.unionByName(whole, allowMissingColumns=True).repartition(max(1, n_slabs), "slab").sortWithinPartitions("slab", F.col("cell").asc_nulls_last())
        .mapInArrow(lambda it: _score_batches(it, depth), f"doc_id {kind}, held_out boolean, n_words long, known long, logs double, score double")
    )
    tokens = F.col("n_words") + 1
    return scored.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + F.lit(1 if ends else 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.lit(math.log10(ends + 0.1)) - tokens * F.lit(math.log10(n + 0.1 * (v + 1)))).alias("base_score"), "score",
    )

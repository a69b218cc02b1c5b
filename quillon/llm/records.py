"""Token ids in length-delimited binary records.

A record file holds, for each sequence: its length (8 bytes, little-endian), a masked checksum of those 8 bytes (4), the payload,
a masked checksum of the payload (4). The payload is a flag (1 byte: 0 where the key is null), the key (8 bytes, signed) and the ids (unsigned, 2 bytes each if the vocabulary has at most 65,536 ids, else 4; the index says which). The checksum is
CRC-32, rotated right by 15 bits plus a constant, so that checksums of data which itself holds checksums stay sound. An index file
beside it holds a header with the width of an id and 24 bytes per record (offset, payload length, number of ids), so that a reader
can pick records in any order without passing through the rest.

Rows are range-partitioned by doc_id and a hash of their text, so file order and order within files give ascending ids, and no id is too
frequent for a task. A task writes
under a name of its own, ended by a rename, and the manifest lists only what finished tasks returned: a task that runs again
after a loss, or twice, leaves a file nobody reads.

Defined results: null texts are empty (only the end id is written); null ids come first and read back as null; rows with equal
ids are ordered by a hash of their text, then the text; an empty table gives an empty manifest and no rows; ids that are no integers raise;
other columns are not read. What a text holds of the tokenizer's special tokens becomes their ids, as the library's own setting has it, or ordinary text if asked.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from tokenizers import Tokenizer

from quillon.llm.common import passing, shared_folder, stored

MASK, MAGIC = 0xA282EAD8, b"QREC0001"
KEY = struct.Struct("<Bq")
#: Words that a worker remembers (about 150 bytes each), and the longest of them.
MEMO, MEMO_BYTES = 800_000, 64
#: Input bytes per written file, about.
FILE_TEXT = 32 << 20


def masked(data: bytes) -> int:
    c = crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes | memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at `at` and where the next one starts; raises if a checksum or length is wrong."""
    view = memoryview(data)
    if at + 12 > len(view):
        raise ValueError(f"record at {at}: cut off")
    head = bytes(view[at : at + 8])
    (n,), (sum_of_head,) = struct.unpack("<Q", head), struct.unpack("<I", view[at + 8 : at + 12])
    if masked(head) != sum_of_head or at + 16 + n > len(view):
        raise ValueError(f"record at {at}: wrong length")
    payload = view[at + 12 : at + 12 + n]
    if masked(payload) != struct.unpack("<I", view[at + 12 + n : at + 16 + n])[0]:
        raise ValueError(f"record at {at}: wrong checksum")
    return payload, at + 16 + n


#: Marks that the pre-tokenizer always parts from a letter or digit before them.
TAIL = re.compile(rb"(?<=[a-z0-9])[.,;:!?]")
#: A character that stands between words encoded together; alone between blanks it is a token of its own.
BETWEEN = "\x01"
#: Words encoded in one call of the library.
TOGETHER = 2000


class WordTokenizer:
    """The library's tokenizer, called on distinct words only.

    Its normaliser and pre-tokenizer never reach across white space, which they drop, and part marks from the letter or
    digit before them; so the ids of a text are those of its words in order, marks apart. New words go through the library many at a time, as one text with
    a character between them whose id tells them apart. A bounded memo, kept by the worker process, holds the ids of words as little-endian bytes.
    """

    def __init__(self, text: str, special_as_text: bool = False):
        self.library = Tokenizer.from_str(text)
        self.library.encode_special_tokens = special_as_text
        self.special = [] if special_as_text else [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        mark = self.library.encode(BETWEEN, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.memo: dict[bytes, bytes] = {}

    def _together(self, words: list[bytes]) -> list[bytes]:
        texts, kind, width = [w.decode("utf-8", "replace") for w in words], f"<u{self.width}", self.width
        joined = f" {BETWEEN} ".join(texts)
        if self.mark is not None and joined.count(BETWEEN) == len(words) - 1:
            ids = np.array(self.library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, kind)
            cuts = (np.flatnonzero(ids == self.mark) * width).tolist()
            if len(cuts) == len(words) - 1:
                data = ids.tobytes()
                return [data[a:b] for a, b in zip([0, *(c + width for c in cuts)], [*cuts, len(data)])]
        return [np.array(e.ids, kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct words."""
        found: dict[bytes, bytes] = {}
        for lo in range(0, len(words), TOGETHER):
            found.update(zip(words[lo : lo + TOGETHER], self._together(words[lo : lo + TOGETHER])))
        return found

    def _words(self, text: bytes) -> list[bytes]:
        """Words of a text. The library lower-cases; doing so for A-Z here only makes more words equal, but would turn other strings into special tokens."""
        low = text.lower()
        folded = [s.lower() for s in self.special]
        if not any(s in low for s in folded):
            return TAIL.sub(rb" \g<0>", low).split()
        return [p for w in text.split() for p in ([w] if any(s in w.lower() for s in folded) else TAIL.sub(rb" \g<0>", w.lower()).split())]

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Per text its ids as little-endian unsigned numbers of `width` bytes, the end id last."""
        split = [self._words((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        new = set().union(*split) - self.memo.keys() if split else set()
        found = self.encode_words(list(new)) if new else {}
        if len(self.memo) + len(found) > MEMO:
            self.memo = {w: self.memo[w] for w in set().union(*split) if w in self.memo}
        memo = self.memo
        if found:
            memo.update((w, i) for w, i in found.items() if len(w) <= MEMO_BYTES)
        if any(len(w) > MEMO_BYTES for w in found):
            return [b"".join([*(memo[w] if w in memo else found[w] for w in words), end]) for words in split]
        get = memo.__getitem__
        return [b"".join(map(get, words)) + end for words in split]


_tokenizers: dict[tuple[int, bool], WordTokenizer] = {}


def tokenizer_of(text: str, special_as_text: bool = False) -> WordTokenizer:
    """One tokenizer and memo per worker process."""
    key = hash(text), special_as_text
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = WordTokenizer(text, special_as_text)
    return _tokenizers[key]


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; Spark's names for S3 are the library's, too."""
    scheme, mark, rest = folder.partition("://")
    return fs.FileSystem.from_uri("s3://" + rest if mark and scheme in ("s3a", "s3n") else folder)


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, special_as_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in order to one record file and its index; yields the manifest row."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    store, base = store_of(folder)
    name = f"part-{part:06d}-{uuid.uuid4().hex}"
    encoder, n, tokens, offset, index = tokenizer_of(tokenizer, special_as_text), 0, 0, 0, []
    width = encoder.width
    end = np.array([end_id], f"<u{width}").tobytes()
    out = None
    for batch in batches:
        for lo in range(0, len(batch), 512):
            ids = batch.column(0).slice(lo, 512).to_pylist()
            for key, data in zip(ids, encoder.encode(batch.column(1).slice(lo, 512).to_pylist(), end)):
                if out is None:
                    out = store.open_output_stream(f"{base}/{name}.tmp")
                payload = KEY.pack(key is not None, key or 0) + data
                record = frame(payload)
                out.write(record)
                index.append((offset, len(payload), len(data) // width))
                offset, n, tokens = offset + len(record), n + 1, tokens + len(data) // width
    if out is None:
        return
    out.close()
    with store.open_output_stream(f"{base}/{name}.idx") as side:
        side.write(MAGIC + struct.pack("<II", n, width) + np.array(index, "<u8").tobytes())
    store.move(f"{base}/{name}.tmp", f"{base}/{name}.rec")
    yield pa.RecordBatch.from_arrays(
        [pa.array([part]), pa.array([name]), pa.array([n]), pa.array([tokens]), pa.array([offset])], names=["part", "file", "n_records", "n_ids", "n_bytes"]
    )


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, parts: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Write every text of `docs` and return the manifest: part, file, n_records, n_ids, n_bytes, start (ids in earlier files).

    `tokenizer_path` is read by the driver; workers get its text, which has the size of the vocabulary.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id has to be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-size // FILE_TEXT))
    first = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(parts, first, F.col("hash").asc()).sortWithinPartitions(first, F.col("hash").asc(), F.col("text").asc_nulls_first())
    manifest = stored(
        ordered.mapInArrow(lambda it: _write_part(it, folder, tokenizer.value, end_id, special_as_text), "part long, file string, n_records long, n_ids long, n_bytes long")
    )
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_index(store: fs.FileSystem, path: str) -> tuple[np.ndarray, int]:
    """Rows (offset, payload length, number of ids) of an index file, and the width of an id."""
    with store.open_input_file(path) as f:
        data = f.read()
    n, width = struct.unpack("<II", data[8:16])
    if data[:8] != MAGIC or len(data) != 16 + 24 * n:
        raise ValueError(f"{path} is no index")
    return np.frombuffer(data, "<u8", offset=16).reshape(n, 3), width


def read_at(store: fs.FileSystem, path: str, offset: int, length: int, width: int) -> tuple[int | None, np.ndarray]:
    """One record picked through the index: its key and ids."""
    with store.open_input_file(path) as f:
        f.seek(int(offset))
        payload, _ = unframe(f.read(int(length) + 16), 0)
    known, key = KEY.unpack(payload[: KEY.size])
    return key if known else None, np.frombuffer(payload[KEY.size :], f"<u{width}").astype(np.int64)


def _read_parts(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    store, base = store_of(folder)
    for batch in batches:
        for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            index, width = read_index(store, f"{base}/{name}.idx")
            with store.open_input_file(f"{base}/{name}.rec") as f:
                for lo in range(0, len(index), 4096):
                    part = index[lo : lo + 4096]
                    first, stop = int(part[0, 0]), int(part[-1, 0] + part[-1, 1]) + 16
                    f.seek(first)
                    data = memoryview(f.read(stop - first))
                    keys, sums, at, ids = [], [], 0, []
                    for _ in range(len(part)):
                        payload, at = unframe(data, at)
                        known, key = KEY.unpack(payload[: KEY.size])
                        keys.append(key if known else None)
                        found = np.frombuffer(payload[KEY.size :], f"<u{width}")
                        sums.append(crc32(found.astype("<u4").tobytes()))
                        if with_ids:
                            ids.append(found.astype(np.int64))
                    n = part[:, 2].astype(np.int64)
                    if at != stop - first or any(width * int(c) + KEY.size != int(b) for b, c in part[:, 1:]):
                        raise ValueError(f"{name}: index and records differ")
                    starts = start + np.cumsum(n) - n
                    start = int(starts[-1] + n[-1])
                    columns = [pa.array(keys, pa.int64()), pa.array(starts), pa.array(n), pa.array(sums, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


def read(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Read every record of the listed files, each checked: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    files = manifest.select("file", "start")
    return files.repartition(max(1, files.count())).mapInArrow(
        lambda it: _read_parts(it, folder, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    )


def new_folder(spark) -> str:
    """A fresh folder below the shared one, which goes when the driver ends."""
    return passing(spark, f"{shared_folder(spark)}/records/{uuid.uuid4().hex}")

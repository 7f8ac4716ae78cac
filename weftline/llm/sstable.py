"""Token ids in sorted-string-table shards.

A shard is a file of blocks, a sparse index, a Bloom filter and a footer. Keys
are order-preserving nine-byte forms of the document identifier (a null sorts
first); an entry leaves out the bytes its key shares with the one before, but
for every sixteenth entry, whose places end the block and allow binary search
in it. The index has each block's last key, place and size. Shards hold
adjoining key ranges, so their order and the order within them is the order of
all keys.
"""

from __future__ import annotations

import io
import struct
import uuid
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from weftline.llm.shingles import mix
from weftline.llm.textids import encoder
from weftline.session import materialise, shared_dir

BLOCK_BYTES = 64 * 1024
#: Bytes of text in a shard, about.
SHARD_BYTES = 16 << 20
RESTART = 16
BITS_PER_KEY, PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQII8s")
_MAGIC = b"WEFTSST1"


def encode_key(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def decode_key(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - 2**63


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _code(key: bytes) -> int:
    """The number that a key enters the filter by."""
    return int.from_bytes(key[1:], "big") ^ (key[0] * 0xA5A5)


def _probes(codes, bits: int) -> np.ndarray:
    x = np.asarray(codes, np.uint64)
    h1, h2 = mix(x), mix(x ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h1[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(bits)


class Writer:
    """Writes one shard; keys must come in ascending order, repeated ones are kept."""

    def __init__(self, stream, width: int):
        self.out, self.width, self.at = stream, width, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.index = io.BytesIO()
        self.codes = array("Q")
        self.tokens = 0
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries, self.last = self.entries + 1, key
        self.codes.append(_code(key))
        self.tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.entries:
            raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
            data = self.pack(raw)
            self.index.write(struct.pack("<H", len(self.last)) + self.last + struct.pack("<QII", self.at, len(data), self.entries))
            self.out.write(data)
            self.at += len(data)
        self._open()

    def finish(self) -> None:
        self._close()
        index, bits = self.index.getvalue(), max(64, BITS_PER_KEY * len(self.codes))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for i in range(0, len(self.codes), 65536):
            p = _probes(self.codes[i : i + 65536], bits).ravel()
            np.bitwise_or.at(bloom, (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(_FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), bits, len(self.codes), self.tokens, self.width, 1, _MAGIC))


class Reader:
    """Reads one shard: whole in order, or by key through filter, index and block."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - _FOOTER.size)
        at, n, bloom_at, bloom_n, self.bits, self.docs, self.tokens, self.width, _, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.file.seek(at)
        raw, p, self.lasts, self.blocks = self.file.read(n), 0, [], []
        while p < len(raw):
            (k,) = struct.unpack_from("<H", raw, p)
            self.lasts.append(raw[p + 2 : p + 2 + k])
            self.blocks.append(struct.unpack_from("<QII", raw, p + 2 + k))
            p += 2 + k + 16
        self.file.seek(bloom_at)
        self.bloom = np.frombuffer(self.file.read(bloom_n), np.uint8)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def _block(self, i: int) -> tuple[bytes, list[int]]:
        at, n, _ = self.blocks[i]
        self.file.seek(at)
        raw = self.unpack(self.file.read(n))
        (r,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * r
        return raw[:end], list(struct.unpack_from(f"<{r}I", raw, end))

    @staticmethod
    def _entries(raw: bytes, at: int):
        key = b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + size]
            at += size

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self._entries(self._block(i)[0], 0)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key; the filter spares nearly all reads of absent keys."""
        p = _probes([_code(key)], self.bits)[0]
        if not ((self.bloom[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all():
            return []
        found = []
        for i in range(bisect_left(self.lasts, key), len(self.blocks)):
            raw, restarts = self._block(i)
            # Only the heads that the search touches are read.
            head = bisect_left(restarts, key, key=lambda r: next(self._entries(raw, r))[0])
            for k, v in self._entries(raw, restarts[max(0, head - 1)]):
                if k > key:
                    return found
                if k == key:
                    found.append(v)
        return found


def _write(path: str, end_id: int, folder: str):
    def run(batches):
        enc, shard = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"
        with fs.open_output_stream(f"{base}/{name}") as out:
            w, first, last = Writer(out, enc.dtype.itemsize), None, None
            for batch in batches:
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    last = encode_key(doc)
                    first = first or last
                    w.add(last, enc.packed(batch.column(1)[i].as_py()) + end)
            w.finish()
        if w.codes:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([first], pa.binary()), pa.array([last], pa.binary()), pa.array([len(w.codes)], pa.int64()), pa.array([w.tokens], pa.int64())], names=["shard", "path", "first_key", "last_key", "n_docs", "n_tokens"])

    return run


def write_tables(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids, in ascending id order, as shards into ``folder``.

    Returns (shard, path, first_key, last_key, n_docs, n_tokens), a row for each
    shard. An attempt of a task writes a file of its own name, and only files of
    committed attempts are in the result, so lost executors do no harm. A null
    text is empty and has its end id alone; rows of a null id come first; rows of
    one id, equal ones among them, each keep a place and follow each other in
    the order of a text hash. Very long texts are encoded whole, and make a block
    longer by themselves. An empty table gives an empty list, other columns are
    not looked at. The shards' folder must be in a file system that pyarrow
    opens, as all executors see it. Without ``shards`` there is one for each
    SHARD_BYTES of text.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/weftline/shards-{uuid.uuid4().hex}"
    if ":" not in folder.split("/", 1)[0]:
        # A path without a scheme belongs to the default file system, for Spark and for the writers.
        default = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        folder = f"file://{folder}" if default.startswith("file:") else default.rstrip("/") + folder
    named = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    # A row counts for more than its text, so a shard of short texts stays small too.
    n = shards or max(1, -(-(named.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 64)).first()[0] or 0) // SHARD_BYTES))
    tie = F.xxhash64("t")
    ranged = named.repartitionByRange(n, F.col("d").asc_nulls_first(), tie).sortWithinPartitions(F.col("d").asc_nulls_first(), tie)
    out = ranged.mapInArrow(_write(tokenizer_path, end_id, folder), "shard int, path string, first_key binary, last_key binary, n_docs long, n_tokens long")
    return materialise(out, "shard-list")


def _read(batches):
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            r, doc, at, n, ids, held = Reader(uri), [], [], [], [], 0
            kind = np.dtype(f"<u{r.width}")
            for key, value in r:
                v = np.frombuffer(value, kind).astype("<u4")
                doc.append(decode_key(key))
                at.append(start)
                n.append(len(v))
                ids.append(v.tobytes())
                start, held = start + len(v), held + len(v)
                if held > 1_000_000:
                    yield _rows(doc, at, n, ids)
                    doc, at, n, ids, held = [], [], [], [], 0
            yield _rows(doc, at, n, ids)


def _rows(doc, at, n, ids):
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read_tables(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents of the shards that ``write_tables`` listed.

    ``start`` counts the ids of all documents before; only the shard list, a row
    for each file, passes through the driver.
    """
    spark, start, rows = shards.sparkSession, 0, []
    for r in sorted(shards.select("shard", "path", "n_tokens").collect()):
        rows.append((r.path, start))
        start += r.n_tokens
    files = spark.createDataFrame(rows, "path string, start long").repartition(max(1, len(rows)))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def lookup(keys: DataFrame, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the asked identifiers that the shards hold, by binary search."""
    parts = sorted((bytes(r.last_key), bytes(r.first_key), r.path) for r in shards.collect())
    lasts = [p[0] for p in parts]

    def run(batches):
        opened: dict[str, Reader] = {}
        for batch in batches:
            doc, ids = [], []
            for d in batch.column(0).to_pylist():
                key = encode_key(d)
                for _, first, path in parts[bisect_left(lasts, key) :]:
                    if first > key:
                        break
                    r = opened.get(path) or opened.setdefault(path, Reader(path))
                    for v in r.get(key):
                        doc.append(d)
                        ids.append(np.frombuffer(v, f"<u{r.width}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return keys.select(F.col(id_col).cast("long").alias("d")).mapInArrow(run, "doc_id long, ids binary")

"""Shared parts of the text operators: blocks of documents, counting of hashed keys, word hashes, written tables.

**Blocks.** Several operators need, for every word, shingle or passage of a document, a figure over the whole corpus.
Documents are dealt by a hash into blocks of about `BLOCK_BYTES`. Each block sends the sorted distinct 64-bit hashes of
its keys, packed, to the bucket of that part of the hash space; the bucket adds up and answers each block in the same
order. A key of any frequency costs one entry a block, so no key makes a task large, and nothing passes the driver.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block holds on average.
BLOCK_BYTES = 8 << 20
#: Bytes of text that the numpy code works on at once; a longer document makes a longer piece.
PIECE_BYTES = 1 << 18
#: Bytes of one Arrow batch from Spark to Python, unless the session has its own; a longer row makes a longer batch.
BATCH_BYTES = 4 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        at = _own_dirs[app] = _own_dirs.get(app) or "file://" + tempfile.mkdtemp(prefix="locspark-")
    return at


_own_dirs: dict[str, str] = {}


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to `BATCH_BYTES`, unless the session has a value of its own: rows can have long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":  # Spark's default
        spark.conf.set(name, str(BATCH_BYTES))


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker goes on to other tasks and would keep the most it ever had."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def frugal(f: Callable) -> Callable:
    """`f`, after which freed memory is given back."""

    @functools.wraps(f)
    def own(*args):
        try:
            return f(*args)
        finally:
            give_back()

    return own


def base_columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key (as long) and the text (null: empty), under fixed names, whatever else the table holds."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """`df` dealt by `key` into a partition for each of its `n` values, or the session's number of partitions where that is more."""
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > 8 else 8), key)


_PACKED = pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("packed", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([compress(t) for t in texts], pa.binary())], schema=_PACKED)


def in_blocks(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, doc_id, packed) dealt by block, for `unpacked`: each text is a Zstandard frame, as texts are what is shuffled most."""
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")
    return dealt(docs.select(block.alias("block"), "doc_id", "text").mapInArrow(_pack, "block int, doc_id long, packed binary"), n_blocks, "block")


def unpacked(block: pa.Table) -> pa.Table:
    """(block, doc_id, text) of a block's rows."""
    decompress = zstandard.ZstdDecompressor().decompress
    texts = pa.array([decompress(x) for x in block["packed"].to_pylist()], pa.large_binary())
    return pa.table({"block": block["block"], "doc_id": block["doc_id"], "text": texts.cast(pa.large_string())})


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each text starts and ends in them."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: (first, last + 1, bytes, offsets)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, one place of each, and which of them stands at each place; places in no set order, which sorts faster."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], order[new], which


class NumberTable:
    """Values from 0 by non-negative 64-bit keys, for whole arrays at once: open addressing, linear probing."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those without."""
        at, mask = self._slots(keys), (1 << self.bits) - 1
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        while len(rest):
            slot = at[rest] = (at[rest] + 1) & mask
            found = self.keys[slot]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            rest = rest[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct new keys."""
        at, mask, rest = self._slots(keys), (1 << self.bits) - 1, np.arange(len(keys))
        while len(rest):
            slot = at[rest]
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[rest[free]]
            own = free & (self.keys[slot] == keys[rest])
            self.values[slot[own]] = values[rest[own]]
            rest = rest[~own]
            at[rest] = (at[rest] + 1) & mask
        self.n += len(keys)

    def clear(self) -> None:
        self.keys.fill(-1)
        self.n = 0


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse's) modulo 2**64 for i < n."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, PIECE_BYTES + 1), _BASE_INV if inverse else _BASE, U64)
        have[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(have)
    return have[:n]


def spans(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as runs of bytes that are no separators, within one text each: starts, ends, text."""
    inside = ~separator
    edge = np.zeros(len(separator) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= separator[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= separator[1:] | edge[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, by differences of one polynomial prefix sum."""
    n = len(data)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(n), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(n + 1, True)[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each word: A-Z lower-cased (or not), split at the six ASCII white-space bytes."""
    low = _LOWER[data] if lower else data
    starts, ends, doc = spans(_SPACE[low], offsets)
    return range_hashes(low, starts, ends), doc


def planes(values: np.ndarray) -> bytes:
    """Fixed-width integers as bytes, plane by plane, which the shuffle's compression likes for sorted values."""
    return values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def packed_sums(values: np.ndarray) -> bytes:
    """Sums in as many bytes each as the largest needs (4 or 8), after a byte that says how many."""
    width = 4 if values.max(initial=0) < 1 << 32 else 8
    return bytes([width]) + planes(values.astype(f"<u{width}"))


def unpacked_sums(raw: bytes) -> np.ndarray:
    return from_planes(raw[1:], np.dtype(f"<u{raw[0]}"))


REQUEST = "bucket int, block int, kind int, keys binary, counts binary"
RESPONSE = "block int, bucket int, kind int, answer binary, total long, known long"


def bucket_edges(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Where the buckets begin and end among sorted keys: a bucket is a range of the hash space."""
    first = np.array([(b << 64) // n_buckets + (1 if (b << 64) % n_buckets else 0) for b in range(1, n_buckets)], U64)
    return np.concatenate(([0], np.searchsorted(keys, first), [len(keys)])).astype(np.int64)


def requests(keys: np.ndarray, counts: np.ndarray, block: int, kind: int, n_buckets: int) -> dict[str, list]:
    """Sorted distinct keys with their counts, cut up by bucket."""
    edges = bucket_edges(keys, n_buckets)
    used = np.flatnonzero(np.diff(edges))
    cut = [(int(edges[b]), int(edges[b + 1])) for b in used]
    return {
        "bucket": [int(b) for b in used], "block": [block] * len(used), "kind": [kind] * len(used),
        "keys": [planes(keys[a:z]) for a, z in cut], "counts": [planes(counts[a:z]) for a, z in cut],
    }


def joined(parts: list[dict[str, list]], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([v for p in parts for v in p[f.name]], f.type) for f in schema}, schema=schema)


_REQUEST = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_RESPONSE = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("answer", pa.binary()), ("total", pa.int64()), ("known", pa.int64())])


@frugal
def _answer(table: pa.Table) -> pa.Table:
    """Adds up one bucket and one kind of key; each block gets the sums of its keys in its own order."""
    blocks = table["block"].to_pylist()
    keys = [from_planes(x, np.uint64) for x in table["keys"].to_pylist()]
    counts = [from_planes(x, np.uint32) for x in table["counts"].to_pylist()]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(where, np.concatenate(counts), len(distinct))
    total, known = int(sums.sum()), int((sums > 0).sum())
    sums = sums.astype(np.uint64)[where]
    at = np.cumsum([0, *map(len, keys)])
    n = len(blocks)
    return pa.table({
        "block": pa.array(blocks, pa.int32()), "bucket": table["bucket"].combine_chunks(), "kind": table["kind"].combine_chunks(),
        "answer": pa.array([packed_sums(sums[at[i] : at[i + 1]]) for i in range(n)], pa.binary()),
        "total": pa.array([total] + [0] * (n - 1), pa.int64()), "known": pa.array([known] + [0] * (n - 1), pa.int64()),
    }, schema=_RESPONSE)


def count_keys(blocks: DataFrame, extract: Callable[..., list[tuple[int, np.ndarray, np.ndarray]]], n_buckets: int, seen: DataFrame | None = None) -> DataFrame:
    """For each block, the corpus-wide sums of its keys' counts.

    extract: of a block's table, and of the answers it has in `seen` if that is given, (kind, sorted distinct keys, counts).
    """

    @frugal
    def ask(table: pa.Table, known: pa.Table | None = None) -> pa.Table:
        block = table["block"][0].as_py()
        found = extract(unpacked(table)) if known is None else extract(unpacked(table), known)
        return joined([requests(k, c.astype(np.uint32), block, kind, n_buckets) for kind, k, c in found], _REQUEST)

    groups = blocks.groupBy("block")
    asked = groups.applyInArrow(lambda t: ask(t), REQUEST) if seen is None else groups.cogroup(seen.groupBy("block")).applyInArrow(lambda t, k: ask(t, k), REQUEST)
    return dealt(asked, n_buckets, "bucket").groupBy("bucket", "kind").applyInArrow(lambda t: _answer(t), RESPONSE)


def answers(table: pa.Table, kind: int) -> np.ndarray:
    """The sums for a block's sorted distinct keys of one kind."""
    rows = sorted((b, a) for b, k, a in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["answer"].to_pylist()) if k == kind)
    return np.concatenate([unpacked_sums(a) for _, a in rows]) if rows else np.zeros(0, np.uint32)

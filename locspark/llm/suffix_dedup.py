"""Removal of repeated passages by two-stage suffix sorting.

A byte goes if some `min_bytes`-byte string over it also starts anywhere else in the corpus. To bring equal strings
together without a global sort, every window of `min_bytes` bytes owns an anchor: the place of the smallest hash of
`GRAM` bytes within it, the rightmost of equals. Equal windows have equal anchors at equal offsets, so:

1. anchors are counted over the corpus; only windows whose anchor occurs twice can repeat,
2. the windows of one such anchor form a context (a run of starts and the bytes under them); equal contexts are merged
   with a count before the sort, in their block and where they meet, so that copies are sorted once: all windows of a
   context that stands at two places repeat by that count alone,
3. contexts that share anchors meet in one task, which sorts the suffixes of the distinct ones in two stages: those smaller
   than their successor directly, the others by scans over the buckets of first bytes; windows repeat where neighbours in
   the sorted order have `min_bytes` bytes in common,
4. the intervals go back to their documents.

An anchor that occurs over `hot_anchor` times (a passage in very many documents) isn't gathered in one task: its windows
are sent one by one, under the hash of the whole window, and equal ones are sent once a block.

Nulls and empty texts have no bytes and lose none. Repeated rows are two places of the same text, so they lose all that
is at least `min_bytes` long. Rows with a null doc_id are handled like others. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

GRAM = 64
HOT_ANCHOR = 100_000


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    total = np.zeros(len(data) + 1, common.U64)
    np.cumsum((data.astype(common.U64) + common.U64(1)) * common.powers(len(data)), out=total[1:])
    return common.mix((total[gram:] - total[:-gram]) * common.powers(n, True))


def _window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of the smallest, the rightmost of equals."""
    n = len(h) - width + 1
    low, step = h.copy(), 1
    where = np.arange(len(h), dtype=np.int32)
    while step * 2 <= width:
        a, b, wa, wb = low[:-step], low[step:], where[:-step], where[step:]
        right = b <= a
        low, where = np.where(right, b, a), np.where(right, wb, wa)
        step *= 2
    a, b, wa, wb = low[:n], low[width - step : width - step + n], where[:n], where[width - step : width - step + n]
    return np.where(b <= a, wb, wa)


def _runs(data: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of one text: anchor hash, first window start, number of windows."""
    h = _gram_hashes(data, gram)
    where = _window_anchors(h, min_bytes - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    return h[where[first]], first, np.diff(np.concatenate((first, [len(where)])))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _texts(table: pa.Table) -> list[tuple[int, bytes]]:
    """(row key, bytes) of a block's rows; the key joins the id and the text, so that repeated ids do no harm."""
    return [(xxhash.xxh3_64_intdigest(t, seed=(i or 0) & (2**64 - 1)), t) for i, t in zip(table["doc_id"].to_pylist(), table["text"].cast(pa.large_binary()).to_pylist())]


def _anchors(table: pa.Table, min_bytes: int, gram: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    found = [_runs(np.frombuffer(t, np.uint8), min_bytes, gram)[0] for t in table["text"].cast(pa.large_binary()).to_pylist() if len(t) >= min_bytes]
    keys, counts = np.unique(np.concatenate(found) if found else np.zeros(0, common.U64), return_counts=True)
    return [(0, keys, counts)]


CONTEXT = "bucket int, anchor long, context binary, bytes binary, block int, rows binary, places binary"
_CONTEXT = pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("context", pa.binary()), ("bytes", pa.binary()), ("block", pa.int32()), ("rows", pa.binary()), ("places", pa.binary())])
INTERVAL = "block int, rows binary, lo binary, hi binary"
_INTERVAL = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary())])


@common.frugal
def _contexts(docs: pa.Table, seen: pa.Table, min_bytes: int, gram: int, n_buckets: int, hot_anchor: int) -> pa.Table:
    """A block's distinct contexts of repeated anchors, with the places of each."""
    texts = [x for x in (_texts(docs) if docs.num_rows else []) if len(x[1]) >= min_bytes]
    runs = [_runs(np.frombuffer(t, np.uint8), min_bytes, gram) for _, t in texts]
    keys = np.unique(np.concatenate([r[0] for r in runs]) if runs else np.zeros(0, common.U64))
    counts = common.answers(seen, 0)
    found: dict[bytes, list] = {}
    for (row, t), (h, first, n) in zip(texts, runs):
        times = counts[np.searchsorted(keys, h)]
        for k in np.flatnonzero(times > 1):
            a, z = int(first[k]), int(n[k])
            cut = [(a, z)] if times[k] <= hot_anchor else [(x, 1) for x in range(a, a + z)]
            for at, many in cut:
                raw = t[at : at + many - 1 + min_bytes]
                key = xxhash.xxh3_128_digest(raw)
                own = found.get(key)
                if own is None:
                    # a window of a hot anchor meets only equal windows, in a group of its own
                    group = int(h[k]) if times[k] <= hot_anchor else xxhash.xxh3_64_intdigest(key)
                    own = found[key] = [group, raw, [], []]
                own[2].append(row)
                own[3].append(at)
    block = docs["block"][0].as_py() if docs.num_rows else 0
    n = len(found)
    anchors = np.array([x[0] for x in found.values()], np.uint64)
    return pa.table([
        pa.array((anchors % common.U64(n_buckets)).astype(np.int32), pa.int32()), pa.array(anchors.view(np.int64), pa.int64()), pa.array(list(found), pa.binary()), pa.array([x[1] for x in found.values()], pa.binary()),
        pa.array([block] * n, pa.int32()), pa.array([np.array(x[2], np.uint64).tobytes() for x in found.values()], pa.binary()), pa.array([np.array(x[3], np.int32).tobytes() for x in found.values()], pa.binary()),
    ], schema=_CONTEXT)


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage suffix sorting of the places marked in `wanted`, by `depth` bytes at least.

    `text` has the bytes plus one, and a 0 after each string. First stage: suffixes smaller than their successor are
    sorted directly. Second stage: in a scan over the buckets of first bytes, from small to large, each sorted suffix
    gives its predecessor the next free place in that one's bucket, if the predecessor is the larger of the two.
    """
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int16)))
    turns = np.flatnonzero(step)
    smaller = np.zeros(n, bool)
    if len(turns):
        smaller[: turns[-1] + 1] = np.repeat(step[turns] > 0, np.diff(turns, prepend=-1))
    # a larger suffix is placed by its successor: go on from the last wanted place to the next smaller suffix or the end
    ends = np.flatnonzero(smaller | (text == 0))
    need = wanted.copy()
    last = np.flatnonzero(wanted & ~np.concatenate((wanted[1:], [False])))
    stop = ends[np.searchsorted(ends, last)]
    for back in range(1, int((stop - last).max(initial=0)) + 1):
        need[last[stop - last >= back] + back] = True
    direct = np.flatnonzero(need & smaller & (text > 0))
    raw = np.zeros(n + depth, np.uint8)
    raw[:n] = np.maximum(text, 1) - 1
    strings = np.ndarray((n,), f"S{depth}", raw.tobytes(), strides=(1,))
    direct = direct[np.argsort(text[direct], kind="stable")]
    ranges = np.searchsorted(text[direct], np.arange(258))
    heads: list[list[np.ndarray]] = [[] for _ in range(257)]
    heads[0].append(np.flatnonzero(need & (text == 0)))
    out = []
    for c in range(257):
        new = np.concatenate(heads[c]) if heads[c] else np.zeros(0, np.int64)
        bucket = []
        while len(new):  # runs of one byte: each pass places the next byte to the left
            bucket.append(new)
            before = new[new > 0] - 1
            new = before[need[before] & (text[before] == c)] if c else new[:0]
        own = direct[ranges[c] : ranges[c + 1]]
        if len(own):
            bucket.append(own[np.argsort(strings[own])])
        if not bucket:
            continue
        done = np.concatenate(bucket)
        out.append(done)
        before = done[done > 0] - 1
        before = before[need[before] & (text[before] > c)]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            heads[int(text[part[0]])].append(part)
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefix_reaches(raw: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each pair of neighbours in the order, if their common prefix is `depth` bytes or longer."""
    a, b = order[:-1], order[1:]
    alive = np.arange(len(a))
    words = np.ndarray((max(0, len(raw) - 7),), "<u8", raw.tobytes(), strides=(1,)) if depth >= 8 else raw
    width = 8 if depth >= 8 else 1
    for at in [*range(0, depth - width, width), depth - width]:
        alive = alive[words[a[alive] + at] == words[b[alive] + at]]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def repeated_windows(contexts: list[bytes], times: np.ndarray, min_bytes: int) -> list[np.ndarray]:
    """For each context, which of its windows repeat: with their neighbours in suffix order, or as the context itself repeats."""
    lengths = np.array([len(x) for x in contexts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    joined = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8)
    text = joined.astype(np.uint16) + 1
    text[starts + lengths] = 0
    windows = lengths - min_bytes + 1
    mark = np.zeros(len(text) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + windows, -1)
    wanted = np.cumsum(mark[:-1]) > 0
    order = suffix_order(text, wanted, min_bytes)
    same = common_prefix_reaches(joined, order, min_bytes)
    hit = np.zeros(len(text), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [np.ones(n, bool) if k > 1 else hit[s : s + n] for s, n, k in zip(starts, windows, times)]


@common.frugal
def _sort_bucket(table: pa.Table, min_bytes: int) -> pa.Table:
    """Suffix sorting over the contexts of one bucket of anchors; intervals of repeated bytes for each block."""
    at: dict[tuple, int] = {}
    kept: list[bytes] = []
    which = []
    blocks = table["block"].to_pylist()
    rows = [np.frombuffer(x, np.uint64) for x in table["rows"].to_pylist()]
    places = [np.frombuffer(x, np.int32) for x in table["places"].to_pylist()]
    for key, raw in zip(zip(table["anchor"].to_pylist(), table["context"].to_pylist()), table["bytes"].to_pylist()):
        if key not in at:
            at[key] = len(kept)
            kept.append(raw)
        which.append(at[key])
    times = np.bincount(np.array(which, np.int64), [len(r) for r in rows], len(kept))
    found = []
    for hit in repeated_windows(kept, times, min_bytes):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        found.append((edge[::2], edge[1::2] + min_bytes - 1))
    out: dict[int, list] = {}
    for i, b, row, place in zip(which, blocks, rows, places):
        lo, hi = found[i]
        if len(lo):
            own = out.setdefault(b, [[], [], []])
            own[0].append(np.repeat(row, len(lo)))
            own[1].append((place[:, None] + lo[None, :]).ravel())
            own[2].append((place[:, None] + hi[None, :]).ravel())
    packed = [[np.concatenate(x).astype(t).tobytes() for x, t in zip(own, (np.uint64, np.int32, np.int32))] for own in out.values()]
    return pa.table([pa.array(list(out), pa.int32()), *(pa.array([p[i] for p in packed], pa.binary()) for i in range(3))], schema=_INTERVAL)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_hash long, kept binary, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("text_hash", pa.int64()), ("kept", pa.binary()), ("kept_text", pa.string())])


@common.frugal
def _cut(docs: pa.Table, intervals: pa.Table, keep_bytes: bool, keep_text: bool) -> pa.Table:
    if not docs.num_rows:
        return _RESULT.empty_table()
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in intervals[name].to_pylist()] or [np.zeros(0, kind)])
    rows, lo, hi = join("rows", np.uint64), join("lo", np.int32), join("hi", np.int32)
    order = np.lexsort((lo, rows))
    rows, lo, hi = rows[order], lo[order], hi[order]
    out = []
    for doc_id, (row, t) in zip(docs["doc_id"].to_pylist(), _texts(docs)):
        a, z = np.searchsorted(rows, row, "left"), np.searchsorted(rows, row, "right")
        kept, removed, n_spans = t, 0, 0
        if z > a:
            cover = np.zeros(len(t) + 1, np.int32)
            np.add.at(cover, lo[a:z], 1)
            np.add.at(cover, hi[a:z], -1)
            gone = np.cumsum(cover[:-1]) > 0
            removed, n_spans = int(gone.sum()), int((np.diff(np.concatenate(([False], gone)).astype(np.int8)) > 0).sum())
            kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(t), removed, n_spans, hashlib.sha256(kept).hexdigest(), _signed(xxhash.xxh64_intdigest(t, 42)), kept if keep_bytes else None, kept.decode("utf-8", "ignore") if keep_text else None))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), _RESULT)], schema=_RESULT)


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_bytes: int = 200, keep_bytes: bool = True, keep_text: bool = False, gram: int | None = None, hot_anchor: int = HOT_ANCHOR, block_bytes: int = common.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_hash, kept, kept_text) of each row: what is left without repeated passages.

    kept: the remaining bytes (null with keep_bytes=False). A cut can fall within a character, so it is binary; kept_text (null
    unless keep_text) is without the bytes of such a character. text_hash: Spark's xxhash64 of the text.
    """
    gram = gram or min(GRAM, max(1, min_bytes // 3))
    base = common.base_columns(docs, key, text)
    n = common.block_count(base, block_bytes)
    blocks = common.in_blocks(base, n)
    seen = common.count_keys(blocks, lambda t: _anchors(t, min_bytes, gram), n)
    contexts = blocks.groupBy("block").cogroup(seen.select("block", "bucket", "kind", "answer").groupBy("block")).applyInArrow(lambda d, s: _contexts(common.unpacked(d), s, min_bytes, gram, 2 * n, hot_anchor), CONTEXT)
    intervals = common.dealt(contexts, 2 * n, "bucket").groupBy("bucket").applyInArrow(lambda t: _sort_bucket(t, min_bytes), INTERVAL)
    return blocks.groupBy("block").cogroup(intervals.groupBy("block")).applyInArrow(lambda d, i: _cut(common.unpacked(d), i, keep_bytes, keep_text), RESULT)


def dedup_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` with the repeated passages cut out of `text`; other columns and the number of rows as they are.

    Rows are found again by id and the hash of their text (Spark's xxhash64), so repeated ids do no harm, nor do other
    columns of whatever name. Bytes of a character that was cut in two go; a null text stays null.
    """
    own = F.struct(*docs.columns).alias("row")  # the table's columns stay apart from those of the join
    clean = suffix_dedup(docs, key, text, keep_bytes=False, keep_text=True, **options).filter("n_removed > 0").select("doc_id", "text_hash", F.col("kept_text").alias("kept")).dropDuplicates(["doc_id", "text_hash"])
    rows = docs.select(own, F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    out = rows.join(clean, rows.id.eqNullSafe(clean.doc_id) & (rows.hash == clean.text_hash), "left")
    return out.select(*(F.coalesce("kept", f"row.`{c}`").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))

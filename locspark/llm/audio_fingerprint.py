"""Chroma fingerprints of audio columns, and alignment of recordings by them.

Samples are cut into overlapping frames; the power spectrum of each is folded into twelve pitch classes and normalised.
Over an integral image of these, sixteen box filters compare parts of a window of frames; each answer takes two bits
(Gray code), so a window gives one packed 32-bit integer. Equal integers of two recordings vote for the offset between
their windows; the bit errors at an offset decide, and the offset with most votes that passes is the pair's. Runs of one
integer vote as a whole and votes are added up piece by piece, so memory follows the offsets, not the pairs of windows.

Recordings under `SHORT` samples can't hold a run of `LEAST_RUN` windows, so their fingerprint is a fine one, of frames and
hops a quarter as long. Long recordings have a fine one besides, by which they meet the short ones; two long ones meet by
the coarse. If the shorter of a pair has fewer than `LEAST_RUN` windows, its first and last must vote. Those of under
`LEAST_VOTES` windows (304 to 335 samples) are in classes but in no pair: one or two integers are equal by chance.

Recordings with equal fingerprints form one class, named by its smallest id; classes are matched once. The query set
(ids divisible by `every`) goes over all classes in blocks of at most `QUERY_WINDOWS` windows, each sent to the executors
and dropped before the next.

`bytes_as_audio` reads a text's UTF-8 bytes as 8-bit samples; that's how tables without sound are used here. Recordings
too short for a fine window (304 samples) have no fingerprint (class_id null) and match nothing, but those of the same
samples share a group_id; nulls and empty ones are in no group. Rows with a null id get the class but are no queries.
Constant sound gives constant integers. Repeated rows are members of one class. Recordings of any length are read whole. Other
columns, of whatever name, are left out. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

RATE, FRAME, HOP, WINDOW = 8000, 256, 64, 16
LOWEST, HIGHEST = 100.0, 3500.0
#: A match: so many windows from the first to the last vote at least, so many votes, and bit errors of at most this share.
LEAST_RUN, LEAST_VOTES, MOST_ERRORS = 16, 3, 0.2
#: Recordings of fewer samples can't reach LEAST_RUN; frame and hop of their fingerprints.
SHORT, FINE_FRAME, FINE_HOP = FRAME + (WINDOW + LEAST_RUN - 2) * HOP, FRAME // 4, HOP // 4
QUERY_WINDOWS = 1 << 20
#: Pairs of runs, or offsets, that are looked at at once.
HITS = 1 << 20


def _fold(frame: int) -> np.ndarray:
    f = np.arange(frame // 2 + 1) * RATE / frame
    out = np.zeros((len(f), 12), np.float32)
    use = (f >= LOWEST) & (f <= HIGHEST)
    out[np.flatnonzero(use), np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    return out


_FOLD = {n: _fold(n) for n in (FRAME, FINE_FRAME)}
_TAPER = {n: np.hanning(n + 1)[:n].astype(np.float32) for n in (FRAME, FINE_FRAME)}


def _boxes(k: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]:
    """Filter k: boxes (from frame, to frame, from class, to class) that count for and against, by rule."""
    low, high = (3 * k) % 7, (3 * k) % 7 + 4 + k % 2 * 2
    high = min(12, high)
    mid, third, width = (low + high) // 2, WINDOW // 4, WINDOW
    kind = k % 4
    if kind == 0:  # lower against upper classes
        return [(0, width, low, mid)], [(0, width, mid, high)]
    if kind == 1:  # early against late frames
        return [(0, width // 2, low, high)], [(width // 2, width, low, high)]
    if kind == 2:  # opposite corners
        return [(0, width // 2, low, mid), (width // 2, width, mid, high)], [(0, width // 2, mid, high), (width // 2, width, low, mid)]
    return [(third, width - third, low, high)], [(0, third, low, high), (width - third, width, low, high)]  # middle against both ends


_FILTERS = [_boxes(k) for k in range(16)]
#: Answers beyond this, up or down, get the outer codes.
_STEP = (0.18, 0.06, 0.05, 0.04)


def chroma(samples: np.ndarray, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Pitch classes of each frame, of length one (zero for silence)."""
    if len(samples) < frame:
        return np.zeros((0, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    out = []
    for a in range(0, len(view), 4096):
        spectrum = np.fft.rfft(view[a : a + 4096] * _TAPER[frame])
        out.append((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ _FOLD[frame])
    x = np.concatenate(out).astype(np.float64)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.where(norm > 1e-6, x / np.maximum(norm, 1e-6), 0)


def pack(x: np.ndarray) -> np.ndarray:
    """One integer for each window of frames."""
    n = len(x) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(x) + 1, 13))
    image[1:, 1:] = x.cumsum(0).cumsum(1)
    box = lambda a, z, lo, hi: image[z : z + n, hi] - image[a : a + n, hi] - image[z : z + n, lo] + image[a : a + n, lo]
    out = np.zeros(n, np.uint32)
    for k, (plus, minus) in enumerate(_FILTERS):
        answer = np.log((1 + sum(box(*b) for b in plus)) / (1 + sum(box(*b) for b in minus)))
        answer[np.abs(answer) < 1e-9] = 0  # rounding of the integral image decides nothing
        step = _STEP[k % 4]
        code = (answer >= -step).astype(np.uint32) + (answer >= 0) + (answer >= step)
        out |= (code ^ (code >> 1)).astype(np.uint32) << np.uint32(2 * k)
    return out


def fine_fingerprint(samples: np.ndarray) -> np.ndarray:
    return pack(chroma(samples, FINE_FRAME, FINE_HOP))


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The fingerprint that classes go by: a fine one for short recordings."""
    return fine_fingerprint(samples) if len(samples) < SHORT else pack(chroma(samples))


def bytes_as_audio(raw: bytes) -> np.ndarray:
    """8-bit unsigned samples as floats in -1 .. 1."""
    return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128


PRINTS = "doc_id long, n_windows long, hop int, digest string, print binary, fine binary"
_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_windows", pa.int64()), ("hop", pa.int32()), ("digest", pa.string()), ("print", pa.binary()), ("fine", pa.binary())])


def _print(raw: bytes) -> tuple:
    """(n_windows, hop, digest, print, fine): fine is the long recordings' second fingerprint; the digest is of the samples where there is no window."""
    samples = bytes_as_audio(raw)
    p = fingerprint(samples).tobytes()
    if not p:
        return 0, None, hashlib.sha256(b"samples" + raw).hexdigest() if raw else None, None, None
    if len(samples) < SHORT:
        return len(p) // 4, FINE_HOP, hashlib.sha256(b"fine" + p).hexdigest(), p, None
    return len(p) // 4, HOP, hashlib.sha256(p).hexdigest(), p, fine_fingerprint(samples).tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(doc_id, *_print(raw or b"")) for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _PRINTS)] if rows else [pa.array([], f.type) for f in _PRINTS], schema=_PRINTS)


def _runs(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of one integer; `starts` begin new ones."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[starts] = True
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(values)))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of about `most` in total; a larger size has a slice of its own."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, z
        a = z


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, .. for sizes[i] numbers each."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Votes:
    """Votes for keys (query and offset), with the first and last place of each; adds up as it goes."""

    def __init__(self):
        self.key = self.votes = self.first = self.last = np.zeros(0, np.int64)

    def add(self, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        key, votes = np.concatenate((self.key, key)), np.concatenate((self.votes, last - first + 1))
        first, last = np.concatenate((self.first, first)), np.concatenate((self.last, last))
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        self.key, self.votes = key[order][at], np.add.reduceat(votes[order], at)
        self.first, self.last = np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at)


class Queries:
    """A block of query fingerprints, by integer."""

    def __init__(self, prints: list[tuple[int, bytes]]):
        self.ids, self.prints = [i for i, _ in prints], [np.frombuffer(p, np.uint32) for _, p in prints]
        size = self.size = np.array([len(p) for p in self.prints], np.int64)
        values = np.concatenate(self.prints) if prints else np.zeros(0, np.uint32)
        begin = np.cumsum(size) - size
        at, length = _runs(values, begin[size > 0])
        order = np.argsort(values[at], kind="stable")
        self.values, self.length = values[at][order], length[order]
        owner = np.repeat(np.arange(len(size)), size)[at] if prints else np.zeros(0, np.int64)
        self.owner, self.place = owner[order], (at - begin[owner])[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[self._short(values)] = True

    @staticmethod
    def _short(values: np.ndarray) -> np.ndarray:
        return (values * np.uint32(0x9E3779B1)) >> np.uint32(10)

    def votes(self, own: np.ndarray) -> Votes:
        """Equal integers by query and offset: runs meet runs, so constant sound costs no more than its length."""
        start, length = _runs(own, np.zeros(1, np.int64))
        use = self.filter[self._short(own[start])]
        start, length = start[use], length[use]
        lo, hi = np.searchsorted(self.values, own[start], "left"), np.searchsorted(self.values, own[start], "right")
        use = hi > lo
        start, length, lo, n = start[use], length[use], lo[use], (hi - lo)[use]
        out = Votes()
        for a, z in _slices(n, HITS):
            hit = _spread(lo[a:z], n[a:z])
            s, e = np.repeat(start[a:z], n[a:z]), np.repeat(start[a:z] + length[a:z], n[a:z])
            q, c, d = self.owner[hit], self.place[hit], self.place[hit] + self.length[hit]
            width = (e - s) + (d - c) - 1
            for b, y in _slices(width, HITS):
                offset = _spread((s - d + 1)[b:y], width[b:y])
                s_, e_, c_, d_, q_ = (np.repeat(x[b:y], width[b:y]) for x in (s, e, c, d, q))
                out.add(q_ << 32 | (offset + (1 << 31)), np.maximum(s_, c_ + offset), np.minimum(e_, d_ + offset) - 1)
        return out

    def matches(self, own: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(query, offset, run, bit errors): of each query's offsets with votes enough, in the order of votes, the first that aligns."""
        found = self.votes(own)
        query, run = found.key >> 32, found.last - found.first + 1
        use = (found.votes >= LEAST_VOTES) & (run >= np.minimum(LEAST_RUN, np.minimum(self.size[query], len(own))))
        use = np.flatnonzero(use)
        done, out = set(), []
        for i in use[np.lexsort((found.key[use], -found.votes[use], query[use]))]:
            q = int(query[i])
            if q in done:
                continue
            offset, a, z = int(found.key[i] & 0xFFFFFFFF) - (1 << 31), int(found.first[i]), int(found.last[i]) + 1
            wrong = np.bitwise_count(own[a:z] ^ self.prints[q][a - offset : z - offset]).sum() / (32 * (z - a))
            if wrong <= MOST_ERRORS:
                done.add(q)
                out.append((self.ids[q], offset, z - a, float(wrong)))
        return out


MATCH = "doc_id long, query_id long, offset long, run long, bit_errors double, hop int"
_MATCH = pa.schema([("doc_id", pa.int64()), ("query_id", pa.int64()), ("offset", pa.int64()), ("run", pa.int64()), ("bit_errors", pa.float64()), ("hop", pa.int32())])


def _align(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    # two long recordings meet by the coarse fingerprint, all other pairs by the fine one
    long = Queries([(i, p) for i, hop, p, _ in shipped.value if hop == HOP])
    short = Queries([(i, p) for i, hop, p, _ in shipped.value if hop == FINE_HOP])
    every = Queries([(i, p if hop == FINE_HOP else fine) for i, hop, p, fine in shipped.value])
    for batch in batches:
        rows = []
        for rep, own_hop, raw, fine in zip(*(c.to_pylist() for c in batch.columns)):
            for queries, own, hop in [(every, raw, FINE_HOP)] if own_hop == FINE_HOP else [(long, raw, HOP), (short, fine, FINE_HOP)]:
                rows += [(rep, *m, hop) for m in queries.matches(np.frombuffer(own, np.uint32)) if m[0] != rep]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _MATCH)] if rows else [pa.array([], f.type) for f in _MATCH], schema=_MATCH)


def align_recordings(recordings: DataFrame, key: str = "doc_id", audio: str = "text", every: int = 100, query_windows: int = QUERY_WINDOWS) -> DataFrame:
    """All rows as members of their classes, and pairs between the names of classes that align.

    (doc_id, class_id, n_windows, digest, query_id, offset, run, bit_errors, hop, group_id). Members: one row for each of the
    table, query_id to bit_errors null; group_id is class_id, or without a window the smallest id of the same samples. Pairs:
    doc_id is the name of a class, query_id the name of a class that a query is in; window w of the query stands at window
    w + offset, over `run` windows. hop: samples from one window to the next.
    """
    base = recordings.select(F.col(key).cast("long").alias("doc_id"), F.col(audio).cast("binary").alias("audio"))
    prints = common.written(base.mapInArrow(_prints, PRINTS))
    named = prints.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.max(F.coalesce(F.col("doc_id") % every == 0, F.lit(False))).alias("asks"), *[F.first(c).alias(c) for c in ("n_windows", "hop", "print", "fine")])
    classes = common.written(named)
    asked = classes.filter("asks and n_windows > 0")
    blocks = max(1, -(-2 * (asked.agg(F.sum(F.octet_length(F.coalesce("fine", "print")) / 4).cast("long")).first()[0] or 0) // query_windows))
    searched = classes.filter("class_id is not null and n_windows > 0").select("class_id", "hop", "print", "fine")
    pairs = None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == b)
        shipped = recordings.sparkSession.sparkContext.broadcast([(r.class_id, r.hop, bytes(r.print), r.fine and bytes(r.fine)) for r in own.select("class_id", "hop", "print", "fine").toLocalIterator()])
        found = searched.mapInArrow(lambda x, s=shipped: _align(x, s), MATCH)
        if blocks > 1:
            found = common.written(found)
            shipped.destroy()
        pairs = found if pairs is None else pairs.union(found)
    none = lambda **columns: [F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    missing = none(query_id="long", offset="long", run="long", bit_errors="double")
    members = prints.filter("digest is not null").join(classes.select("digest", F.col("class_id").alias("group_id")), "digest")
    members = members.select("doc_id", F.when(F.col("n_windows") > 0, F.col("group_id")).alias("class_id"), "n_windows", "digest", *missing, "hop", "group_id")
    members = members.union(prints.filter("digest is null").select("doc_id", *none(class_id="long"), "n_windows", "digest", *missing, "hop", *none(group_id="long")))
    return members.union(pairs.select("doc_id", F.col("doc_id").alias("class_id"), *none(n_windows="long", digest="string"), "query_id", "offset", "run", "bit_errors", "hop", F.col("doc_id").alias("group_id")))

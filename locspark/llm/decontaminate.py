"""Benchmark decontamination by the q-gram lemma and banded alignment.

Benchmark texts are cut into pieces of about `piece` bytes, one every `stride` bytes (the last one ends with the text), so
that parts of an item are found too; shorter items are one piece. A piece of m bytes with k edits at most shares
m - q + 1 - k q or more q-grams with the place where it stands, all within k + 1 neighbouring diagonals. So for each text

1. the hashes of all its q-grams are looked up among those of the pieces,
2. hits are counted in overlapping bands of 2 k + 2 diagonals; a band under the bound is dropped, for good reason: it can't
   hold the piece within the edit budget,
3. what is left is verified by an alignment within the band, many bands side by side.

Texts are compared lower-cased (A-Z), any white-space byte as a space. The pieces are sent to the executors in blocks of
at most `block_bytes` of benchmark text, one pass over the documents for each, so a benchmark of any size is handled.

Null and empty texts hold no piece, null and empty items have none. An item under q bytes is looked up by grams of its own
length, and an item under `word` bytes counts only as it is, where no letter or digit stands before or after it. Items with a null
id are found like others, with a null item_id; texts of one item id are one item. Repeated rows, and rows of null or
repeated ids, are judged each. Texts of any length are read whole. Other columns, of whatever name, stay out of the
search. An empty table, or no benchmark, gives no finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

PIECE, STRIDE, WORD, Q, EDITS = 100, 25, 40, 8, 0.1
BENCHMARK_BLOCK = 4 << 20
#: Hits that are held at once, places that one gram may have among the pieces searched together, and bytes of text searched at once.
HITS, SAME, STRETCH = 1 << 20, 2000, 1 << 18

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(9, 14)]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

FINDS = "doc_id long, item_id long, first_byte long, last_byte long, edits int, n_pieces int, text_hash long"
_FINDS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_byte", pa.int64()), ("last_byte", pa.int64()), ("edits", pa.int32()), ("n_pieces", pa.int32()), ("text_hash", pa.int64())])


def _gram_hashes(plain: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams: q bytes, by doubling."""
    h, width = plain.astype(common.U64) + common.U64(1), 1
    out, done = None, 0
    while True:
        if q & width:
            out = h[: len(plain) - q + 1].copy() if out is None else out * common.U64(0x9E3779B97F4A7C15) + h[done : done + len(plain) - q + 1]
            done += width
        if width * 2 > q:
            return common.mix(out)
        h = common.mix(h[:-width] * common.U64(0xD6E8FEB86659FD93) + h[width:])
        width *= 2


class Pieces:
    """The pieces of a block of benchmark items that have grams of one length, indexed by the hashes of their grams."""

    def __init__(self, items: list[tuple[int | None, bytes]], piece: int, stride: int, word: int, q: int, edits: float):
        self.q, self.items, self.raw, self.budget, self.bound, self.alone = q, [], [], [], [], []
        hashes, which, offset = [], [], []
        for item, raw in items:
            plain = _PLAIN[np.frombuffer(raw, np.uint8)]
            for a in sorted({*range(0, max(1, len(plain) - piece + 1), stride), max(0, len(plain) - piece)}):
                p = plain[a : a + piece]
                k = int(edits * len(p)) if len(plain) >= word else 0
                while k and len(p) - q + 1 - k * q < 4:
                    k -= 1
                h = _gram_hashes(p, q)
                hashes.append(h)
                which.append(np.full(len(h), len(self.raw)))
                offset.append(np.arange(len(h)))
                self.items.append(item)
                self.raw.append(p)
                self.budget.append(k)
                self.bound.append(len(p) - q + 1 - k * q)
                self.alone.append(len(plain) < word)
        empty = np.zeros(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes, self.which, self.offset = h[order], np.concatenate(which or [empty])[order], np.concatenate(offset or [empty])[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes & common.U64((1 << 20) - 1)] = True
        self.budget, self.bound, self.alone = np.array(self.budget, np.int64), np.array(self.bound, np.int64), np.array(self.alone, bool)
        self.size = np.array([len(p) for p in self.raw], np.int64)

    @classmethod
    def all_of(cls, items: list[tuple[int | None, bytes]], piece: int, stride: int, word: int, q: int, edits: float) -> list[Pieces]:
        """The pieces by the length of their grams (q, or the length of the item where that is less), those of short items apart.

        Items whose grams are frequent among the items are dealt over several of these, so that a gram stands at few more
        than `SAME` places of each.
        """
        groups: dict[tuple[int, bool], list] = {}
        for i, raw in items:
            if raw:
                groups.setdefault((min(q, len(raw)), len(raw) < word), []).append((i, raw))
        out = []
        for (g, _), own in sorted(groups.items(), key=lambda x: x[0]):
            parts: list[list] = [[]]
            times: dict[int, int] = {}
            for i, raw in own:
                h, n = np.unique(_gram_hashes(_PLAIN[np.frombuffer(raw, np.uint8)], g), return_counts=True)
                often = [(int(x), int(k) * -(-piece // stride)) for x, k in zip(h[n > 4], n[n > 4])]
                if parts[-1] and any(times.get(x, 0) + k > SAME for x, k in often):
                    parts.append([])
                    times = {}
                for x, k in often:
                    times[x] = times.get(x, 0) + k
                parts[-1].append((i, raw))
            out += [cls(p, piece, stride, word, g, edits) for p in parts]
        return out

    def bands(self, plain: np.ndarray, at: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bands whose first diagonal lies in low .. high (high excluded) and that reach the bound: text, piece, first diagonal.

        Where grams meet too often, as in a text of one letter, the stretch is cut in two, again and again, so that no more
        than about `HITS` hits are held at once.
        """
        reach = int((self.size + 4 * (self.budget + 1)).max())
        first, last = max(0, low - reach), min(len(plain), high + reach + self.q)
        if last - first < self.q:
            return
        h = _gram_hashes(plain[first:last], self.q)
        doc = np.searchsorted(at, np.arange(first, first + len(h)), "right") - 1
        h[at[doc + 1] - np.arange(first, first + len(h)) < self.q] = 0  # grams over the end of a text are none
        place = np.flatnonzero(self.filter[h & common.U64((1 << 20) - 1)])
        lo, hi = np.searchsorted(self.hashes, h[place], "left"), np.searchsorted(self.hashes, h[place], "right")
        place, lo, n = place[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        # a band's hits stand at as many places as its bound says, no farther apart than a piece and its edits reach
        few, far = int(self.bound.min()), int((self.size + 2 * self.budget).max())
        dense = np.zeros(len(place) + 1, np.int32)
        close = np.flatnonzero(place[few - 1 :] - place[: len(place) - few + 1] <= far) if len(place) >= few else np.zeros(0, np.int64)
        dense[close] += 1
        dense[close + few] -= 1
        on = np.cumsum(dense[:-1]) > 0
        place, lo, n = place[on], lo[on], n[on]
        if not len(place):
            return
        if n.sum() > HITS and high - low > 2 * reach:
            middle = (low + high) // 2
            yield from self.bands(plain, at, low, middle)
            yield from self.bands(plain, at, middle, high)
            return
        hit = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        text, place, piece, offset = np.repeat(doc[place], n), np.repeat(place + first, n), self.which[hit], self.offset[hit]
        diagonal, width = place - offset, (self.budget + 1)[piece]
        # one number a hit, to sort by: piece, band, text (by its last 8 bits: a band reaches fewer texts than that), offset
        texts, rank = np.unique(doc, return_inverse=True)
        text = np.searchsorted(texts, text)
        bits = int(self.size.max()).bit_length()
        for shift in (0, 1):  # bands of 2 k + 2 diagonals, overlapping by half: any k + 1 neighbours lie in one of them
            band = (diagonal + width * shift) // (2 * width)
            begin = band * 2 * width - width * shift
            on = (begin >= low) & (begin < high)
            if not on.any():
                continue
            least = int(band[on].min())
            span = int(band[on].max() - least).bit_length()
            key = np.sort(((piece[on] << span | (band[on] - least)) << 8 | (text[on] & 255)) << bits | offset[on])
            group = key >> bits
            new = np.concatenate(([True], group[1:] != group[:-1]))
            count = np.bincount(np.cumsum(new) - 1, np.concatenate(([True], key[1:] != key[:-1])))
            group = group[new]
            p = group >> (span + 8)
            on = count >= self.bound[p]
            p, group = p[on], group[on]
            w = (self.budget + 1)[p]
            begin = ((group >> 8 & ((1 << span) - 1)) + least) * 2 * w - w * shift
            near = rank[np.clip(begin - first, 0, len(doc) - 1)]
            if len(p):
                yield texts[np.minimum(near + ((group - near) & 255), len(texts) - 1)], p, begin


def banded(pieces: np.ndarray, stretch: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fewest edits between each piece and a part of its stretch of text within the band: (edits, start, end).

    pieces: (n, m) bytes. stretch: (n, m + w - 1) bytes, or -1 beyond the text; diagonal t of the w in the band sets byte i of
    the piece against place t + i. An alignment starts on any diagonal of the band, with no edit yet, and stays within it.
    Edits over the budget are only known to be over it.
    """
    n, m = pieces.shape
    w = stretch.shape[1] - m + 1
    steps = np.arange(w, dtype=np.int32)
    cost, start = np.zeros((n, w), np.int32), np.broadcast_to(steps, (n, w)).copy()
    edits, left, right = np.full(n, budget + 1, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    alive = np.arange(n)
    for i in range(m):
        swap = cost + (stretch[:, i : i + w] != pieces[:, i : i + 1])
        # a byte of the piece that the text lacks: from the next diagonal
        drop = np.concatenate((cost[:, 1:] + 1, np.full((len(cost), 1), budget + 2, np.int32)), 1)
        from_next = drop < swap
        cost = np.where(from_next, drop, swap)
        start = np.where(from_next, np.concatenate((start[:, 1:], start[:, -1:]), 1), start)
        # a run of text bytes that the piece lacks: the least of cost[s] + (t - s) over s <= t
        lead = cost - steps
        low = np.minimum.accumulate(lead, 1)
        origin = np.maximum.accumulate(np.where(lead == low, steps, 0), 1)
        cost, start = low + steps, np.take_along_axis(start, origin, 1)
        if i % 16 == 15:
            on = cost.min(1) <= budget
            if not on.all():
                alive, cost, start, pieces, stretch = alive[on], cost[on], start[on], pieces[on], stretch[on]
                if not len(alive):
                    break
    if len(alive):
        end = cost.argmin(1)
        row = np.arange(len(alive))
        edits[alive], left[alive], right[alive] = cost[row, end], start[row, end], end + m
    return edits, left, right


#: Bands that are aligned side by side.
BANDS = 4096


def _aligned(pieces: Pieces, plain: np.ndarray, at: np.ndarray, doc: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> Iterator[np.ndarray]:
    """Bands that hold their piece within its budget, as rows (text, piece, edits, start, end). Equal pieces of text are aligned once."""
    kind = pieces.size[piece] << 20 | pieces.budget[piece]
    for x in np.unique(kind).tolist():
        own = np.flatnonzero(kind == x)
        m, k = x >> 20, x & ((1 << 20) - 1)
        for a in range(0, len(own), BANDS):
            d, p, first = doc[own[a : a + BANDS]], piece[own[a : a + BANDS]], diagonal[own[a : a + BANDS]]
            place = first[:, None] + np.arange(m + 2 * k + 1)
            inside = (place >= at[d][:, None]) & (place < at[d + 1][:, None])
            stretch = np.where(inside, plain[np.clip(place, 0, len(plain) - 1)].astype(np.int16), np.int16(-1))
            both = np.ascontiguousarray(np.concatenate((stretch, p.astype(np.int64)[:, None].view(np.int16)), 1))
            _, one, same = np.unique(both.view(f"V{both.itemsize * both.shape[1]}").ravel(), return_index=True, return_inverse=True)
            edits, left, right = (v[same] for v in banded(np.stack([pieces.raw[i] for i in p[one].tolist()]).astype(np.int16), stretch[one], k))
            start, end = np.maximum(first + left, at[d]), np.minimum(first + right, at[d + 1])
            good = edits <= k
            before = (start > at[d]) & _LETTER[plain[np.maximum(start - 1, 0)]]
            after = (end < at[d + 1]) & _LETTER[plain[np.minimum(end, len(plain) - 1)]]
            good &= ~(pieces.alone[p] & (before | after))
            if good.any():
                yield np.stack([c[good].astype(np.int64) for c in (d, p, edits, start, end)], 1)


def shortened(plain: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with runs of one byte cut to `most` bytes, which hold a piece just where the whole run does, at both of its ends: bytes, offsets, cuts and how many bytes are missing before each."""
    edge = np.concatenate(([True], plain[1:] != plain[:-1])) if len(plain) else np.zeros(0, bool)
    edge[at[:-1][at[:-1] < len(plain)]] = True
    starts = np.flatnonzero(edge)
    size = np.diff(np.append(starts, len(plain)))
    long = size > most
    if not long.any():
        return plain, at, np.zeros(0, np.int64), np.zeros(1, np.int64)
    gone = np.where(long, size - most, 0)
    keep = np.ones(len(plain), bool)
    for s, n in zip((starts + most // 2)[long].tolist(), gone[long].tolist()):
        keep[s : s + n] = False
    missing = np.cumsum(gone[long])
    cuts = (starts + most // 2)[long] - (missing - gone[long])
    return plain[keep], at - np.concatenate(([0], missing))[np.searchsorted((starts + most // 2)[long], at)], cuts, np.concatenate(([0], missing))


def _gathered(groups: list[Pieces], plain: np.ndarray, at: np.ndarray) -> dict[tuple[int, int | None], list]:
    """By text and item: first byte, last byte, fewest edits, the pieces found. A stretch of text at a time, so that a text of any length is read in bounded memory."""
    best: dict[tuple[int, int | None], list] = {}
    reach = max((int((g.size + 4 * (g.budget + 1)).max()) for g in groups), default=0)
    plain, short, cuts, missing = shortened(plain, at, 4 * reach)
    place = lambda x: x + missing[np.searchsorted(cuts, x, "left")]
    for g, pieces in enumerate(groups):
        for low in range(-reach, len(plain), STRETCH):
            for bands in pieces.bands(plain, short, low, min(low + STRETCH, len(plain))):
                for rows in _aligned(pieces, plain, short, *bands):
                    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
                    head = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
                    first, last, edits = place(np.minimum.reduceat(rows[:, 3], head)), place(np.maximum.reduceat(rows[:, 4], head)), np.minimum.reduceat(rows[:, 2], head)
                    for d, p, lo, hi, e in zip(*(c.tolist() for c in (rows[head, 0], rows[head, 1], first, last, edits))):
                        own = best.setdefault((d, pieces.items[p]), [1 << 60, 0, 1 << 30, set()])
                        own[:3] = [min(own[0], lo - int(at[d])), max(own[1], hi - int(at[d])), min(own[2], e)]
                        own[3].add((g, p))
    return best


def _find(batches: Iterator[pa.RecordBatch], shipped, options: tuple) -> Iterator[pa.RecordBatch]:
    groups = Pieces.all_of(shipped.value, *options)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        data, offsets = common.text_buffer(batch.column(1))
        rows = []
        for first, _, raw, at in common.pieces(data, offsets):
            best = _gathered(groups, _PLAIN[raw], at)
            hashes = {d: xxhash.xxh64_intdigest(raw[at[d] : at[d + 1]].tobytes(), 42) for d, _ in best}  # as Spark's xxhash64
            rows += [(ids[first + d], item, *x[:3], len(x[3]), hashes[d] - (hashes[d] >> 63 << 64)) for (d, item), x in best.items()]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _FINDS)] if rows else [pa.array([], f.type) for f in _FINDS], schema=_FINDS)


def _finds(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", piece: int = PIECE, stride: int = STRIDE, word: int = WORD, q: int = Q, edits: float = EDITS, block_bytes: int = BENCHMARK_BLOCK) -> DataFrame:
    """The finds, with the hash of each text."""
    rows = common.base_columns(docs, key, text)
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (block_bytes // 2)))
    items = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        own = items.filter(F.col("block") == b) if blocks > 1 else items
        shipped = docs.sparkSession.sparkContext.broadcast([(r.item_id, r.text.encode()) for r in own.select("item_id", "text").toLocalIterator()])
        found = rows.mapInArrow(lambda x, s=shipped: _find(x, s, (piece, stride, word, q, edits)), FINDS)
        if blocks > 1:  # so that the driver and the executors hold one block at a time
            found = common.written(found)
            shipped.destroy()
        out = found if out is None else out.union(found)
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, first_byte, last_byte, edits, n_pieces): one row for each text and item of which it holds a piece.

    first_byte, last_byte: from the first such place to the end of the last. edits: of the piece that fits best. n_pieces: how many of the item's pieces it holds.
    """
    return _finds(docs, benchmark, key, text, **options).drop("text_hash")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows whose text holds a piece of a benchmark item.

    Rows are found again by id and the hash of their text, so null and repeated ids do no harm, nor do columns of any name.
    """
    hit = _finds(docs, benchmark, key, text, **options).select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("hash"))
    return rows.join(hit, rows.id.eqNullSafe(hit.doc_id) & (rows.hash == hit.text_hash), "left_anti").select(*(F.col(f"row.`{c}`") for c in docs.columns))

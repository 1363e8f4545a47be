"""Removal of repeated word sequences by suffix trees, partitioned by prefixes of variable length.

A word goes if it lies in a window of `window` words whose words also start earlier: in a document of a smaller id, or
farther left in the same one. Suffixes here are the places of a document with a whole window before its end.

1. Prefixes of `PREFIX` words are counted over the corpus (see `common`). A suffix whose prefix occurs once can't repeat and
   goes no further.
2. The others are split into groups by a prefix that is the longer, in steps of `STEP` words, the more suffixes share it: up
   to `group` of them stay with the first prefix, up to 4 times as many take one step more, and so on; the last step is
   the whole window. Equal windows have equal first prefixes, so they choose the same length and meet in one group, and no
   group outgrows memory. Copies within a block of documents are sent once, with their smallest id.
3. A task builds the subtrees of its groups from the sorted suffixes: an edge is the hash of the words of a step, a node the
   suffixes that share all edges above it. Internal nodes that reach the depth of the window hold the repeats; each suffix
   learns if its node has a smaller id than its block knows of.
4. Neighbouring starts that repeat make up the maximal repeats, which are cut from the documents.

The hashes of the prefix and of the window (64 bits each) and the edges between (16 bits) make a false match as good as
impossible: under one in 10**5 for 10**13 windows.

A null text has no words, and words are never changed. A null id counts as larger than all others. Rows of one id aren't
earlier than each other: of repeated rows each keeps what no smaller id has, but within a row the first place alone stays.
Texts of any length are read whole, a longer one makes a larger block. Other columns, of whatever name, are left out. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locspark.llm import common

WINDOW, PREFIX, STEP = 20, 8, 4
#: Suffixes that may share a prefix before it is made longer.
GROUP = 1 << 18
#: Prefixes are counted by this part of their hashes: those that share it count as more frequent than they are, which makes
#: a suffix go further in vain, or its prefix longer, and changes no result.
COUNTED = np.uint64(0xFFFFFFFFFFFF0000)
_LAST = np.int64(2**63 - 1)


def levels(window: int, prefix: int, step: int) -> list[int]:
    """Lengths of a suffix's prefixes, from the first one to the whole window."""
    return sorted({min(window, n) for n in range(min(prefix, window), window + step, step)})


class Suffixes:
    """The words of a block's texts, and its suffixes: place of the first word, text, and the hash of each prefix."""

    def __init__(self, table: pa.Table, window: int, prefix: int, step: int):
        data, offsets = common.text_buffer(table["text"])
        words, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, _, raw, at in common.pieces(data, offsets):
            w, doc = common.word_hashes(raw, at, lower=False)
            words.append(w)
            docs.append(doc + first)
        words, self.docs = np.concatenate(words), np.concatenate(docs)
        n = len(words) - window + 1
        self.place = np.flatnonzero(self.docs[window - 1 :] == self.docs[:n]) if n > 0 else np.zeros(0, np.int64)
        unit = min(step, prefix, window)
        edge = words[: max(0, len(words) - unit + 1)].copy()
        for k in range(1, unit):
            edge = common.mix(edge * common.U64(0x9FB21C651E98DF25) + words[k : k + len(edge)])
        h, at = edge[self.place], unit
        self.hashes: dict[int, np.ndarray] = {}
        wanted = levels(window, prefix, step)
        while True:
            if at in wanted:
                self.hashes[at] = h
            if at == window:
                return
            at = min(at + unit, *(x for x in wanted if x > at))
            h = common.mix(h * common.U64(0xA24BAED4963EE407) + edge[self.place + at - unit])


def _prefix_counts(table: pa.Table, window: int, prefix: int, step: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    first = next(iter(Suffixes(table, window, prefix, step).hashes.values()))
    keys, counts = np.unique(first & COUNTED, return_counts=True)
    return [(0, keys, counts)]


class Groups:
    """A block's distinct windows of repeated prefixes in the order of the trees, and where each of its suffixes is among them."""

    def __init__(self, suffixes: Suffixes, ids: np.ndarray, counts: np.ndarray, group: int):
        first, whole = suffixes.hashes[min(suffixes.hashes)], suffixes.hashes[max(suffixes.hashes)]
        keys, which = np.unique(first & COUNTED, return_inverse=True)
        often = counts[which]
        on = np.flatnonzero(often > 1)
        self.place = suffixes.place[on]
        self.doc = suffixes.docs[self.place]
        _, rep, self.window = np.unique(whole[on], return_index=True, return_inverse=True)
        n, own = len(rep), on[rep]
        self.least = np.full(n, _LAST)
        np.minimum.at(self.least, self.window, ids[self.doc])
        hashes = [h[own] for h in suffixes.hashes.values()]
        longer = np.searchsorted(group * 4 ** np.arange(len(hashes) - 1, dtype=np.int64), often[own])
        self.key = np.choose(longer, hashes) if n else np.zeros(0, np.uint64)
        self.edges = [(h >> common.U64(48)).astype(np.uint16) for h in hashes[1:-1]]
        self.whole = hashes[-1]
        order = np.lexsort((self.whole, *reversed(self.edges), self.key))
        number = np.empty(n, np.int64)
        number[order] = np.arange(n)
        self.window = number[self.window]
        self.key, self.whole, self.least, self.edges = self.key[order], self.whole[order], self.least[order], [e[order] for e in self.edges]


ASKED = "bucket int, block int, keys binary, edges binary, whole binary, least binary"
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), *((n, pa.binary()) for n in ("keys", "edges", "whole", "least"))])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int32()), ("answer", pa.binary())])


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_LAST if i is None else i for i in table["doc_id"].to_pylist()], np.int64)


@common.frugal
def _ask(docs: pa.Table, seen: pa.Table, shape: tuple[int, int, int], group: int, n_buckets: int) -> pa.Table:
    if not docs.num_rows:
        return _ASKED.empty_table()
    g = Groups(Suffixes(docs, *shape), _ids(docs), common.answers(seen, 0), group)
    edges = common.bucket_edges(g.key, n_buckets)
    used = np.flatnonzero(np.diff(edges))
    cut = [slice(int(edges[b]), int(edges[b + 1])) for b in used]
    return pa.table([
        pa.array(used.astype(np.int32)), pa.array([docs["block"][0].as_py()] * len(used), pa.int32()), pa.array([common.planes(g.key[c]) for c in cut], pa.binary()),
        pa.array([b"".join(common.planes(e[c]) for e in g.edges) for c in cut], pa.binary()), pa.array([common.planes(g.whole[c]) for c in cut], pa.binary()), pa.array([common.planes(g.least[c]) for c in cut], pa.binary()),
    ], schema=_ASKED)


class Subtrees:
    """The suffix trees of some groups: `node[d]` has the number of each suffix's node after d edges, in the order of the suffixes."""

    def __init__(self, edges: list[np.ndarray]):
        self.order = np.lexsort(tuple(reversed(edges)))
        new = np.zeros(len(self.order), bool)
        new[:1] = True
        self.node = []
        for e in edges:
            e = e[self.order]
            new[1:] |= e[1:] != e[:-1]
            self.node.append(np.cumsum(new) - 1)

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each suffix the smallest value under its deepest node, if that is an internal one; its own else."""
        deep = self.node[-1]
        starts = np.flatnonzero(np.diff(deep, prepend=-1))
        out = np.empty_like(values)
        out[self.order] = np.minimum.reduceat(values[self.order], starts)[deep] if len(values) else values
        return out


@common.frugal
def _grow(table: pa.Table) -> pa.Table:
    """The subtrees of one bucket of prefixes; each block learns which of its windows stand in a smaller id of another block."""
    column = lambda name, kind: [common.from_planes(x, kind) for x in table[name].to_pylist()]
    keys, whole, least = column("keys", np.uint64), column("whole", np.uint64), column("least", np.int64)
    sizes = [len(k) for k in keys]
    raw = table["edges"].to_pylist()
    depth = next((len(x) // 2 // n for x, n in zip(raw, sizes)), 0)
    edges = [np.concatenate([common.from_planes(x[2 * n * d : 2 * n * (d + 1)], np.uint16) for x, n in zip(raw, sizes)]) for d in range(depth)]
    own = np.concatenate(least)
    earlier = Subtrees([np.concatenate(keys), *edges, np.concatenate(whole)]).least(own) < own
    at = np.cumsum([0, *sizes])
    n = table.num_rows
    return pa.table([table["block"], table["bucket"], pa.array([1] * n, pa.int32()), pa.array([earlier[at[i] : at[i + 1]].tobytes() for i in range(n)], pa.binary())], schema=_ANSWER)


RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


@common.frugal
def _cut(docs: pa.Table, seen: pa.Table, shape: tuple[int, int, int], group: int, keep_text: bool) -> pa.Table:
    if not docs.num_rows:
        return _RESULT.empty_table()
    suffixes, ids = Suffixes(docs, *shape), _ids(docs)
    g = Groups(suffixes, ids, common.answers(seen, 0), group)
    rows = sorted((b, a) for b, k, a in zip(*(seen[c].to_pylist() for c in ("bucket", "kind", "answer"))) if k == 1)
    earlier = np.frombuffer(b"".join(a for _, a in rows), bool)
    again = np.ones(len(g.window), bool)
    again[np.unique(g.doc * len(g.key) + g.window, return_index=True)[1]] = False
    gone = g.place[earlier[g.window] | (ids[g.doc] > g.least[g.window]) | again]
    cover = np.zeros(len(suffixes.docs) + 1, np.int32)
    cover[gone] += 1
    cover[gone + shape[0]] -= 1
    kept = np.cumsum(cover[:-1]) == 0
    ends = np.searchsorted(suffixes.docs, np.arange(docs.num_rows + 1))
    out = []
    for d, (doc_id, text) in enumerate(zip(docs["doc_id"].to_pylist(), docs["text"].cast(pa.large_binary()).to_pylist())):
        own = kept[ends[d] : ends[d + 1]]
        words = text.split()  # at the six white-space bytes of ASCII
        left = b" ".join(words if own.all() else compress(words, own.tolist()))
        edge = np.diff(np.concatenate(([True], own)).astype(np.int8)) < 0
        out.append((doc_id, len(words), int(len(own) - own.sum()), int(edge.sum()), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if keep_text else None))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), _RESULT)], schema=_RESULT)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: int = PREFIX, step: int = STEP, group: int = GROUP, keep_text: bool = False, block_bytes: int = common.BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, n_spans, kept_sha256, kept_text) of each row of `docs`: what is left without repeats, its words joined by one space.

    n_spans: maximal runs of removed words. kept_text: null unless keep_text. See the module for nulls, ties and repeated rows.
    """
    shape = (window, prefix, step)
    base = common.base_columns(docs, key, text)
    n = common.block_count(base, block_bytes)
    blocks = common.in_blocks(base, n)
    seen = common.count_keys(blocks, lambda t: _prefix_counts(t, *shape), n).select("block", "bucket", "kind", "answer")
    asked = blocks.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(lambda d, s: _ask(common.unpacked(d), s, shape, group, n), ASKED)
    found = common.dealt(asked, n, "bucket").groupBy("bucket").applyInArrow(lambda t: _grow(t), "block int, bucket int, kind int, answer binary")
    return blocks.groupBy("block").cogroup(seen.union(found).groupBy("block")).applyInArrow(lambda d, s: _cut(common.unpacked(d), s, shape, group, keep_text), RESULT)

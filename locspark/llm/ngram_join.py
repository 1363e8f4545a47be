"""Join of texts whose word n-gram sets are alike, by a prefix tree.

A text's set are its distinct n-grams of lower-cased words; two texts link when 100 |A and B| >= percent |A or B|.

1. Every n-gram's document frequency is counted over the corpus (see `common`). All sets are ordered by it, rare first,
   which is one global order. N-grams of one text alone match nothing and aren't carried on; a text with too few others
   has no partner and is done.
2. Equal sets form one class, which goes on once.
3. Linked texts share an n-gram of their prefixes, the first |A| - ceil(percent |A| / 100) + 1 in the order. Texts that
   share one are put into candidate groups (components of stars: one link a text and n-gram, never all pairs).
4. In each group the sets are stored in a prefix tree, frequent n-grams first. Each text walks the tree with the overlap
   so far, which all below a node share; subtrees go when the overlap and what remains can't reach the bound, or when
   all of their texts are already connected with it. A large group is cut into parts, and each two parts are one task.
5. The links found connect the classes; a component's name is its smallest id.

Null and empty texts have no set, link with nothing and are components of their own, as are rows with a null id, which
carry the name of their class if it has one. Repeated rows are copies of each other. Texts of any length are read whole, a
longer one makes a larger block. Other columns, of whatever name, are left out. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common
from locspark.llm.components import components, with_least

#: Texts of a candidate group that one task takes; larger groups are cut into parts of this size.
PART = 3000
#: Frequencies are counted by this part of the hashes. N-grams that share it count as more frequent than they are, which
#: changes the order (for all texts alike), never a link: sets are compared by whole hashes.
FREQUENCY_BITS = np.uint64(0xFFFFFFFFFFFF0000)
#: Bytes of text in a block: the sets of a block take several times as much memory.
BLOCK_BYTES = 4 << 20

SETS = "doc_id long, n_shingles long, digest binary, tokens binary, freqs binary"
_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("tokens", pa.binary()), ("freqs", pa.binary())])


def shingle_sets(table: pa.Table, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data, offsets = common.text_buffer(table["text"])
    for first, last, raw, at in common.pieces(data, offsets):
        w, doc = common.word_hashes(raw, at)
        h = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            h = common.mix(h * common.U64(0x9FB21C651E98DF25) + w[k : k + len(h)])
        ends = np.searchsorted(doc, np.arange(last - first + 1))
        for d in range(last - first):
            a, z = int(ends[d]), int(ends[d + 1])
            if z - a >= words:
                yield np.unique(h[a : z - words + 1])
            elif z > a:
                short = np.uint64(z - a)
                for x in w[a:z]:
                    short = common.mix((np.array([short], np.uint64) + common.U64(77)) * common.U64(0x9FB21C651E98DF25) + x)[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _frequencies(table: pa.Table, words: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    keys, counts = np.unique(np.concatenate(list(shingle_sets(table, words))) & FREQUENCY_BITS, return_counts=True)
    return [(0, keys, counts)]


def needed(n: int, percent: int) -> int:
    """What a set of n must share with any partner."""
    return -(-percent * n // 100)


@common.frugal
def _candidates(docs: pa.Table, answers: pa.Table, words: int, percent: int) -> pa.Table:
    if not docs.num_rows:
        return _SETS.empty_table()
    sets = list(shingle_sets(docs, words))
    keys, freq = np.unique(np.concatenate(sets) & FREQUENCY_BITS), common.answers(answers, 0)
    out = []
    for doc_id, s in zip(docs["doc_id"].to_pylist(), sets):
        f = freq[np.searchsorted(keys, s & FREQUENCY_BITS)] if len(s) else np.zeros(0, np.uint32)
        shared = f > 1
        if not len(s) or shared.sum() < needed(len(s), percent):
            out.append((doc_id, len(s), None, None, None))
        else:
            t, f = s[shared], f[shared]
            order = np.lexsort((t, f))
            out.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), t[order].tobytes(), np.minimum(f[order], 2**32 - 1).astype(np.uint32).tobytes()))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out), _SETS)], schema=_SETS)


_POSTING = pa.schema([("token", pa.int64()), ("rep", pa.int64())])


def _postings(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The prefix of each class's set, without the n-grams that are in no other text."""
    for batch in batches:
        tokens, reps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rep, n, raw in zip(*(batch.column(k).to_pylist() for k in ("rep", "n_shingles", "tokens"))):
            t = np.frombuffer(raw, np.int64)
            prefix = n - needed(n, percent) + 1 - (n - len(t))
            tokens.append(t[: max(0, prefix)])
            reps.append(np.full(len(tokens[-1]), rep, np.int64))
        yield pa.record_batch([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(reps))], schema=_POSTING)


class Node:
    __slots__ = ("label", "children", "ends", "n_min", "n_max", "longest", "inside")

    def __init__(self, label: list[int]):
        self.label, self.children, self.ends = label, {}, []
        self.n_min, self.n_max, self.longest, self.inside = 1 << 60, 0, 0, set()


class PrefixTree:
    """Sets of ordered numbers in a compressed prefix tree, with bounds for each subtree."""

    def __init__(self, percent: int):
        self.percent, self.root, self.up, self.links = percent, Node([]), {}, []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def insert(self, doc: int, n: int, s: list[int]) -> None:
        self.up.setdefault(doc, doc)
        node, at = self.root, 0
        while True:
            node.n_min, node.n_max, node.longest = min(node.n_min, n), max(node.n_max, n), max(node.longest, len(s) - at)
            node.inside.add(doc)
            if at == len(s):
                node.ends.append((doc, n))
                return
            child = node.children.get(s[at])
            if child is None:
                child = node.children[s[at]] = Node(s[at:])
            else:
                label, k, most = child.label, 1, min(len(child.label), len(s) - at)
                while k < most and label[k] == s[at + k]:
                    k += 1
                if k < len(label):  # the new set leaves the path here: cut it
                    upper = Node(label[:k])
                    upper.n_min, upper.n_max, upper.longest, upper.inside = child.n_min, child.n_max, child.longest + len(label) - k, set(child.inside)
                    child.label = label[k:]
                    upper.children[label[k]] = child
                    node.children[s[at]] = child = upper
            at += len(child.label)
            node = child

    def probe(self, doc: int, n: int, s: list[int]) -> None:
        """Links the text with stored ones until it is connected with all that it links with."""
        own, self.up[doc] = set(s), doc
        stack = [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            node.inside = {self.find(x) for x in node.inside}
            if node.inside == {self.find(doc)}:
                continue
            if node.label:
                shared += len(own.intersection(node.label))
                left = len(s) - bisect_right(s, node.label[-1])
            else:
                left = len(s)
            bound = self.percent * (n + node.n_min)
            if (100 + self.percent) * (shared + min(left, node.longest)) < bound or 100 * node.n_max < self.percent * n:
                continue
            for other, m in node.ends:
                if (100 + self.percent) * shared >= self.percent * (n + m) and self.find(other) != self.find(doc):
                    self.links.append((doc, other))
                    a, b = sorted((self.find(doc), self.find(other)))
                    self.up[b] = a
            # the children that go on like this text come last, and so are looked at first
            stack += [(c, shared) for t, c in node.children.items() if t not in own]
            stack += [(c, shared) for t, c in reversed(node.children.items()) if t in own]


def linked(reps: list[int], sizes: list[int], sets: list[np.ndarray], freqs: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all linked sets of one group."""
    tokens, where = np.unique(np.concatenate(sets), return_inverse=True)
    freq = np.zeros(len(tokens), np.int64)
    freq[where] = np.concatenate(freqs)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -freq))] = np.arange(len(tokens))
    ranks = np.split(rank[where], np.cumsum([len(s) for s in sets])[:-1])
    tree, numbers = PrefixTree(percent), list(range(len(tokens)))  # the sets share these numbers
    for i in np.lexsort((reps, sizes)):
        s = [numbers[r] for r in np.sort(ranks[i]).tolist()]
        tree.probe(int(i), sizes[i], s)
        tree.insert(int(i), sizes[i], s)
    return [(reps[a], reps[b]) for a, b in tree.links]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@common.frugal
def _join_task(table: pa.Table, percent: int) -> pa.Table:
    part = table["part"].to_numpy()
    order = np.argsort(part, kind="stable")
    cuts = np.split(order, np.flatnonzero(np.diff(part[order])) + 1)
    reps, sizes = table["rep"].to_pylist(), table["n_shingles"].to_pylist()
    tokens, freqs = table["tokens"].to_pylist(), table["freqs"].to_pylist()
    out = []
    for own in cuts:
        out += linked([reps[i] for i in own], [sizes[i] for i in own], [np.frombuffer(tokens[i], np.uint64) for i in own], [np.frombuffer(freqs[i], np.uint32) for i in own], percent)
    return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=_LINK)


def ngram_join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, part: int = PART, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of `docs`; see the module."""
    base = common.base_columns(docs, key, text)
    n = common.block_count(base, block_bytes)
    blocks = common.in_blocks(base, n)
    seen = common.count_keys(blocks, lambda t: _frequencies(t, words), n).select("block", "bucket", "kind", "answer")
    sets = common.written(blocks.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(lambda d, a: _candidates(common.unpacked(d), a, words, percent), SETS))
    shared = sets.filter("digest is not null")
    classes = common.written(shared.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("tokens").alias("tokens"), F.first("freqs").alias("freqs")))
    named = classes.filter("rep is not null")

    postings = common.written(named.select("rep", "n_shingles", "tokens").mapInArrow(lambda b: _postings(b, percent), "token long, rep long"))
    groups = components(with_least(postings, "token", "rep").filter("rep <> least").select("rep", "least"))
    groups = groups.union(groups.select(F.col("component").alias("node"), "component").distinct())

    sized = groups.join(groups.groupBy("component").agg(F.count("*").alias("size")), "component")
    cuts = F.ceil(F.col("size") / part).cast("int")
    own = F.pmod(F.xxhash64("node"), cuts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda j: F.concat_ws("-", F.col("component"), F.least(own, j), F.greatest(own, j)))
    tasks = sized.select("node", "size", F.explode(pairs).alias("task")).select("node", F.xxhash64("task").alias("part"), F.when(F.col("size") > part // 4, F.xxhash64("task")).otherwise(F.pmod(F.xxhash64("task"), F.lit(4 * n))).alias("task"))
    work = tasks.join(named, F.col("node") == F.col("rep")).select("task", "part", "rep", "n_shingles", "tokens", "freqs")
    links = work.groupBy("task").applyInArrow(lambda t: _join_task(t, percent), "a long, b long")

    names = components(links)
    named_classes = classes.select("digest", "rep").join(names, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return (
        shared.select("doc_id", "n_shingles", "digest").join(named_classes, "digest").select("doc_id", "n_shingles", "component_id")
        .union(sets.filter("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without the rows that link with one of smaller id, directly or by others; rows with a null id stay.

    Rows go by a hash of id and text, so that of a repeated id each text is judged by itself; rows with both equal stay.
    """
    row, own = F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")), F.col(key).cast("long")
    base = docs.select(row.alias("row"), own.alias("id"), F.col(text).alias("text"))
    groups = ngram_join(base, "row", "text", **options).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")).distinct()
    rows = groups.join(base.filter("id is not null").select("row", "id").distinct(), "row").select("group", F.struct("id", "row").alias("place"))
    others = with_least(common.written(rows), "group", "place").filter("place.row <> least.row").select(F.col("place.row").alias("other"))
    whole = docs.select(F.struct(*docs.columns).alias("whole"), row.alias("row"))
    return whole.join(others, whole.row == others.other, "left_anti").select(*(F.col(f"whole.`{c}`") for c in docs.columns))

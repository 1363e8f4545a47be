"""Scoring of texts by a smoothed n-gram model, held as a weighted backoff automaton.

States are the histories seen in training. A state with an arc for the next token takes it, weighted with the log of the
interpolated probability; from any state a failure arc, weighted with the log of what smoothing leaves over, leads to
the shorter history, down to the state without history, which has arcs for all tokens (unknown ones share one). Each
text is read once from left to right: its start state is the start of text, and the state after a token is the longest
known history that ends in it.

    p(w)      = (c(w) + 0.1) / (N + 0.1 (V + 1))
    p(w | h)  = (1 - l(h)) c(h w) / c(h) + l(h) p(w | h')        h': h without its first token
    l(h)      = min(1, a c(h)**-b), and 1 for an unknown h

so the probabilities of all tokens after a history add up to one. Counts are exact over all training rows. The
automaton isn't broadcast, as it grows with the corpus: each block of texts asks for just the states and arcs that its
texts can pass (see `common`) and builds that part of the automaton. Of longer n-grams only those are asked for whose first
and last tokens but one occur in training rows of other blocks too; the others' counts are known in the block. The block's
texts are then read side by side, token by token; a text of more than `SEGMENT` tokens is read in segments, each of which
passes the tokens before it that decide its first state.

Training rows are those whose crc32(doc_id as text) mod `folds` isn't 0 (a null id counts as held out). Null and empty
texts consist of the end token alone. Repeated rows count, and are scored, each. Other columns, of whatever name, are left
out. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

#: Hashes of the start and the end of a text, which no word has.
START, END = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
#: Smoothing, a and b of l(h): the best on held-out texts of ten pairs tried.
LEFT_A, LEFT_B = 0.6, 0.03
ORDER = 3
#: The part of an n-gram's hash that is its key: a byte less is sent, and an n-gram shares its key with one of 10**9 others once in 7 * 10**7 times.
KEY_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
#: Tokens of a text that are read in one go.
SEGMENT = 1024
_START_KIND = 99

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def is_held_out(doc_id: int | None, folds: int) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def token_stream(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts one after the other, each text from START to END, and the text of each."""
    data, offsets = common.text_buffer(table["text"])
    tokens, docs = [], []
    for first, last, raw, at in common.pieces(data, offsets):
        words, doc = common.word_hashes(raw, at)
        n = last - first
        out = np.empty(len(words) + 2 * n, np.uint64)
        own = np.empty(len(out), np.int32)
        ends = np.searchsorted(doc, np.arange(n), "right") + 2 * np.arange(n) + 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        where = np.arange(len(words)) + 2 * doc + 1
        out[where], own[where] = words, doc
        out[starts], out[ends], own[starts], own[ends] = START, END, np.arange(n), np.arange(n)
        tokens.append(out)
        docs.append(own + np.int32(first))
    return (np.concatenate(tokens), np.concatenate(docs)) if tokens else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


class Grams:
    """The n-grams of a block's texts: `keys[n]` sorted and distinct, the index of the one that ends at each place in `at[n]` (-1: none), `last[n]` one such place for each, and in `own[n]` how often each occurs in training rows."""

    def __init__(self, table: pa.Table, order: int, folds: int):
        self.order, self.tokens, self.docs = order, *token_stream(table)
        self.train = np.array([not is_held_out(i, folds) for i in table["doc_id"].to_pylist()], bool)
        weight = self.train[self.docs].astype(np.float64)
        self.keys, self.at, self.last, self.own = {}, {}, {}, {}
        keys, inside = self.tokens, np.arange(len(self.tokens))
        for n in range(1, order + 1):
            if n > 1:
                keys = common.mix(keys[:-1] * common.U64(0xA24BAED4963EE407) + self.tokens[n - 1 :] + common.U64(n)) & KEY_BITS
                inside = np.flatnonzero(self.docs[n - 1 :] == self.docs[: len(self.docs) - n + 1]) + n - 1
            self.keys[n], first, which = common.distinct(keys[inside - n + 1])
            self.at[n] = np.full(len(self.tokens), -1, np.int32)
            self.at[n][inside] = which
            self.last[n] = inside[first]
            self.own[n] = np.bincount(which, weight[inside], len(self.keys[n]))
        self.start = int(np.searchsorted(self.keys[1], START))

    def words(self) -> np.ndarray:
        """Which distinct tokens are no start of a text."""
        return np.arange(len(self.keys[1])) != self.start

    def asked(self, n: int, below: np.ndarray) -> np.ndarray:
        """Which n-grams (n > 2) can occur in training rows of other blocks, by the counts of those shorter by one."""
        elsewhere = below > self.own[n - 1]
        return elsewhere[self.at[n - 1][self.last[n] - 1]] & elsewhere[self.at[n - 1][self.last[n]]]

    def counts(self, known: pa.Table, upto: int) -> dict[int, np.ndarray]:
        """How often each n-gram, of up to `upto` tokens, occurs in training rows of all blocks."""
        out = {1: np.empty(len(self.keys[1]))}
        out[1][self.words()] = common.answers(known, 1)
        out[1][self.start] = common.answers(known, _START_KIND)[0]
        for n in range(2, upto + 1):
            out[n] = self.own[n].copy()
            out[n][self.asked(n, out[n - 1]) if n > 2 else slice(None)] = common.answers(known, n)
        return out


def _first_questions(table: pa.Table, order: int, folds: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    g = Grams(table, min(order, 2), folds)
    words = g.words()
    return [(1, g.keys[1][words], g.own[1][words]), (_START_KIND, g.keys[1][~words], g.own[1][~words]), *((n, g.keys[n], g.own[n]) for n in g.keys if n > 1)]


def _further_questions(table: pa.Table, known: pa.Table, n: int, folds: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    g = Grams(table, n, folds)
    ask = g.asked(n, g.counts(known, n - 1)[n - 1])
    return [(n, g.keys[n][ask], g.own[n][ask])]


class Automaton:
    """The states and arcs that a block's texts can pass: state 0 has no history, the others go by their history's n-gram.

    Arcs are looked up by state and token; `weight` and `target` are theirs. Each state but 0 has a failure arc. State 0 has
    an arc for every token.
    """

    def __init__(self, grams: Grams, counts: dict[int, np.ndarray], total: int, known: int, left: tuple[float, float]):
        self.size, order, a, b = len(grams.keys[1]), grams.order, *left
        base = {1: 1} | {n: 1 + sum(len(grams.keys[m]) for m in range(1, n)) for n in range(2, order)}
        p = {1: (counts[1] + 0.1) / (total + 0.1 * (known + 1))}
        history = order > 1  # without it there is only state 0
        self.base_weight = np.log10(p[1])
        self.base_target = np.where((counts[1] > 0) & history, base[1] + np.arange(self.size), 0)
        ends = grams.keys[1] == END  # no state follows the end of a text
        self.base_target[ends] = 0
        self.start = int(self.base_target[grams.start])
        # what smoothing leaves over, by state
        n_states = 1 + sum(len(grams.keys[n]) for n in range(1, order))
        rest, self.failure_target = np.ones(n_states), np.zeros(n_states, np.int32)
        for n in range(1, order):
            own = slice(base[n], base[n] + len(grams.keys[n]))
            rest[own] = np.where(counts[n] > 0, np.minimum(1.0, a * np.maximum(counts[n], 1.0) ** -b), 1.0)
            self.failure_target[own] = base[n - 1] + grams.at[n - 1][grams.last[n]] if n > 1 else 0
        self.failure_weight = np.log10(rest)
        keys, weight, target = [], [], []
        for n in range(2, order + 1):
            last = grams.last[n]
            before, shorter = grams.at[n - 1][last - 1], grams.at[n - 1][last]
            state = base[n - 1] + before.astype(np.int64)
            p[n] = (1 - rest[state]) * counts[n] / np.maximum(counts[n - 1][before], 1) + rest[state] * p[n - 1][shorter]
            seen = counts[n] > 0
            keys.append((state * self.size + grams.at[1][last])[seen])
            weight.append(np.log10(p[n][seen]))
            p.pop(n - 1)
            target.append(np.where(ends[grams.at[1][last]], 0, base[n] + np.arange(len(last)) if n < order else base[n - 1] + shorter)[seen].astype(np.int32))
        empty = [np.zeros(0, np.int64)]
        self.weight, self.target, keys = np.concatenate(weight or empty), np.concatenate(target or empty), np.concatenate(keys or empty)
        self.arcs = common.NumberTable(max(4, (3 * len(keys) // 2).bit_length()))
        self.arcs.put(keys, np.arange(len(keys), dtype=np.int32))
        self.taken = self.failed = 0

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads one token in each state: failure arcs are followed until an arc fits. (weights passed, next states)."""
        weight, state, after, rest = np.zeros(len(state)), state.copy(), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(rest):
            own, t = state[rest], token[rest]
            arc = self.arcs.get(own * self.size + t)
            hit, bare = arc >= 0, own == 0
            weight[rest[hit]] += self.weight[arc[hit]]
            after[rest[hit]] = self.target[arc[hit]]
            weight[rest[bare]] += self.base_weight[t[bare]]
            after[rest[bare]] = self.base_target[t[bare]]
            fails = ~(hit | bare)
            self.taken, self.failed = self.taken + len(rest) - int(fails.sum()), self.failed + int(fails.sum())
            rest, own = rest[fails], own[fails]
            weight[rest] += self.failure_weight[own]
            state[rest] = self.failure_target[own]
        return weight, after

    def traverse(self, token: np.ndarray, begins: np.ndarray, order: int, segment: int = SEGMENT) -> np.ndarray:
        """The weight of each place of the stream, for texts that begin (with START) at the given places."""
        ends = np.concatenate((begins[1:], [len(token)]))
        n = -(-(ends - begins - 1) // segment)
        text = np.repeat(np.arange(len(begins)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        counted = begins[text] + 1 + number * segment
        stop = np.minimum(counted + segment, ends[text])
        first = np.where(number > 0, np.maximum(counted - (order - 1), begins[text] + 1), counted)
        state = np.where(number > 0, 0, self.start).astype(np.int64)
        longest = np.argsort(first - stop, kind="stable")
        first, counted, stop, state = first[longest], counted[longest], stop[longest], state[longest]
        out = np.zeros(len(token))
        for k in range(int((stop - first).max(initial=0))):
            on = int(np.searchsorted(first - stop, -k, "left"))  # those of more than k tokens
            place = first[:on] + k
            weight, state[:on] = self.step(state[:on], token[place])
            own = place >= counted[:on]
            out[place[own]] = weight[own]
        return out


@common.frugal
def _score(table: pa.Table, known: pa.Table, order: int, folds: int, total: int, distinct: int, left: tuple[float, float]) -> pa.Table:
    if not table.num_rows:
        return _RESULT.empty_table()
    grams = Grams(table, order, folds)
    counts = grams.counts(known, order)
    automaton = Automaton(grams, counts, total, distinct, left)
    seen = counts[1] > 0
    del counts, known, grams.keys, grams.last, grams.own
    token, words = grams.at[1], np.flatnonzero(grams.tokens != START)
    score = automaton.traverse(token, np.flatnonzero(grams.tokens == START), order)[words]
    doc, n, ids = grams.docs[words], table.num_rows, table["doc_id"].to_pylist()
    return pa.table([
        pa.array(ids, pa.int64()), pa.array(~grams.train), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, seen[token[words]], n).astype(np.int64)),
        pa.array([total] * n, pa.int64()), pa.array(np.round(np.bincount(doc, automaton.base_weight[token[words]], n), 6)), pa.array(np.round(np.bincount(doc, score, n), 6)),
    ], schema=_RESULT)


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, folds: int = 10, left: tuple[float, float] = (LEFT_A, LEFT_B), block_bytes: int = common.BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), scores in log10 to six decimals.

    base_score: without history. score: along the automaton of n-grams up to `order`. n_known: tokens seen in training.
    """
    base = common.base_columns(docs, key, text)
    n = common.block_count(base, block_bytes)
    blocks = common.in_blocks(base, n)
    seen = common.written(common.count_keys(blocks, lambda t: _first_questions(t, order, folds), n))
    total, known = seen.filter("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    seen = seen.select("block", "bucket", "kind", "answer")
    for m in range(3, order + 1):
        more = common.count_keys(blocks, lambda t, k, m=m: _further_questions(t, k, m, folds), n, seen)
        seen = seen.union(common.written(more.select("block", "bucket", "kind", "answer")))
    return blocks.groupBy("block").cogroup(seen.groupBy("block")).applyInArrow(lambda d, a: _score(common.unpacked(d), a, order, folds, total, known, left), RESULT)

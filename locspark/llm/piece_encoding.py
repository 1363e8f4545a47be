"""Byte-pair pieces of a SentencePiece model: encoding by a table of last tokens, and decoding.

The encoding of each prefix of a text ends in exactly one token. An automaton over the pieces finds those that end at a
place; of these, the last token is the one that is compatible with the last token of the prefix before it: two tokens are
compatible if merging their joined characters gives just the two back. From the table of last tokens the ids are
recovered backwards, from the end of the text. No piece spans a change from other characters to the space mark or a
line feed, so texts are handled as units between these: the distinct units of a batch fill their tables side by side,
place by place, and a unit over `LONG` characters by itself. Whether two tokens are compatible is kept in a table of
bounded size, for as long as the worker lives.

Merging takes the adjacent pair whose joined piece has the best score, the leftmost of equals. Characters that are no
piece become the ids of their UTF-8 bytes. The model isn't trained here: its pieces come from a given file.

Null texts are empty and have no ids. Texts of any length are one pass over their units. Repeated rows are encoded each;
null and repeated ids do no harm, as each row is encoded by itself. Other columns, of whatever name, are left out. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

MARK = "▁"
#: Pairs of tokens whose compatibility is kept; beyond that the table starts anew.
KEPT_PAIRS = 400_000
#: Units of more characters are encoded one by one; of the others, so many at once.
LONG, UNITS = 64, 1 << 16
#: Bytes of text whose units are looked at together.
TEXT_BYTES = 4 << 20


class PieceModel:
    """Pieces with scores, as a model file has them.

    Tokens go by number: the pieces by id, then the start of a text, then characters without a piece by code point.
    """

    def __init__(self, pieces: list[tuple[str, float, int]]):
        """pieces: by id, (piece, score, kind) with kind 1 for ordinary pieces, 6 for bytes."""
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces may have the space mark at their start only, and no line feed")
        scores = sorted({pieces[i][1] for i in self.ids.values()}, reverse=True)
        place = {x: k for k, x in enumerate(scores)}
        self.rank = {p: place[pieces[i][1]] for p, i in self.ids.items()}
        self.splits: dict[str, tuple | None] = {}
        self.names, self.start, self.width = [p for p, _, _ in pieces] + [""], len(pieces), 1 << 22
        self.sizes = np.array([len(x) for x in self.names], np.int32)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(MARK, " ").encode() for p, _, kind in pieces]
        self.spelled = [str(i) for i in range(len(pieces))]
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 6:
                self.byte_ids[int(p[3:5], 16)] = i
        self.pairs, self.single_pairs = common.NumberTable(20), {}
        self._build_automaton()

    def _build_automaton(self) -> None:
        """States of the pieces' prefixes; an arc's key is its state's number times the alphabet, plus the character's code."""
        alphabet = sorted({c for p in self.ids for c in p})
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        code, self.alphabet = {c: k + 1 for k, c in enumerate(alphabet)}, len(alphabet) + 1
        self.arcs: dict[int, int] = {}
        ends = [-1]
        for p, i in self.ids.items():
            state = 0
            for c in p:
                key = state * self.alphabet + code[c]
                state = self.arcs.setdefault(key, len(ends))
                if state == len(ends):
                    ends.append(-1)
            ends[state] = i
        self.ends, self.longest = np.array(ends, np.int32), max(map(len, self.ids), default=0)
        self.arc_table = common.NumberTable(max(4, (2 * len(self.arcs)).bit_length()))
        self.arc_table.put(np.fromiter(self.arcs, np.int64, len(self.arcs)), np.fromiter(self.arcs.values(), np.int32, len(self.arcs)))

    @classmethod
    def load(cls, path: str) -> PieceModel:
        return cls(load_pieces(path))

    def last_merge(self, token: str) -> tuple[str, str] | tuple[()] | None:
        """The two parts that a piece was last merged from: () for one character, None if merging doesn't give the piece."""
        if token not in self.splits:
            parts = list(token)
            while len(parts) > 2 and (at := self.best(parts)) >= 0:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = () if len(token) < 2 else tuple(parts) if len(parts) == 2 and token in self.rank else None
        return self.splits[token]

    def best(self, parts: list[str]) -> int:
        """Where the next merge is, or -1."""
        ranks = [self.rank.get(x + y, self.width) for x, y in zip(parts, parts[1:])]
        low = min(ranks, default=self.width)
        return ranks.index(low) if low < self.width else -1

    def merged(self, text: str) -> list[str]:
        """The tokens of a short string, by merging."""
        parts = list(text)
        while (at := self.best(parts)) >= 0:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """If merging the characters of both gives just the two.

        Goes back in time over the merges that made them: whenever the parts on both sides of the border would have
        been joined before the next merge took one of them away, the two aren't compatible. Pieces of space marks alone
        share one score, so their merges have no order in time; they are merged afresh.
        """
        if self.last_merge(a) is None or self.last_merge(b) is None:
            return False
        if a[:2] == MARK * 2 or (a[-1:] == MARK and b[:1] == MARK):
            return self.merged(a + b) == [a, b]
        limit = float(self.width)
        while a:
            if self.rank.get(a + b, self.width) < limit:
                return False
            left, right = self.last_merge(a), self.last_merge(b)
            if not left and not right:
                break
            if left and (not right or self.rank[a] > self.rank[b]):
                limit, a = self.rank[a], left[1]
            else:  # of equal merges the left one is first, so this is the later one
                limit, b = self.rank[b] + 0.5, right[0]
        return True

    def name(self, token: int) -> str:
        return self.names[token] if token <= self.start else chr(token - self.start - 1)

    def fits(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """If each token can follow the one before it; answers are kept for later."""
        # no merge reaches over a character without a piece: what follows is as at the start of a text
        keys = np.minimum(before, self.start).astype(np.int64) * self.width + after
        out = self.pairs.get(keys)
        new = np.unique(keys[out < 0])
        if len(new):
            if self.pairs.n + len(new) > KEPT_PAIRS:
                self.pairs.clear()
            answers = np.array([self.compatible(self.names[k // self.width], self.names[k % self.width]) for k in new.tolist()], np.int32)
            for a in range(0, len(new), KEPT_PAIRS // 2):
                if self.pairs.n + len(new[a : a + KEPT_PAIRS // 2]) > KEPT_PAIRS:
                    self.pairs.clear()
                self.pairs.put(new[a : a + KEPT_PAIRS // 2], answers[a : a + KEPT_PAIRS // 2])
            out[out < 0] = answers[np.searchsorted(new, keys[out < 0])]
        return out > 0

    def matches(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in a row of characters: (where, how long, which), by a walk of the automaton from every place.

        left: how many characters there are from each place to the end of its unit.
        """
        alive, state, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), []
        for size in range(1, self.longest + 1):
            arcs = state * self.alphabet + codes[alive + size - 1]
            state = self.arc_table.get(arcs).astype(np.int64)
            on = state >= 0
            alive, state = alive[on], state[on]
            which = self.ends[state]
            hit = which >= 0
            found.append((alive[hit].astype(np.int32), np.full(int(hit.sum()), size, np.int32), which[hit]))
            more = left[alive] > size
            alive, state = alive[more], state[more]
            if not len(alive):
                break
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32),) * 3

    def tokens(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of units one after the other, and where each unit's start and end in them."""
        size = np.fromiter(map(len, units), np.int64, len(units))
        text = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        starts = np.cumsum(size) - size
        unit = np.repeat(np.arange(len(units)), size)
        codes, left = self.codes[text], (starts + size)[unit] - np.arange(len(text))
        where, length, which = self.matches(codes, left)
        # a unit of n characters has n + 1 places, from the one before its first character
        first = starts + np.arange(len(units))
        last = np.full(len(text) + len(units), -1, np.int32)
        last[first] = self.start
        bare = np.flatnonzero(codes == 0)
        last[bare + unit[bare] + 1] = self.start + 1 + text[bare].astype(np.int32)
        # by the number of characters before the end of the piece, the longest piece first
        number = where - starts[unit[where]] + length
        order = np.argsort((number * 64 + 63 - np.minimum(length, 63)).astype(np.uint16 if len(number) == 0 or number.max() < 1023 else np.int64), kind="stable")
        end, length, which, number = (where + unit[where] + length)[order], length[order], which[order], number[order]
        cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(length) != 0)) + 1
        for a, z in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(end)])).tolist()):
            at, piece = end[a:z], which[a:z]
            open_ = last[at] < 0
            at, piece = at[open_], piece[open_]
            if len(at):
                before = last[at - length[a]]
                good = (before >= 0) & self.fits(np.maximum(before, 0), piece)
                last[at[good]] = piece[good]
        return self.backwards(last, first, size)

    def backwards(self, last: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each unit, from the table of last tokens."""
        at, own, steps = first + size, np.flatnonzero(size > 0), []
        while len(own):
            token = last[at[own]]
            if (token < 0).any():
                raise ValueError("the pieces aren't those of a byte-pair model: a prefix has no last token")
            steps.append((own, token))
            at[own] -= np.where(token < self.start, self.sizes[np.minimum(token, self.start)], 1)
            own = own[at[own] > first[own]]
        count = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(size)) if steps else np.zeros(len(size), np.int64)
        edge = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(edge[-1], np.int32)
        for k, (own, token) in enumerate(steps, 1):
            out[edge[own + 1] - k] = token
        return out, edge

    def long_tokens(self, unit: str) -> list[int]:
        """The tokens of one unit of any length, character by character."""
        n = len(unit)
        last, codes, known = [-1] * (n + 1), self.codes[np.frombuffer(unit.encode("utf-32-le"), np.uint32)].tolist(), self.single_pairs
        last[0] = self.start
        open_: list[list[tuple[int, int]]] = [[] for _ in range(self.longest + 1)]  # pieces that end so many characters on
        for at in range(n):
            if not codes[at]:
                last[at + 1] = self.start + 1 + ord(unit[at])
            state = 0
            for size in range(1, min(self.longest, n - at) + 1):
                state = self.arcs.get(state * self.alphabet + codes[at + size - 1], -1)
                if state < 0:
                    break
                if self.ends[state] >= 0:
                    open_[(at + size) % (self.longest + 1)].append((int(self.ends[state]), size))
            ready = open_[(at + 1) % (self.longest + 1)]
            for piece, size in ready:  # the longest began first
                if last[at + 1] < 0 <= last[at + 1 - size]:
                    key = min(last[at + 1 - size], self.start) * self.width + piece
                    fits = known.get(key)
                    if fits is None:
                        if len(known) > KEPT_PAIRS // 4:
                            known.clear()
                        fits = known[key] = self.compatible(self.names[key // self.width], self.names[piece])
                    if fits:
                        last[at + 1] = piece
            ready.clear()
        out = []
        while n:
            if last[n] < 0:
                raise ValueError("the pieces aren't those of a byte-pair model: a prefix has no last token")
            out.append(last[n])
            n -= int(self.sizes[last[n]]) if last[n] < self.start else 1
        return out[::-1]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's start and end in them."""
        number = defaultdict(itertools.count().__next__)  # units by the order in which they come
        counts, parts = [], []
        for text in texts:
            units = _UNIT.findall(MARK + text.replace(" ", MARK)) if text else []
            counts.append(len(units))
            parts.append(np.fromiter(map(number.__getitem__, units), np.int32, len(units)))
        which = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        units = list(number)
        flat, edges = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        short = [i for i, u in enumerate(units) if len(u) <= LONG]
        for a in range(0, len(short), UNITS):
            tokens, edge = self.tokens([units[i] for i in short[a : a + UNITS]])
            edges.append(edge[1:] + edges[-1][-1])
            flat.append(tokens)
        order = short
        if len(short) < len(units):
            long = [i for i, u in enumerate(units) if len(u) > LONG]
            order = short + long
            for i in long:
                flat.append(np.array(self.long_tokens(units[i]), np.int32))
                edges.append(edges[-1][-1:] + len(flat[-1]))
        flat, edge, place = np.concatenate(flat), np.concatenate(edges), np.empty(len(units), np.int64)
        place[np.array(order, np.int64)] = np.arange(len(units))
        own = place[which]
        size = edge[own + 1] - edge[own]
        ends = np.cumsum(size)
        tokens = flat[np.repeat(edge[own] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts))).astype(np.int64)]
        return self.to_ids(tokens, at)

    def to_ids(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens as ids: characters without a piece become their bytes."""
        bare = tokens > self.start
        if not bare.any():
            return tokens, at
        points = tokens[bare] - self.start - 1
        size = np.ones(len(tokens), np.int64)
        size[bare] = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        out = np.repeat(tokens, size)
        out[np.repeat(bare, size)] = self.byte_ids[np.frombuffer("".join(map(chr, points.tolist())).encode(), np.uint8)]
        return out, np.concatenate(([0], np.cumsum(size)))[at]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, without the space mark before the first."""
        return b"".join([self.raw[i] for i in ids])[1:].decode("utf-8", "replace")


_UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def load_pieces(path: str) -> list[tuple[str, float, int]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 6 if sp.is_byte(i) else 3 if sp.is_control(i) else 2 if sp.is_unknown(i) else 1
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


#: The model that this worker used last, by the digest of its pieces.
_kept: dict[str, PieceModel] = {}


def _model(name: str, pieces) -> PieceModel:
    if name not in _kept:
        _kept.clear()
        _kept[name] = PieceModel(pieces.value)
    return _kept[name]

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string"


def _runs(texts: pa.Array, size: int = TEXT_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `size` bytes of text."""
    _, offsets = common.text_buffer(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def _encode(batches: Iterator[pa.RecordBatch], name: str, pieces, keep: bool) -> Iterator[pa.RecordBatch]:
    model = _model(name, pieces)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        for first, last in _runs(batch.column(1)):
            part = batch.slice(first, last - first)
            ids, at = model.encode(part.column(1).to_pylist())
            spelled, decoded = [], []
            for a, z in zip(at[:-1].tolist(), at[1:].tolist()):
                own = ids[a:z].tolist()
                spelled.append(sha(",".join([model.spelled[i] for i in own])))
                text = model.decode(own)
                decoded.append((sha(text), text if keep else None))
            none = [None] * len(part)
            yield pa.record_batch([
                part.column(0), pa.array(np.diff(at)), pa.array(spelled, pa.string()), pa.array([x for x, _ in decoded], pa.string()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())) if keep else pa.array(none, pa.list_(pa.int32())), pa.array([x for _, x in decoded] if keep else none, pa.string()),
            ], schema=_RESULT)
            del ids, spelled, decoded
            common.give_back()


def encode_pieces(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded) of each row; ids and decoded are null with keep=False.

    The model's pieces, of fixed number, are sent to the executors.
    """
    found = load_pieces(model_path)
    name = hashlib.sha256(repr(found).encode()).hexdigest()
    pieces = docs.sparkSession.sparkContext.broadcast(found)
    return common.base_columns(docs, key, text).mapInArrow(lambda b: _encode(b, name, pieces, keep), RESULT)

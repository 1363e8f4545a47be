"""Licence scans by a positional index of rare licence words.

Texts are cut into words (A-Z lower-cased; every other ASCII character but letters and digits separates). Templates are
word sequences with a label and mandatory key phrases. All their words are indexed with the places they have in them. For
each text

1. its `LOOKUPS` licence words of highest inverse document frequency over all texts are looked up, and of each key phrase
   whose words all occur in it, those words,
2. the postings are intersected by relative position: each says where its template would have to start, and a candidate is
   a start that two different words agree on (one, if a key phrase has a single word),
3. a candidate counts if a key phrase stands in full at its place; its score is the share of the template's weight that
   stands at its place, its label is given if that reaches `least`. As the words of a phrase that stands are all looked up
   and agree, no such place is missed.

Base phrases are templates whose words must all stand; every such place counts.

Null and empty texts have no words, no labels and score 0. Texts are read whole; repeated rows, and rows of null or repeated
ids, are scanned each. Several notices of one text, of whatever scores, are all labelled. Other columns, of whatever name,
are left out. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # word ranges of which one must stand in full


def template(label: str, text: str, *keys: str) -> Template:
    words = tuple(text.split())
    ranges = tuple((i, i + len(k.split())) for k in keys for i in range(len(words)) if words[i : i + len(k.split())] == tuple(k.split()))
    return Template(label, words, ranges or ((0, len(words)),))


#: Phrases of the base count, each with its label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices, as plain words.
TEMPLATES = (
    template("mit", "released under the mit license", "mit license"),
    template("mit", "licensed under the mit license", "mit license"),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    template("cc0", "licensed under cc0 1 0 universal", "cc0 1 0"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    # fixed values: whole texts of two licences, in plain words
    template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but
        not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for
        any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software""", "permission is hereby granted free of charge", "to deal in the software without restriction", "shall be included in all copies or substantial portions", "the software is provided as is"),
    template("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions
        of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
        this software is provided by the copyright holders and contributors as is""", "redistribution and use in source and binary forms", "redistributions of source code must retain", "endorse or promote products derived from this software", "this software is provided by the copyright holders"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
)
#: Least share of a template's weight that must stand at its place.
LEAST = 0.6
#: How many of a text's rarest licence words are looked up in any case.
LOOKUPS = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATES = np.ones(256, bool)
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return common.range_hashes(raw, np.array([0]), np.array([len(raw)]))[0]


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = common.text_buffer(texts)
    for first, last, raw, at in common.pieces(data, offsets):
        low = _LOWER[raw]
        starts, ends, doc = common.spans(_SEPARATES[low], at)
        yield first, last, common.range_hashes(low, starts, ends), doc


class Index:
    """Licence words with their weights, and where each template has its rarest ones."""

    def __init__(self, templates: tuple[Template, ...], weights: dict[str, float]):
        self.templates, self.weights = templates, weights
        words = sorted({w for t in templates for w in t.words})
        hashes = np.array([_hash_of(w) for w in words], np.uint64)
        order = np.argsort(hashes)
        self.words, self.hashes = [words[i] for i in order], hashes[order]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[self.hashes & common.U64(0xFFFF)] = True
        of = {w: i for i, w in enumerate(self.words)}
        self.sequences = [np.array([of[w] for w in t.words]) for t in templates]
        self.mass = [np.array([weights[w] for w in t.words]) for t in templates]
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.sequences):
            for p, w in enumerate(t.tolist()):
                self.postings[w].append((k, p))
        self.phrases = sorted({tuple(sorted(set(t[a:z].tolist()))) for t, x in zip(self.sequences, templates) for a, z in x.keys})
        self.agreeing = [min([2, *(len(set(t[a:z].tolist())) for a, z in x.keys)]) for t, x in zip(self.sequences, templates)]
        self.order = {w: i for i, w in enumerate(sorted(range(len(self.words)), key=lambda w: (-weights[self.words[w]], self.words[w])))}

    def looked_up(self, words: set[int]) -> set[int]:
        """Of a text's licence words those to look up."""
        out = set(sorted(words, key=self.order.__getitem__)[:LOOKUPS])
        for phrase in self.phrases:
            if words.issuperset(phrase):
                out.update(phrase)
        return out

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of licence words, and which words they are."""
        at = np.flatnonzero(self.filter[hashes & common.U64(0xFFFF)])
        which = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        true = self.hashes[which] == hashes[at]
        return at[true], which[true]


def _count(batches: Iterator[pa.RecordBatch], words: list[str]) -> Iterator[pa.RecordBatch]:
    """How many texts of the partition have each licence word."""
    index = Index((Template("", tuple(words), ()),), dict.fromkeys(words, 0.0))
    total, n = np.zeros(len(words), np.int64), 0
    for batch in batches:
        n += batch.num_rows
        for _, _, h, doc in _words(batch.column(1)):
            at, which = index.find(h)
            total += np.bincount(np.unique(doc[at].astype(np.int64) * len(words) + which) % len(words), minlength=len(words))
    yield pa.record_batch([pa.array([*index.words, None]), pa.array([*total, n])], names=["word", "n"])


def word_weights(base: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequency of each given word over all texts; their number bounds what the driver gets."""
    counts = dict(base.mapInArrow(lambda b: _count(b, words), "word string, n long").groupBy("word").agg(F.sum("n")).collect())
    n = counts.get(None, 0)
    return {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 1e-6 for w in words}


def _scan(batches: Iterator[pa.RecordBatch], index: Index, base: list[tuple[int, str]], least: float) -> Iterator[pa.RecordBatch]:
    base_of = dict(base)
    for batch in batches:
        rows = []
        ids = batch.column(0).to_pylist()
        for first, last, h, doc in _words(batch.column(1)):
            n_words = np.bincount(doc, minlength=last - first)
            begin = np.concatenate(([0], np.cumsum(n_words)))
            places, base_labels, labels, score = defaultdict(list), defaultdict(set), defaultdict(set), defaultdict(float)
            at, which = index.find(h)
            known, of = dict(zip(at.tolist(), which.tolist())), doc[at]
            cuts = np.flatnonzero(np.diff(of)) + 1
            for places_of, words_of in zip(np.split(at, cuts), np.split(which, cuts)) if len(at) else ():
                d, look = int(doc[places_of[0]]), index.looked_up(set(words_of.tolist()))
                votes: dict[tuple[int, int], set[int]] = defaultdict(set)
                for p, w in zip(places_of.tolist(), words_of.tolist()):
                    if w in look:
                        for k, offset in index.postings[w]:
                            votes[k, p - offset].add(w)
                for (k, start), agree in votes.items():
                    if len(agree) < index.agreeing[k]:
                        continue
                    seq, t = index.sequences[k].tolist(), index.templates[k]
                    stand = lambda a, z: all(begin[d] <= start + i < begin[d + 1] and known.get(start + i) == seq[i] for i in range(a, z))  # noqa: B023, E731
                    if not any(stand(a, z) for a, z in t.keys):
                        continue
                    if k in base_of:
                        places[d].append(start - int(begin[d]))
                        base_labels[d].add(base_of[k])
                        score[d] = 1.0
                    else:
                        share = float(sum(m for i, m in enumerate(index.mass[k].tolist()) if stand(i, i + 1)) / index.mass[k].sum())
                        score[d] = max(score[d], share)
                        if share >= least:
                            labels[d].add(t.label)
            for d in range(last - first):
                own = places.get(d, [])
                rows.append((ids[first + d], int(n_words[d]), len(own), min(own, default=None), max(own, default=None), ",".join(sorted(base_labels.get(d, ()))), ",".join(sorted(base_labels.get(d, set()) | labels.get(d, set()))), min(1.0, round(score.get(d, 0.0), 6))))
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), _RESULT)] if rows else [pa.array([], f.type) for f in _RESULT], schema=_RESULT)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of `docs`."""
    rows = common.base_columns(docs, key, text)
    phrases = tuple(template(label, phrase) for phrase, label in base)
    everything = (*phrases, *templates)
    weights = word_weights(rows, sorted({w for t in everything for w in t.words}))
    labels = [(k, label) for k, (_, label) in enumerate(base)]
    return rows.mapInArrow(lambda b: _scan(b, Index(everything, weights), labels, least), RESULT)

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from locspark.llm.suffix_dedup import dedup_documents, suffix_dedup, suffix_order


def removed(texts, length):
    places = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            places[t[i : i + length]].append((d, i))
    gone = [np.zeros(len(t), bool) for t in raw]
    for x in places.values():
        if len(x) > 1:
            for d, i in x:
                gone[d][i : i + length] = True
    return gone


def brute(texts, length):
    out = []
    for t, g in zip([(t or "").encode() for t in texts], removed(texts, length)):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((len(t), int(g.sum()), int((np.diff(np.concatenate(([0], g.astype(int)))) > 0).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé \n\0") for _ in range(n))
    shared = [word(70), word(40), word(33), "a" * 90]
    texts = [None, "", "x", word(29), "ab" * 200, "a" * 300]
    for _ in range(60):
        parts = [word(r.randint(0, 60)) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared)[r.randint(0, 9) :])
        texts.append("".join(parts))
    texts += [texts[10], texts[11] + "!", texts[12], texts[12]]
    return texts


@pytest.mark.parametrize("hot,block", [(100_000, 600), (3, 600), (1, 600), (100_000, 1 << 20)])
def test_against_brute_force(spark, hot, block):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(suffix_dedup(df, min_bytes=30, hot_anchor=hot, block_bytes=block).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts, 30)


def test_windows_that_end_a_text_by_a_hot_anchor(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    once = [word(30) for _ in range(40)]
    texts = once + [word(25) + x + word(25) for x in once]  # one window of the anchor, and a run of several
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(suffix_dedup(df, min_bytes=30, hot_anchor=1, block_bytes=150).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts, 30)


def test_one_shared_window_and_a_text_that_is_just_it(spark):
    r = random.Random(9)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = [t for x in (word(30) for _ in range(100)) for t in (x, word(40) + x)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for hot in (1, 100_000):
        rows = sorted(suffix_dedup(df, min_bytes=30, hot_anchor=hot, block_bytes=200).collect())
        assert [r.n_removed >= 30 for r in rows] == [True] * len(texts) and [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == brute(texts, 30)


def test_suffix_order_is_a_suffix_array():
    r = random.Random(1)
    for alphabet in (b"ab", b"abcd", b"a"):
        raw = bytes(r.choice(alphabet) for _ in range(300))
        text = np.append(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, 0).astype(np.uint16)
        wanted = np.ones(301, bool)
        wanted[300] = False
        order = suffix_order(text, wanted, 301)
        assert order.tolist() == sorted(range(300), key=lambda i: raw[i:])


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(empty).collect() == []
    same = "w" * 150 + "".join(map(chr, range(200, 400)))
    df = spark.createDataFrame([(None, same, 1, "q"), (5, same, 2, "q"), (5, same, 2, "q"), (7, None, 3, None)], "doc_id long, text string, block int, bytes string")
    got = suffix_dedup(df).collect()
    assert len(got) == 4 and sum(r.n_removed == r.n_bytes > 0 for r in got) == 3
    out = dedup_documents(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, [Row(doc_id=i, text=t, block=b, bytes=q) for i, t, b, q in [(None, "", 1, "q"), (5, "", 2, "q"), (5, "", 2, "q"), (7, None, 3, None)]]))


def test_text_outside_the_passages_and_clashing_columns_stay(spark):
    passage = "é".join(f"passage {i}" for i in range(40))
    rows = [(1, "\ufffd one " + passage, "a", 1), (2, "two " + passage + " \ufffd", "b", 2), (3, "three \ufffd", "c", 3)]
    out = dedup_documents(spark.createDataFrame(rows, "doc_id long, text string, _id string, kept int"))
    texts = {r.doc_id: r.text for r in out.collect()}
    want = [bytes(b for b, g in zip(t.encode(), gone) if not g).decode("utf-8", "ignore") for (_, t, *_), gone in zip(rows, removed([t for _, t, *_ in rows], 200))]
    assert texts == {1: want[0], 2: want[1], 3: want[2]} and "\ufffd" in texts[1] and "\ufffd" in texts[2]
    assert sorted((r.doc_id, r._id, r.kept) for r in out.collect()) == [(1, "a", 1), (2, "b", 2), (3, "c", 3)]

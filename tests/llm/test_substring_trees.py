import hashlib
import random
import re

import numpy as np
import pytest

from locspark.llm.substring_trees import Subtrees, levels, substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window):
    docs = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    order = lambda i: (i is None, i or 0)
    least = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            least[g] = min(least.get(g, order(i)), order(i))
    out = []
    for i, w in docs:
        gone, own = [False] * len(w), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in own or order(i) > least[g]:
                gone[k : k + window] = [True] * window
            own.add(g)
        kept = b" ".join(x for x, go in zip(w, gone) if not go)
        spans = sum(go and not before for go, before in zip(gone, [False, *gone]))
        out.append((i, len(w), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, block string, n_words int")
    return sorted((tuple(r) for r in substring_dedup(df, keep_text=True, **options).collect()), key=str)


def corpus(seed, window, n=40):
    rng = random.Random(seed)
    share = [" ".join(rng.choice("abc") for _ in range(rng.randrange(window, 4 * window))) for _ in range(4)]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice("abcdefgh") + rng.choice(["", "é", "X"]) for _ in range(rng.randrange(0, 5 * window)))
        for _ in range(rng.randrange(3)):
            t += rng.choice([" ", "\n\t", " "]) + rng.choice(share)
        rows.append((i * 7 % 41, t))
    rows += [(3, rows[0][1]), (3, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (None, None), (50, ""), (51, " \r\n"), (52, "a " * 3000), (-4, share[0]), (53, "a b c d e f g h" * 400)]
    return rows


@pytest.mark.parametrize(("window", "prefix", "step", "group"), [(20, 8, 4, 1 << 18), (20, 8, 4, 1), (5, 2, 2, 3), (3, 8, 4, 2), (7, 3, 3, 1), (1, 1, 1, 1)])
def test_against_brute_force(spark, window, prefix, step, group):
    rows = corpus(window, window)
    assert found(spark, rows, window=window, prefix=prefix, step=step, group=group, block_bytes=3000) == brute(rows, window)


def test_one_block_and_no_rows(spark):
    rows = corpus(9, 20)
    assert found(spark, rows) == brute(rows, 20)
    assert found(spark, []) == []


def test_a_passage_in_every_document(spark):
    common = " ".join(f"w{k}" for k in range(30))
    rows = [(i, f"start{i} {common} end{i}") for i in range(300)]
    got = found(spark, rows, block_bytes=4000, group=10)
    assert got == brute(rows, 20) and sum(r[2] for r in got) == 299 * 30


def test_prefixes_and_subtrees():
    assert levels(20, 8, 4) == [8, 12, 16, 20] and levels(3, 8, 4) == [3] and levels(10, 8, 4) == [8, 10]
    trees = Subtrees([np.array([5, 1, 5, 5]), np.array([2, 2, 2, 3])])
    assert trees.least(np.array([9, 8, 7, 6])).tolist() == [7, 8, 7, 6]
    assert [len(set(n)) for n in trees.node] == [2, 3]

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from locspark.llm.lm_scoring import LEFT_A, LEFT_B, START, Automaton, Grams, is_held_out, score_texts

TEXTS = [None, "", " \n", "The cat sat on the mat", "the cat\tsat", "a b a b a", "É é the Cat", "x" * 5000, "the cat sat on the hat"] * 4


def model(rows, order):
    texts = {}
    grams, starts, tokens = [Counter() for _ in range(order + 1)], 0, 0
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        texts[i] = ["<s>", *words, "</s>"]
        if not is_held_out(i, 10):
            starts += 1
            tokens += len(words) + 1
            for n in range(1, order + 1):
                for k in range(n - 1, len(texts[i])):
                    grams[n][tuple(texts[i][k - n + 1 : k + 1])] += 1
    uni = grams[1]
    del uni[("<s>",)]
    known = len(uni)

    def p(history, w):
        if not history:
            return (uni[(w,)] + 0.1) / (tokens + 0.1 * (known + 1))
        low = p(history[1:], w)
        seen = starts if history == ("<s>",) else grams[len(history)][history]
        if not seen:
            return low
        rest = min(1, LEFT_A * seen**-LEFT_B)
        return (1 - rest) * grams[len(history) + 1][(*history, w)] / seen + rest * low

    return texts, uni, p, tokens


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_brute_force(spark, order):
    rows = list(enumerate(TEXTS))
    texts, uni, p, tokens = model(rows, order)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string")
    for r in score_texts(df, order=order, block_bytes=3000).collect():
        t = texts[r.doc_id]
        want = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), t[k])) for k in range(1, len(t)))
        base = sum(math.log10(p((), w)) for w in t[1:])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t) - 1, sum(uni[(w,)] > 0 for w in t[1:]), tokens, is_held_out(r.doc_id, 10))
        assert abs(r.score - want) < 1e-5 and abs(r.base_score - base) < 1e-5


def automaton(rows, order):
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t or "" for _, t in rows])})
    grams = Grams(table, order, 10)
    counts = grams.own
    words = grams.words()
    return grams, Automaton(grams, counts, int(counts[1][words].sum()), int((counts[1][words] > 0).sum()), (LEFT_A, LEFT_B))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_of_each_state_add_up(order):
    """Over all tokens of the corpus and one that isn't in training, read in any state."""
    held = next(i for i in range(10**6) if is_held_out(i, 10))
    grams, a = automaton([*enumerate(TEXTS), (held, "unseen")], order)
    words = np.flatnonzero(grams.words())
    seen = grams.own[1] > 0
    unseen = [t for t in words if not seen[t]]
    assert len(unseen) == 1
    states = [0, *np.unique(a.target), a.start]
    for s in states:
        weight, _ = a.step(np.full(len(words), s), words)
        assert abs((10**weight).sum() - 1) < 1e-9


@pytest.mark.parametrize("order,segment", [(2, 1024), (3, 1024), (3, 3), (4, 5)])
def test_arcs_and_failures(order, segment):
    """The automaton against a walk that looks for the longest known history of each token."""
    rows = list(enumerate(TEXTS))
    grams, a = automaton(rows, order)
    texts, uni, p, _ = model(rows, order)
    begins = np.flatnonzero(grams.tokens == START)
    weights = a.traverse(grams.at[1], begins, order, segment)
    seen = {n: set() for n in range(1, order + 1)}
    for i, t in texts.items():
        if not is_held_out(i, 10):
            for n in range(1, order + 1):
                seen[n] |= {tuple(t[k - n + 1 : k + 1]) for k in range(n - 1, len(t))}
    failures = 0
    for begin, t in zip(begins, texts.values()):
        for k in range(1, len(t)):
            history = tuple(t[max(0, k - order + 1) : k])
            assert abs(weights[begin + k] - math.log10(p(history, t[k]))) < 1e-9
            while history and history not in seen[len(history)]:  # the state is the longest known history
                history = history[1:]
            while history and (*history, t[k]) not in seen[len(history) + 1]:
                history, failures = history[1:], failures + 1
    if segment == 1024 > max(map(len, texts.values())):
        assert (a.taken, a.failed) == (sum(len(t) - 1 for t in texts.values()), failures)


def test_columns_of_any_name_and_null_ids(spark):
    rows = [(None, "a b", "q", 1), (None, "a b", "q", 1), (3, "a b c", None, 2)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string, block string, score int")).collect()
    assert len(got) == 3 and [r.held_out for r in sorted(got, key=lambda r: r.n_tokens)][:2] == [True, True]


def test_empty_table(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sums_of_any_size():
    """Two blocks with three billion each are answered six billion."""
    from locspark.llm import common

    keys = np.array([5, 9, 1 << 63], np.uint64)
    asked = [common.requests(keys, np.array([3 * 10**9, 1, 7], np.uint32), block, 1, 2) for block in (0, 1)]
    answer = {"block": [], "bucket": [], "kind": [], "answer": []}
    for bucket in (0, 1):
        table = common.joined(asked, common._REQUEST)
        found = common._answer(table.filter(pa.compute.equal(table["bucket"], bucket)))
        for c in answer:
            answer[c] += found[c].to_pylist()
    table = pa.table(answer)
    assert [common.answers(table.filter(pa.compute.equal(table["block"], b)), 1).tolist() for b in (0, 1)] == [[6 * 10**9, 2, 14]] * 2

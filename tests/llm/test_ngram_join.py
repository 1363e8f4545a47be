import random
import re

import pytest

from locspark.llm.components import components
from locspark.llm.ngram_join import ngram_join, one_of_each_group


def brute(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def corpus():
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["É", "The"]
    text = lambda n: [r.choice(words) for _ in range(n)]
    hot = text(40)
    out = [None, "", " \t\n", "one", "ONE", "one two three", "one two  three\n", "a b c d e"]
    for _ in range(12):
        base = text(r.randint(20, 90)) + (hot if r.random() < 0.5 else [])
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(r.choice([" ", "\n", "  "]).join(t) if r.random() < 0.9 else " ".join(t).upper())
    return [(7 * k + 3, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("part,block", [(3000, 1 << 20), (4, 2000)])
def test_against_brute_force(spark, part, block):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_shingles int")
    got = ngram_join(df, part=part, block_bytes=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edge_cases(spark):
    assert ngram_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None), (9, "A b c d e f")], "doc_id long, text string")
    assert sorted(str(tuple(r)) for r in ngram_join(df).collect()) == sorted(map(str, [(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None), (9, 2, 4)]))
    assert sorted((r.doc_id or 0) for r in one_of_each_group(df).collect()) == [0, 0, 4, 4]


def test_rows_of_a_repeated_id_are_judged_each(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "q r s t u v w"), (3, "h i j k l m n"), (3, "H i j k l m n"), (None, "o p o p q q o")]
    got = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == [(0, "o p o p q q o"), (1, "a b c d e f g"), (2, "q r s t u v w"), (3, "h i j k l m n")]


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5), (None, 3), (11, 11)]
    got = dict(components(spark.createDataFrame(links, "x long, y long")).collect())
    assert got == {2: 1, 3: 1, 5: 4, 6: 4, 7: 4, 8: 4, 9: 4}

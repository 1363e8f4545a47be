import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from locspark.llm.spelling import group_spellings, last_forms


def brute(rows, one_in=97, min_length=5, min_count=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, n_near = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        n_near[w] = len(others)
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], n_near[w], words.get(form[w])))
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in rows], "doc_id long, text string, word string, n int")
    got = group_spellings(df, **options)
    assert [t for _, t in got.dtypes] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in got.collect())


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÀé") for _ in range(rng.randrange(4, 8))) for _ in range(30)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = rng.choice(base[: rng.randrange(1, 31)])
            k = rng.randrange(len(w))
            w = rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abß") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.capitalize()]))
        rows.append((i, rng.choice([" ", "-", "1", "Ā"]).join(words)))
    return rows + [(None, rows[0][1]), (None, None), (7, ""), (7, rows[7][1]), (7, rows[7][1]), (99, "x" * 3000 + " " + ("ab" * 40 + " ") * 3 + ("ab" * 39 + "b ") * 7)]


@pytest.mark.parametrize(("seed", "one_in"), [(1, 97), (2, 3)])
def test_against_brute_force(spark, seed, one_in):
    rows = corpus(seed)
    want = brute(rows, one_in)
    assert found(spark, rows, one_in=one_in) == want and len(want) > 50 and any(w[1] for w in want)


def test_repeats_ties_and_double_letters(spark):
    rows = [(1, "letter letter letter leter leter leter lettter lettter lettter"), (2, "abcde abcde abcde abcdf abcdf abcdf abcdg abcdg abcdg bcdea bcdea bcdea"), (3, "letter " * 9)]
    got = {r[0]: r[1:] for r in found(spark, rows, one_in=1 << 40)}
    assert got["leter"] == ("letter", "letter", 3, 1, 12) and got["lettter"] == ("letter", "letter", 3, 1, 12) and got["letter"] == (None, "letter", 12, 2, None)
    assert got["abcde"][3] == 2 and got["bcdea"][3] == 0 and got["abcdf"] == (None, "abcdf", 3, 2, None)


def test_no_rows_and_long_words(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "1 2 3")]) == []
    a = "".join(np.random.default_rng(1).choice(list("abcdefgh"), 100_000))
    got = found(spark, [(1, f"{a} {a} {a} " + f"{a[:500]}z{a[501:]} " * 7)], one_in=1 << 40)
    assert [(r[3], r[4], r[5]) for r in got] in ([(3, 1, 7), (7, 1, None)], [(7, 1, None), (3, 1, 7)])


def test_chains_are_followed(spark):
    got = found(spark, [(1, "abcde " * 3 + "abcdf " * 6 + "abcgf " * 12)], one_in=1 << 40)
    assert [r[:3] for r in got] == [("abcde", "abcdf", "abcgf"), ("abcdf", "abcgf", "abcgf"), ("abcgf", None, "abcgf")]
    forms = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(100, 0)], "number long, form long")
    assert {r.root for r in last_forms(forms).collect()} == {0}

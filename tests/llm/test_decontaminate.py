import random

import numpy as np

from locspark.llm.decontaminate import _PLAIN, banded, find_benchmark, without_benchmark


def distance(piece, text):
    """Fewest edits between the piece and any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(piece):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(text):
    return _PLAIN[np.frombuffer((text or "").encode(), np.uint8)]


def test_alignment_within_the_band():
    r = random.Random(1)
    for _ in range(300):
        m, w = r.randint(1, 12), r.randint(1, 8)
        p, t = (np.array([[r.randrange(3) for _ in range(n)]], np.int16) for n in (m, m + w - 1))
        edits, left, right = banded(p, t, 20)
        # cell by cell, on the diagonals of the band alone
        row = [0] * w
        for i in range(m):
            swap = [row[j] + (p[0, i] != t[0, i + j]) for j in range(w)]
            new = []
            for j in range(w):
                new.append(min([swap[j]] + ([row[j + 1] + 1] if j + 1 < w else []) + ([new[j - 1] + 1] if j else [])))
            row = new
        assert edits[0] == min(row) >= distance(p[0].tolist(), t[0, left[0] : right[0]].tolist())


def occurs(item, text):
    """A short item as it is, without a letter or digit next to it."""
    letter = lambda b: b >= 128 or chr(b).isalnum()
    return any(text[i : i + len(item)] == item and not (i and letter(text[i - 1])) and not (i + len(item) < len(text) and letter(text[i + len(item)])) for i in range(len(text) - len(item) + 1))


def brute(docs, items):
    want = set()
    for d, t in docs:
        for i, b in items:
            p, x = plain(b), plain(t)
            if not len(p):
                continue
            if len(p) < 40:
                if occurs(p.tobytes(), x.tobytes()):
                    want.add((d, i))
                continue
            for a in {*range(0, max(1, len(p) - 99), 25), max(0, len(p) - 100)}:
                piece = p[a : a + 100]
                k = int(0.1 * len(piece))
                while k and len(piece) - 7 - k * 8 < 4:
                    k -= 1
                if distance(piece.tolist(), x.tolist()) <= k:
                    want.add((d, i))
    return want


def test_against_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("etaoinshé") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(15, 45))) for i in range(8)] + [(50, "short"), (51, None), (None, text(30)), (52, "a b"), (53, ""), (54, text(6))]
    docs = [(0, None), (1, ""), (2, "x"), (3, text(3000)), (200, "A\nb"), (201, "a short, one"), (202, "shorter"), (203, items[-1][1] + "!"), (204, items[10][1])]
    for i in range(4, 64):
        item = list(items[i % 8][1])
        for _ in range(r.randint(0, 20)):
            at = r.randrange(len(item))
            item[at] = r.choice(["", "z", item[at] + "q", item[at].upper()])
        part = "".join(item)
        part = part[r.randrange(40) :] if r.random() < 0.3 else part
        docs.append((i, text(r.randint(0, 20)) + " " + part.replace(" ", r.choice([" ", "\n"])) + " " + text(r.randint(0, 20))))
    want = brute(docs, items)
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in docs], "doc_id long, text string, item_id int, _id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 700):
        got = find_benchmark(df.limit(40) if block == 700 else df, bench, block_bytes=block).collect()
        assert {(x.doc_id, x.item_id) for x in got} == {w for w in want if block != 700 or w[0] in {d for d, _ in docs[:40]}} and all(x.edits <= 10 for x in got)
    assert len(want) > 20 and {(200, 52), (201, 50), (203, 54), (204, None)} <= want and (202, 50) not in want
    left = without_benchmark(df, bench)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_rows_of_a_null_or_repeated_id_are_judged_each(spark):
    item = " ".join(f"word{i * i}" for i in range(30))
    docs = [(i, t) for i in (None, 5) for t in ("clean é", "é said " + item, None)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, without_benchmark(df, bench).collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in docs if item not in (t or ""))
    assert find_benchmark(df, bench).columns == ["doc_id", "item_id", "first_byte", "last_byte", "edits", "n_pieces"]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, text string")
    assert find_benchmark(none, bench).collect() == [] == find_benchmark(docs, bench).collect()
    assert without_benchmark(docs, bench).count() == 2


def test_monotonous_texts_in_bounded_memory(monkeypatch):
    """Texts of one letter and rules of dashes, held against all alignments on small twins, and in bounded memory on large ones."""
    import tracemalloc

    from locspark.llm import decontaminate as module

    rule = [(i, b"item %d says %s " % (i, bytes([97 + i]) * 8) + b"-" * 80 + b" and ends with words %d" % (i * 7919)) for i in range(3)]
    cases = [(b"a" * 700, [(1, b"a" * 130)]), (b"text " + b"-" * 500 + b" more", rule), (b"ab" * 300 + b"-" * 200, [(1, b"ab" * 60), *rule]), (rule[1][1] * 2, rule)]
    for hits in (1 << 20, 5000):
        monkeypatch.setattr(module, "HITS", hits)
        monkeypatch.setattr(module, "STRETCH", max(hits // 4, 1000))
        for text, items in cases:
            p = plain(text.decode())
            found = module._gathered(module.Pieces.all_of(items, 100, 25, 40, 8, 0.1), p, np.array([0, len(p)]))
            assert {i for _, i in found} == {i for _, i in brute([(0, text.decode())], [(i, b.decode()) for i, b in items])}
    monkeypatch.undo()
    for text, items in ((b"a" * 1_000_000, [(1, b"a" * 400)]), (b"-" * 200_000, rule)):
        p = plain(text.decode())
        tracemalloc.start()
        found = module._gathered(module.Pieces.all_of(items, 100, 25, 40, 8, 0.1), p, np.array([0, len(p)]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 300e6 and bool(found) == (text[:1] == b"a")

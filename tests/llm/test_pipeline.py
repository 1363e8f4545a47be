"""Each stage of the pipeline against a plain version on its own input."""

from collections import Counter

import pytest
import sentencepiece

from corpus_pipeline import STAGES
from locspark.llm.common import written
from locspark.llm.quality_classifier import score_quality
from locspark.llm.queries import piece_model_path, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in STAGES:
        after = written(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_columns(steps):
    assert [name for name, _, _ in steps] == [name for name, _ in STAGES]
    assert all(after.columns == before.columns for _, before, after in steps[:-1])


def test_quality(spark, steps):
    _, before, after = steps[0]
    good = {r.doc_id for r in score_quality(before, table(spark, SF, "labels")).collect() if r.predicted}
    assert set(by_id(after)) == good and by_id(after) == {i: r for i, r in by_id(before).items() if i in good}


def test_one_of_each_group(steps):
    _, before, after = steps[1]
    rows, sets = by_id(before), {i: shingles(r.text) for i, r in by_id(before).items()}
    name = {i: i for i in rows}

    def find(i):
        return i if name[i] == i else find(name[i])

    for i in rows:
        for j in rows:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                name[b] = a
    assert by_id(after) == {i: r for i, r in rows.items() if find(i) == i}


def test_repeated_passages(steps):
    _, before, after = steps[2]
    count = Counter()
    raw = {i: r.text.encode() for i, r in by_id(before).items()}
    for t in raw.values():
        count.update(t[k : k + 200] for k in range(len(t) - 199))
    for i, r in by_id(after).items():
        gone = bytearray(len(raw[i]))
        for k in range(len(raw[i]) - 199):
            if count[raw[i][k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(raw[i], gone) if not g)
        assert r.text == kept.decode("utf-8", "ignore") and r.n_chars == len(r.text)
    assert len(by_id(after)) == len(raw)


def test_decontamination_and_encoding(spark, steps):
    _, before, after = steps[3]
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    left, rows = by_id(after), by_id(before)
    assert all(i not in left for i, r in rows.items() if any(x in r.text for x in items))
    words = {x.lower() for t in items for x in (t[k : k + 40] for k in range(len(t) - 39))}
    assert all(i in left for i, r in rows.items() if not any(r.text.lower()[k : k + 40] in words for k in range(len(r.text))))
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    _, before, after = steps[4]
    texts = by_id(before)
    assert {i: r.ids for i, r in by_id(after).items()} == {i: sp.encode(r.text) for i, r in texts.items()}

import math

import numpy as np
import pyarrow as pa

from locspark.llm import quality_classifier
from locspark.llm.quality_classifier import N_CLASSES, N_FEATURES, THRESHOLD, features, fit, good_documents, is_held_out, risk, score_quality, train

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in score_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if is_held_out(r.doc_id)}
    right = np.mean([got[i].predicted == q for i, q in truth.items()])
    good, bad = ([got[i].score for i, q in truth.items() if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    kept = np.mean([got[i].predicted for i, q in truth.items() if q])
    print("held out:", len(truth), "accuracy", right, "auc", auc, "good kept", kept)
    assert right > 0.95 and auc > 0.97 and kept > 0.98
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == is_held_out(r.doc_id) for r in got.values())


def test_risk_is_learned_without_negatives():
    r = np.random.default_rng(0)
    x = lambda n, at: np.concatenate([r.normal(at, 1, (n, 5)), np.zeros((n, N_FEATURES - 5))], 1)
    model = train(x(500, 1.0), np.concatenate([x(500, 1.0), x(500, -1.0)]), 0.5)
    assert (model.score(x(300, 1.0)) > 0.5).mean() > 0.9 and (model.score(x(300, -1.0)) < 0.5).mean() > 0.9


def test_risk_against_plain_sums():
    r = np.random.default_rng(1)
    xp, xu, w, b, prior = r.normal(1, 1, (7, 4)), r.normal(0, 1, (9, 4)), r.normal(0, 1, 4), 0.3, 0.4
    loss = lambda x, y, w, b: math.log1p(math.exp(-(2 * y - 1) * (sum(i * j for i, j in zip(x, w)) + b)))
    mean = lambda xs, y, w, b: sum(loss(x, y, w, b) for x in xs) / len(xs)
    plain = lambda w, b: (prior * mean(xp, 1, w, b), mean(xu, 0, w, b) - prior * mean(xp, 0, w, b))
    *values, g_positive, g_negative = risk(xp, xu, w, b, prior)
    assert np.allclose(values, plain(w, b))
    for k, grad in enumerate((g_positive, g_negative)):
        for i in range(5):
            d = np.eye(5)[i] * 1e-6
            assert abs((plain(w + d[:4], b + d[4])[k] - plain(w - d[:4], b - d[4])[k]) / 2e-6 - grad[i]) < 1e-6


def plain_features(text):
    raw = text.encode()
    kind = lambda c: 5 + (c | 32) - 97 if chr(c).isascii() and chr(c).isalpha() else 1 if 48 <= c < 58 else 2 if 9 <= c <= 13 else 3 if c == 32 else 4 if c > 127 else 31 if chr(c) in ".,;:!?'\"()-" else 0
    k, n = [kind(c) for c in raw], max(1, len(raw))
    out = [0.0] * N_CLASSES**2
    for a, b in zip(k, k[1:]):
        out[a * N_CLASSES + b] += 1
    words = raw.lower().split()
    m = max(1, len(words))
    share = lambda c: 3 * k.count(c) / n
    tail = [math.log1p(len(raw)) / 10, share(0), share(1), share(2), 3 * sum(65 <= c <= 90 for c in raw) / n, min(len(raw) / m, 40) / 20, len(set(words)) / m, math.log1p(m) / 8]
    return [math.sqrt(x / max(1, len(raw) - 1)) for x in out] + tail


def test_features_and_scores_against_plain_python(spark):
    texts = ["", "a", "Ab, ab AB\n12 é—x", "word " * 70_000, "{}<>\x00~", "the cat sat on the mat. " * 9, "x" * 300_000]
    got = np.concatenate(list(features(pa.array(texts))))
    assert np.allclose(got, [plain_features(t) for t in texts], atol=1e-6)
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 in (2, 5))) for i in range(21)], "doc_id long, quality int")
    model = fit(docs, labels)
    for row in score_quality(docs, labels).collect():
        z = sum((x - m) / s * w for x, m, s, w in zip(plain_features(texts[row.doc_id % 7]), model.mean, model.scale, model.weights)) + model.bias
        assert abs(row.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4 and row.predicted == (row.score >= THRESHOLD)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, 0.5), (1, "", 0.5), (2, "a b", 0.5), (2, "a b", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    assert good_documents(docs, none).collect() == docs.collect()
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 1)], "doc_id long, quality int")
    assert score_quality(docs, some).count() == 4
    assert score_quality(docs.limit(0), some).collect() == []


def test_the_prior_is_that_of_the_unlabelled_text(spark, monkeypatch):
    """Nine of ten labels say good, three of ten texts are."""
    r = np.random.default_rng(5)
    good = lambda: " ".join(r.choice(["the", "cat", "sat", "upon", "a", "mat", "while", "it", "rained"], 60))
    bad = lambda: " ".join(r.choice(["$$", "WIN", "xx7", "http", "!!", "0k", "the", "FREE"], 60))
    truth = [k % 10 < 3 for k in range(3000)]
    docs = spark.createDataFrame([(k, good() if g else bad()) for k, g in enumerate(truth)], "doc_id long, text string")
    labelled = [k for k in range(3000) if truth[k]][:600] + [k for k in range(3000) if not truth[k]][:66]
    labels = spark.createDataFrame([(k, int(truth[k])) for k in labelled], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_classifier, "estimated_prior", lambda n, g, other, f=quality_classifier.estimated_prior: seen.append((f(n, g, other), other)) or seen[-1][0])
    fit(docs, labels, sample=800)
    assert abs(seen[0][0] - 0.3) < 0.05 and seen[0][1] > 0.85
    assert quality_classifier.estimated_prior(np.array([70, 0, 30]), np.array([0, 0, 60]), 0.9) == 0.3 and quality_classifier.estimated_prior(np.array([1, 1]), np.array([0, 1]), 0.7) == 0.7


def test_repeated_ids_with_different_texts_give_one_model(spark):
    rows = [(k % 40, f"text {k} " * (k % 7 + 1)) for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    models = [fit(spark.createDataFrame(own, "doc_id long, text string").repartition(n), labels) for own, n in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].bias == models[1].bias

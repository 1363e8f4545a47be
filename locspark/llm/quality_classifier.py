"""Quality scores from positive and unlabelled texts.

A logistic model over byte-class statistics of whole texts is trained on trusted positives and unlabelled web text by
the non-negative risk

    R = prior R+(positives, 1) + max(0, R(unlabelled, 0) - prior R+(positives, 0))

whose second part, the risk on negatives, is estimated without any. Where it falls below zero a step goes against its
gradient, which keeps the model from fitting the positives by heart.

The class prior of the unlabelled text is estimated from it: labels may be of good texts more often than the web is good. A
first model, from one half of the ids, scores all rows of the other half; whatever share P of the positives and U of the
unlabelled rows lie over a score, no more than U / P can be the prior, and over high scores, where hardly a bad text
lies, it is about that. The prior is the least of these ratios over the scores that at least `LEAST_SHARE` of the positives
reach, from bins that Spark adds up over all rows. With fewer than `LEAST_POSITIVES` in that half the share of good labels stands in.

Training takes at most `sample` rows of either kind, those with the smallest hash of their id (of a repeated id the text
with the smallest hash); all else covers all rows. Columns of whatever other name are left out. Texts of any length are
read whole.

Rows whose crc32(doc_id as text) mod `folds` is 0 (and those with a null id) give neither labels nor unlabelled text.
Scores depend on the text alone. Null texts count as empty. Repeated rows are scored each. Without any positive, or any
unlabelled text, all scores are the prior (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locspark.llm import common

#: Most training rows of either kind.
SAMPLE = 4000
THRESHOLD = 0.3
#: Bins of scores, and what the estimate of the prior asks for.
BINS, LEAST_SHARE, LEAST_POSITIVES = 1000, 0.2, 30
FOLDS = 5

# byte classes: letters one by one (cases alike), other bytes by kind
_CLASS = np.zeros(256, np.int64)
for _i in range(26):
    _CLASS[[65 + _i, 97 + _i]] = 5 + _i
_CLASS[48:58] = 1
_CLASS[[9, 10, 11, 12, 13]] = 2
_CLASS[32] = 3
_CLASS[128:] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 31
N_CLASSES = 32
N_FEATURES = N_CLASSES * N_CLASSES + 8


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Square roots of the shares of byte-class pairs, and eight figures on words, lines and case; texts in pieces."""
    data, offsets = common.text_buffer(texts)
    for first, last, raw, at in common.pieces(data, offsets):
        n = last - first
        out = np.zeros((n, N_FEATURES), np.float32)
        kind = _CLASS[raw]
        size = np.diff(at)
        doc = np.repeat(np.arange(n), size)
        if len(raw) > 1:
            pair = kind[:-1] * N_CLASSES + kind[1:]
            same = doc[:-1] == doc[1:]
            for a in range(0, n, 256):  # a few texts at a time keep the table of counts small
                z = min(n, a + 256)
                lo, hi = int(at[a]), max(int(at[a]), int(at[z]) - 1)
                use = same[lo:hi]
                count = np.bincount((doc[lo:hi] - a)[use] * N_CLASSES**2 + pair[lo:hi][use], minlength=(z - a) * N_CLASSES**2)
                out[a:z, : N_CLASSES**2] = np.sqrt(count.reshape(z - a, -1) / np.maximum(size[a:z, None] - 1, 1))
        total = np.maximum(size, 1)
        per = lambda mask: np.bincount(doc, mask, n) / total
        words, word_doc = common.word_hashes(raw, at)
        n_words = np.maximum(np.bincount(word_doc, minlength=n), 1)
        order = np.lexsort((words, word_doc))
        new = np.ones(len(order), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (word_doc[order][1:] != word_doc[order][:-1])
        distinct = np.bincount(word_doc[order][new], minlength=n)
        upper = (raw >= 65) & (raw <= 90)
        out[:, -8:] = np.stack([np.log1p(size) / 10, per(kind == 0) * 3, per(kind == 1) * 3, per(kind == 2) * 3, per(upper) * 3, np.minimum(size / n_words, 40) / 20, distinct / n_words, np.log1p(n_words) / 8], 1)
        yield out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(xp: np.ndarray, xu: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risk on positives (with the prior), risk on negatives, and the gradients of both by (w, b), of the logistic loss."""
    zp, zu = xp @ w + b, xu @ w + b
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda x, g: np.append(x.T @ g.astype(x.dtype), g.sum()).astype(np.float64)
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_positive = -prior * grad(xp, sigmoid(-zp) / len(zp))
    g_negative = grad(xu, sigmoid(zu) / len(zu)) - prior * grad(xp, sigmoid(zp) / len(zp))
    return float(positive), float(negative), g_positive, g_negative


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Minimises the non-negative risk of a logistic model with Adam, over all rows in each step. The tables are standardised in place."""
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(N_FEATURES), float(np.log(p / (1 - p))), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    mean = unlabelled.mean(0, dtype=np.float64)
    scale = np.maximum(unlabelled.std(0, dtype=np.float64), 1e-3) * np.sqrt(N_FEATURES / 30)
    for x in (positive, unlabelled):
        x -= mean.astype(x.dtype)
        x /= scale.astype(x.dtype)
    w, b = np.zeros(positive.shape[1]), float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        _, negative, g_positive, g_negative = risk(positive, unlabelled, w.astype(positive.dtype), b, prior)
        g = g_positive + g_negative if negative >= 0 else -g_negative
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return Model(w, b, mean, scale)


def is_held_out(doc_id: int | None, folds: int = FOLDS) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def _in_training(folds: int):
    return F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != 0)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for x in features(batch.column(1)):
            kinds = batch.column(2).slice(at, len(x))
            at += len(x)
            yield pa.record_batch([kinds, pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], names=["positive", "x"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS) -> Model:
    """The model of `docs` with the given labels (1: good). Labels of repeated ids: 1 only if all are."""
    rows = common.base_columns(docs, key, text)
    marked = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label is not null").groupBy("doc_id").agg(F.min("label").alias("label")).filter(_in_training(folds))
    n, good = marked.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("label") == 1, 1)), F.lit(0))).first()
    own, positives = rows.filter(_in_training(folds)), marked.filter("label = 1").select("doc_id")
    if good and n:
        half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
        first = train(*_sampled(own.filter(half == 0), positives.filter(half == 0), sample // 2), 0.5)
        prior = estimated_prior(*_binned(own.filter(half == 1), positives, first), good / n)
    else:
        prior = good / n if n else 0.5
    return train(*_sampled(own, positives, sample), prior)


def _sampled(rows: DataFrame, positives: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of at most `sample` positives and as many unlabelled rows."""
    first = lambda df: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the texts of the sample: its ids are at most 2 * sample rows, a proven bound
    chosen = first(positives).withColumn("positive", F.lit(True)).union(first(rows).withColumn("positive", F.lit(False)))
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in sorted(texts.select("doc_id", "text", "positive").mapInArrow(_featured, "positive boolean, x binary").toLocalIterator(), key=lambda r: bytes(r.x)):
        got[r.positive].append(np.frombuffer(bytes(r.x), np.float32))
    positive, unlabelled = (np.stack(x) if x else np.zeros((0, N_FEATURES), np.float32) for x in (got[True], got[False]))
    return positive, unlabelled


def _bins(batches: Iterator[pa.RecordBatch], shipped) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [shipped.value.score(x) for x in features(batch.column(1))]
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.record_batch([batch.column(0), pa.array(np.minimum(score * BINS, BINS - 1).astype(np.int32))], names=["doc_id", "bin"])


def _binned(rows: DataFrame, positives: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """How many of the rows, and of the positives among them, have their score in each bin."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(lambda b: _bins(b, shipped), "doc_id long, bin int").join(positives.withColumn("good", F.lit(1)), "doc_id", "left")
    n, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for r in scored.groupBy("bin").agg(F.count("*").alias("n"), F.count("good").alias("good")).collect():  # at most BINS rows
        n[r.bin], good[r.bin] = r.n, r.good
    return n, good


def estimated_prior(n: np.ndarray, good: np.ndarray, otherwise: float) -> float:
    """The least U / P over scores that enough positives reach; n, good: all rows and positives by score, rising."""
    if good.sum() < LEAST_POSITIVES:
        return otherwise
    u, p = np.cumsum(n[::-1]) / n.sum(), np.cumsum(good[::-1]) / good.sum()
    return float(np.clip((u / np.maximum(p, 1e-9))[p >= LEAST_SHARE].min(), 0.01, 0.99))


RESULT = "doc_id long, held_out boolean, score double, predicted int"
_RESULT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _scored(batches: Iterator[pa.RecordBatch], shipped, threshold: float, folds: int) -> Iterator[pa.RecordBatch]:
    model = shipped.value
    for batch in batches:
        at, ids = 0, batch.column(0).to_pylist()
        for x in features(batch.column(1)):
            own = ids[at : at + len(x)]
            at += len(x)
            score = model.score(x)
            yield pa.record_batch([pa.array(own, pa.int64()), pa.array([is_held_out(i, folds) for i in own], pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], schema=_RESULT)


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of `docs`."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, sample, folds))
    return common.base_columns(docs, key, text).mapInArrow(lambda b: _scored(b, shipped, threshold, folds), RESULT)


def _kept(batches: Iterator[pa.RecordBatch], shipped, at: int, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(at).fill_null("")
        keep = [shipped.value.score(x) >= threshold for x in features(texts)]
        yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))
        common.give_back()


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE, folds: int = FOLDS) -> DataFrame:
    """The rows of `docs` that score `threshold` or more, as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, sample, folds))
    at = docs.columns.index(text)
    common.small_batches(docs.sparkSession)
    return docs.mapInArrow(lambda b: _kept(b, shipped, at, threshold), docs.schema)

"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are its words and their first 4, 5 and 6 bytes, hashed, with their counts. One weight
vector serves all thresholds: P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1, and the expected severity is
the sum of these. Only features that labelled toxic documents have clearly more often than others enter the fit, so
the thousands of ordinary words of a long text weigh nothing.

The labels say toxic or not. Toxic documents are graded 1 or 2 by how much evidence (log ratios of the entering
features, summed) they hold, below or above the median; the fit takes any integer grades. So with labels of two values
the second grade and the expected severity order documents by amount of evidence and are no judgement of people's; the
decision rests on the first threshold, which the labels fix. Labels with more values would make the grades theirs.

The model is fitted on the driver from at most `most` toxic and `most` other labelled documents, those with
the smallest hashed doc_id, by their hashed features; clean ones weigh as many as they stand for. Every fifth
is held out to choose the decision threshold. Scoring reads every text whole and shuffles nothing.

Defined cases: a null or wordless text has severity of a text without features and is clean; labels that are
null or of unknown documents are ignored, a document labelled twice counts as toxic if either says so;
without labelled toxic documents everything has grade 0; of documents that share a labelled doc_id the fit takes the
one with the smallest text key; repeated rows get equal scores; a very long text counts each feature REPEATS times at
most; further columns are kept where rows are filtered; empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, byte_class, give_back, mix, span_hashes, table, text_key, word_spans

#: Bound of either class in the training sample, hashed dimensions, and byte lengths of word beginnings.
MOST, DIMENSIONS, BEGINNINGS = 3000, 1 << 20, (4, 5, 6)
#: Most times a feature counts in a document, in the fit and at scoring.
REPEATS = 8
#: Features entering the fit, documents that must hold one, errors by which its ratio must differ from 1, the least ratio,
#: quadratic penalty in documents, steps.
ENTERING, SUPPORT, SURE, RATIO, PENALTY, STEPS = 4096, 3, 2.5, 20.0, 0.1, 300

_LETTERS = [b for b in range(256) if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80]
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))
_INSIDE = byte_class(b" ")


def features(text: bytes) -> list[np.ndarray]:
    """For each word its hashed features: the word, and its beginnings where it is longer."""
    data = np.frombuffer(text.translate(_FOLD), dtype=np.uint8)
    starts, ends = word_spans(data, _INSIDE)
    out = [span_hashes(data, starts, ends)]
    for k in BEGINNINGS:
        long = starts[ends - starts > k]
        out.append(mix(span_hashes(data, long, long + k) + np.uint64(k)))
    return [(h >> np.uint64(44)).astype(np.int32) for h in out]


@dataclass
class Model:
    """Weights by hashed feature, thresholds in ascending order, and the chance of grade > 0 that rejects."""

    weights: np.ndarray
    thresholds: np.ndarray
    limit: float

    def linear(self, text: bytes) -> float:
        found = np.concatenate(features(text))
        ids, counts = np.unique(found[self.weights[found] != 0], return_counts=True)
        return float((self.weights[ids].astype(np.float64) * np.minimum(counts, REPEATS)).sum())

    def chances(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each threshold."""
        return _sigmoid(linear[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray, width: int, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model with a quadratic penalty, by limited-memory BFGS.

    The thresholds are the first one and the logarithms of the gaps after it, so they stay in order.
    """
    n, top = len(grades), int(grades.max())
    share = weight / weight.sum()
    below, above = grades > 0, grades < top

    def thresholds(x: np.ndarray) -> np.ndarray:
        return x[width] + np.concatenate([[0.0], np.cumsum(np.exp(x[width + 1 :]))])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, t = x[:width], thresholds(x)
        z = np.bincount(rows, weights=values * w[columns], minlength=n)
        low = np.where(below, _sigmoid(z - t[np.maximum(grades, 1) - 1]), 1.0)  # P(at least its grade)
        high = np.where(above, _sigmoid(z - t[np.minimum(grades, top - 1)]), 0.0)  # P(more than its grade)
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = share * low * (1 - low) / p, share * high * (1 - high) / p
        grad_t = np.array([d_low[grades == k + 1].sum() - d_high[grades == k].sum() for k in range(top)])
        tails = np.cumsum(grad_t[::-1])[::-1]
        grad = np.bincount(columns, weights=values * (d_high - d_low)[rows], minlength=width) + penalty / n * w
        return -float((share * np.log(p)).sum()) + penalty / n / 2 * float(w @ w), np.concatenate([grad, tails[:1], np.exp(x[width + 1 :]) * tails[1:]])

    share_above = np.clip([share[grades > k].sum() for k in range(top)], 1e-6, 1 - 1e-6)
    x = np.concatenate([np.zeros(width), [np.log(1 / share_above[0] - 1)], np.zeros(top - 1)])
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, kept = -grad, []
        for s, y, r in reversed(past):
            kept.append(r * float(s @ way))
            way = way - kept[-1] * y
        if past:
            s, y, _ = past[-1]
            way = way * float(s @ y) / float(y @ y)
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            way = way + s * (a - r * float(y @ way))
        slope, size = float(grad @ way), 1.0 if past else 1.0 / max(1e-12, float(np.abs(grad).max()))
        while size > 1e-10:
            new_value, new_grad = loss(x + size * way)
            if new_value <= value + 1e-4 * size * slope:
                break
            size /= 2
        else:
            break
        s, y = size * way, new_grad - grad
        done = value - new_value < 1e-9 * max(1.0, abs(value))
        x, value, grad = x + s, new_value, new_grad
        if float(s @ y) > 1e-14:
            past = [*past[-9:], (s, y, 1.0 / float(s @ y))]
        if done:
            break
    return x[:width], thresholds(x)


def _count(batches):
    for batch in batches:
        ids, counts, words = [], [], []
        for text in batch.column("text"):
            got = features(text.as_py() or b"")
            values, n = np.unique(np.concatenate(got), return_counts=True)
            ids.append(values)
            counts.append(n.astype(np.int32))
            words.append(len(got[0]))
        yield pa.record_batch([batch.column("toxic"), pa.array(words, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["toxic", "words", "features", "counts"])


def _summed(places: np.ndarray, size: int, weights=None, piece: int = 1 << 18) -> np.ndarray:
    """What bincount gives, a piece at a time: it makes copies of 8 bytes of what it is given. `weights`: of a slice, whole numbers."""
    out = np.zeros(size, dtype=np.int64)
    for a in range(0, len(places), piece):
        at = slice(a, a + piece)
        out += np.bincount(places[at], weights=weights and weights(at), minlength=size).astype(np.int64)
    return out


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    arrow_batches(spark, 200)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.agg(*[F.count(F.when(x, 1)).alias(n) for n, x in (("toxic", F.col("toxic") > 0), ("other", F.col("toxic") <= 0))]).first()
    parts = [known.filter(F.col("toxic") > 0), known.filter(F.col("toxic") <= 0)]
    some = [p.select("doc_id", (F.col("toxic") > 0).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for p in parts]
    sample = F.broadcast(some[0].unionByName(some[1]))  # 2 * most rows at most
    met = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key().alias("key")).join(sample, "doc_id")
    # one document a label: neither the sample nor a worker grows with rows that share a doc_id
    found = met.groupBy("doc_id").agg(F.min(F.struct("key", "toxic", "text")).alias("x")).select("x.toxic", "x.text")
    model = fit(found.mapInArrow(_count, "toxic boolean, words long, features array<int>, counts array<int>").toArrow(), total["toxic"], total["other"])
    give_back()  # the driver's part of the sample
    return model


def fit(got: pa.Table, all_toxic: int, all_other: int) -> Model:
    """A model from sampled rows (toxic, words, features, counts), weighed up to the labels' numbers."""
    nothing = Model(np.zeros(DIMENSIONS, dtype=np.float32), np.array([40.0]), 0.5)
    toxic = got.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
    if not toxic.any() or toxic.all():
        return nothing
    lists = got.column("features").combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    rows = np.repeat(np.arange(len(toxic), dtype=np.int32), lengths)
    columns = lists.flatten().to_numpy()
    values = got.column("counts").combine_chunks().flatten().to_numpy()
    del got, lists
    # an order of the sample that does not hang on partitions
    order = np.argsort(_summed(rows, len(toxic), lambda at: columns[at].astype(np.float64) * values[at]), kind="stable")
    held = np.zeros(len(toxic), dtype=bool)
    held[order[::5]] = True
    fitted = ~held[rows]
    with_toxic = _summed(columns[fitted & toxic[rows]], DIMENSIONS)
    with_other = _summed(columns[fitted & ~toxic[rows]], DIMENSIONS)
    some = np.flatnonzero(with_toxic >= SUPPORT)  # what follows is made for these only
    with_toxic, with_other = with_toxic[some], with_other[some]
    n_toxic, n_other = max(1, int((toxic & ~held).sum())), max(1, int((~toxic & ~held).sum()))
    a, b = (with_toxic + 0.5) / (n_toxic + 1), (with_other + 0.5) / (n_other + 1)
    sure = np.log(a / b) / np.sqrt(1 / (with_toxic + 0.5) + 1 / (with_other + 0.5))  # of the log ratio, in its errors
    gain = np.where((sure >= SURE) & (a > RATIO * b), with_toxic * np.log(a / b), 0.0)
    best = np.argsort(-gain, kind="stable")[:ENTERING]
    best = best[gain[best] > 0]
    entering = some[best]
    if not len(entering):
        return nothing
    place = np.full(DIMENSIONS, -1, dtype=np.int32)
    place[entering] = np.arange(len(entering))
    kept = place[columns] >= 0
    rows, columns, values = rows[kept], place[columns[kept]], np.minimum(values[kept], REPEATS).astype(np.float64)
    evidence = np.bincount(rows, weights=values * np.log(a / b)[best][columns], minlength=len(toxic))
    grades = np.where(toxic, 1 + (evidence > np.median(evidence[toxic])), 0)
    weight = np.where(toxic, max(1, all_toxic) / int(toxic.sum()), max(1, all_other) / int((~toxic).sum()))
    use = ~held[rows]
    number = np.cumsum(~held) - 1
    w, t = fit_ordinal(number[rows[use]], columns[use], values[use], grades[~held], weight[~held], len(entering))
    z = np.bincount(rows, weights=values * w[columns], minlength=len(toxic))
    chance = _sigmoid(z - t[0])
    weights = np.zeros(DIMENSIONS, dtype=np.float32)
    weights[entering] = w
    return Model(weights, t, _limit(chance[held], toxic[held], weight[held]))


def _limit(chance: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The chance that best parts toxic from other documents by F1, midway in the gap where it lies."""
    order = np.argsort(-chance, kind="stable")
    hit = np.cumsum((weight * toxic)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * toxic).sum() + 1e-12)
    if not len(f1) or f1.max() <= 0:
        return 0.5
    k = int(np.argmax(f1))
    following = chance[order[k + 1]] if k + 1 < len(order) else 0.0
    return float(np.clip((chance[order[k]] + following) / 2, 0.02, 0.98))


def _score(batches, model):
    for batch in batches:
        linear = np.array([model.value.linear(t.as_py() or b"") for t in batch.column("text")])
        p = model.value.chances(linear)
        toxic = p[:, 0] >= model.value.limit
        grade = np.where(toxic, np.maximum(1, (p >= 0.5).sum(axis=1)), 0)
        yield pa.record_batch([batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(grade.astype(np.int32)), pa.array(toxic)], names=["doc_id", "expected_severity", "toxic_chance", "grade", "toxic"])


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected severity, chance of any toxicity, grade and decision of every document."""
    arrow_batches(spark, 500)
    sent = spark.sparkContext.broadcast(model)  # DIMENSIONS weights
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(partial(_score, model=sent), "doc_id long, expected_severity double, toxic_chance double, grade int, toxic boolean")


def _keep(batches, model):
    for batch in batches:
        linear = np.array([model.value.linear((t.as_py() or "").encode()) for t in batch.column("text")])
        yield batch.filter(pa.array(model.value.chances(linear)[:, 0] < model.value.limit))
    give_back()


def clean(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model does not reject, with all their columns."""
    arrow_batches(spark, 500)
    return docs.mapInArrow(partial(_keep, model=spark.sparkContext.broadcast(model)), docs.schema)


def op6_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(spark, docs, train(spark, docs, table(spark, sf_dir, "labels")))

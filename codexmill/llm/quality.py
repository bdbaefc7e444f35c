"""Quality classifier: naive Bayes support vectors over byte n-gram indicators.

A text's features are the different hashed byte n-grams that occur in it, and the n-grams of its marks: for each
word but the first, whether it repeats the one before. Each indicator is scaled by
the log ratio of its smoothed counts in the two classes, texts are scaled to unit length, and a linear
model with hinge loss is fitted by dual coordinate descent. A logistic curve fitted on rows kept aside
turns the margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Lengths of n-grams of bytes and of marks, and how many buckets, powers of two, either kind has.
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 17
MARK_ORDERS, MARK_BUCKETS = (1, 2, 4, 8, 16), 1 << 12
FEATURES = BUCKETS + MARK_BUCKETS
#: At most so many labelled rows are learned from, those whose id has the smallest hash, and of these so many features.
SAMPLE_ROWS, SAMPLE_FEATURES = 10_000, 1 << 25
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12


def mark_grams(text: bytes) -> np.ndarray:
    """The different buckets of the n-grams of marks, above those of bytes."""
    words = text.split()
    marks = np.fromiter(map(bytes.__eq__, words, words[1:]), np.uint32, max(0, len(words) - 1))
    found = []
    for n in MARK_ORDERS:
        if len(marks) < n:
            break
        code = np.zeros(len(marks) - n + 1, np.uint32)
        if marks.any():
            for k in range(n):
                code = code << np.uint32(1) | marks[k : k + len(code)]
        # a one before the marks tells the lengths apart
        code = np.unique(code) | np.uint32(1 << n)
        found.append(code * np.uint32(2654435761) >> np.uint32(32 - (MARK_BUCKETS.bit_length() - 1)))
    return BUCKETS + np.unique(np.concatenate(found)).astype(np.int64) if found else np.zeros(0, np.int64)


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted different buckets of each text's n-grams of bytes and marks; none for an empty text."""
    sizes = np.array([len(x) for x in texts], np.int64)
    if not sizes.sum():
        return [np.zeros(0, np.int32)] * len(texts)
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    left = np.repeat(starts[1:], sizes) - np.arange(len(raw))  # bytes to the end of the own text
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * FEATURES
    keys, code = [], raw.copy()
    for k in range(1, max(ORDERS) + 1):
        if k > 1:
            code = code[:-1] << np.uint32(8) | raw[k - 1 :]
        if k in ORDERS and len(code):
            bucket = (code * np.uint32(2654435761) + np.uint32(k * 40503)) * np.uint32(2246822519) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
            keys.append((owner[: len(code)] + bucket)[left[: len(code)] >= k])
    keys += [i * FEATURES + mark_grams(x) for i, x in enumerate(texts)]
    # sort and difference rather than a hash set: one pass over contiguous memory
    merged = np.concatenate(keys)
    merged.sort()
    merged = merged[np.concatenate([[True], merged[1:] != merged[:-1]])]
    cuts = np.searchsorted(merged, np.arange(len(texts) + 1) * FEATURES)
    local = (merged % FEATURES).astype(np.int32)
    return [local[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass(frozen=True)
class Model:
    """Of a text with the features f: margin = sum(weights[f]) / |ratios[f]| + bias, score by the logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, features: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(features))
        for i, f in enumerate(features):
            out[i] = self.weights[f].sum() / np.sqrt(max(self.squares[f].sum(), 1e-12)) + self.bias
        return out

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features) + self.shift, -30, 30)))


def log_count_ratios(features: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of the smoothed counts p of class 1 and q of class 0."""
    counts = np.full((2, FEATURES), SMOOTHING)
    for f, y in zip(features, labels, strict=True):
        counts[int(y), f] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: np.ndarray, size: int, epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum(cost * hinge), the bias as one more constant feature of value 1."""
    w, bias = np.zeros(size), 0.0
    alpha, norm = np.zeros(len(rows)), np.array([(v * v).sum() + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            gradient = signs[i] * (w[f] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                w[f] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton's method on smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(features: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on four fifths of the rows, the logistic curve on the last fifth. Without both classes: the mean label everywhere."""
    flat = np.zeros(FEATURES, np.float32)
    if not len(labels) or labels.min() == labels.max():
        mean = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Model(flat, flat, 0.0, 0.0, float(np.log(mean / (1 - mean))))
    aside = np.arange(len(labels)) % 5 == 4
    if labels[~aside].min() == labels[~aside].max():
        aside[:] = False
    use = [f for f, x in zip(features, aside, strict=True) if not x]
    y = labels[~aside]
    ratios = log_count_ratios(use, y)
    rows = [(f, ratios[f] / max(np.linalg.norm(ratios[f]), 1e-6)) for f in use]
    share = np.array([(y == 0).mean(), (y == 1).mean()])
    cost = COST * 0.5 / share[y]
    w, bias = dual_coordinate_descent(rows, np.where(y == 1, 1.0, -1.0), cost, FEATURES)
    model = Model((w * ratios).astype(np.float32), (ratios**2).astype(np.float32), bias, 1.0, 0.0)
    kept = aside if aside.any() else ~aside
    slope, shift = platt(model.margins([f for f, x in zip(features, kept, strict=True) if x]), labels[kept])
    return Model(model.weights, model.squares, bias, slope, shift)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.text_slices(batch, "text"):
            found = indicators([x or b"" for x in part.column("text").to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], ["doc_id", "label", "features"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most `rows` labelled documents, those whose id has the smallest hash.

    Null labels, and labels other than 0 and 1, are left out; of repeated labels of one id the largest
    counts, of repeated documents the smallest text. The sample, bounded by `rows`, is broadcast to find its
    texts, and the driver gets the features only of the first documents that have SAMPLE_FEATURES together. Without
    labels every score is 0.5; with labels of one kind all scores lean to it alike.
    """
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = named.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    # a threshold on the hash leaves little more than the wanted rows, so that none of the tasks sorts many
    share = min(1.0, 1.2 * rows / max(1, chosen.count()))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    sample = chosen.where(drawn < int(share * (1 << 30)) + 1).orderBy(drawn, "doc_id").limit(rows)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    texts = source.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = common.scratch(texts.mapInArrow(common.resting(_features), "doc_id long, label int, features array<int>"), "features")
    upto = F.sum(F.size("features")).over(Window.orderBy(drawn, "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # of `rows` rows at most
    kept = found.select("doc_id", "features").withColumn("upto", upto).where(F.col("upto") <= SAMPLE_FEATURES).select("doc_id")
    table = found.join(F.broadcast(kept), "doc_id").toArrow().sort_by("doc_id")
    lists = [x.values.to_numpy(zero_copy_only=False) for x in table.column("features")]
    order = np.random.default_rng(1).permutation(table.num_rows)
    y = table.column("label").to_numpy().astype(np.int64)
    return train([lists[i] for i in order], y[order])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document; a null or empty text has the score of no features. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in common.text_slices(batch, "text", 1 << 20):
                found = indicators([x or b"" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(found))], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(common.resting(run), "doc_id long, score double")

"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

A lexicon of words and beginnings of words that toxic texts hold far more often than others is learned from labelled
rows. A text's features are densities of the lexicon, as written and with disguises undone, how near its hits are to
words of the second person, rates of capitals, punctuation and disguises, and its length. Trees are fitted to the
logistic loss with second-order leaves over binned features. Lexicon and trees are cross-fitted: a row's features come from a
lexicon of other rows, and the calibration from margins of trees that haven't seen the row.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: At most so many labelled rows are learned from, those whose id has the smallest hash, and of these so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 10_000, 256 << 20
FOLDS = 4
#: A lexicon has at most so many words, and so many beginnings of these lengths; each in so many toxic texts at least.
LEXICON, BEGINNINGS, SUPPORT = 4096, (4, 5, 6), 3
#: How many times more often toxic texts hold an entry, smoothed, and by how much in standard errors.
RATIO, SURE = 4.0, 3.0
TREES, DEPTH, BINS, RATE, LEAF_WEIGHT, RIDGE = 120, 3, 48, 0.1, 4.0, 1.0

# Words of the second person in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur du dich dir dein deine deinen deinem deiner deines ihr euch euer eure tu te toi ton ta tes tien vous votre vos "
    "tú ti contigo tuyo tuya usted ustedes vosotros os vuestro vuestra".split()
)
# Signs and digits that stand for letters.
DISGUISES = str.maketrans("0134578@$!|€+", "oieastbasilet")
_WORDS = re.compile(r"[^\W_]+")
#: A word with signs or digits inside, one letter three times in a row, and letters set apart.
_MIXED = re.compile(r"(?=[^\W\d_]*[\d@$!|€+*#_.\-])[^\W\d_][^\s,;:()\"']*[^\W\d_]|[\d@$!|€+]+[^\W\d_][^\s,;:()\"']*[^\W\d_]")
_STRETCHED = re.compile(r"([^\W\d_])\1\1+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){2,}[^\W\d_](?!\w)")
_SHOUTS = re.compile(r"[!?]{2,}")
_SIGNS, _CAPITALS = string.punctuation, string.ascii_uppercase.encode()

FEATURES = (
    "words", "word_hits", "word_density", "word_kinds", "word_weight", "start_hits", "start_density", "start_kinds", "start_weight", "disguised_hits", "disguised_density",
    "you_density", "nearness", "least_distance", "capitals", "capital_words", "signs", "exclamations", "questions", "shouts", "mixed", "stretched", "spaced", "digits", "repeats",
)


@dataclass(frozen=True)
class Lexicon:
    """The log ratios of words, and of beginnings of words."""

    words: dict[str, float]
    starts: dict[str, float]


def grams(text: str) -> set[str]:
    """The different words of a text, marked by a leading "=", and their beginnings."""
    words = set(_WORDS.findall(text.lower()))
    return {"=" + w for w in words} | {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}


def ratios(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log ratio of an entry's share of toxic and of clean texts, and the ratio in standard errors."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return ratio, ratio / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicon(entries: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Lexicon:
    """The surest entries of either kind, equally sure ones by name."""
    if not entries or not n_toxic or not n_clean:
        return Lexicon({}, {})
    ratio, sure = ratios(toxic, clean, n_toxic, n_clean)
    good = np.flatnonzero((toxic >= SUPPORT) & (ratio >= np.log(RATIO)) & (sure >= SURE))
    order = sorted(good.tolist(), key=lambda i: (-sure[i], entries[i]))
    words = [i for i in order if entries[i].startswith("=")][:LEXICON]
    starts = [i for i in order if not entries[i].startswith("=")][:LEXICON]
    return Lexicon({entries[i][1:]: float(ratio[i]) for i in words}, {entries[i]: float(ratio[i]) for i in starts})


@dataclass(frozen=True)
class Word:
    """What a word adds to a text's features: its ratios as a word and as a beginning, 0 if the lexicon lacks them."""

    own: float
    start: float
    you: bool
    number: bool
    stretched: bool
    disguised: bool


class Measure:
    """Features of texts by a lexicon; remembers what words are, up to a bound."""

    REMEMBERED = 200_000

    def __init__(self, entries: Lexicon) -> None:
        self.words, self.starts = entries.words, entries.starts
        self.known: dict[str, Word | None] = {}

    def _word(self, word: str) -> Word | None:
        """None if the word adds nothing."""
        start = max((self.starts.get(word[:n], 0.0) for n in BEGINNINGS if len(word) >= n), default=0.0)
        own = self.words.get(word, 0.0)
        stretched = _STRETCHED.search(word) is not None
        found = Word(own, start, word in SECOND_PERSON, word.isdigit(), stretched, stretched and not own and _STRETCHED.sub(r"\1", word) in self.words)
        return found if own or start or found.you or found.number or stretched else None

    def features(self, text: str) -> list[float]:
        lowered, raw = text.lower(), text.encode()
        words = _WORDS.findall(lowered)
        n = len(words)
        if not n:
            return [0.0] * FEATURES.index("least_distance") + [100.0] + [0.0] * (len(FEATURES) - FEATURES.index("least_distance") - 1)
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
        for word in set(words).difference(self.known):
            self.known[word] = self._word(word)
        told = [(i, v) for i, v in enumerate(map(self.known.__getitem__, words)) if v is not None]
        own = [(i, v.own) for i, v in told if v.own]
        start = [(i, v.start) for i, v in told if v.start]
        you = [i for i, v in told if v.you]
        stretched, disguised = sum(v.stretched for _, v in told), sum(v.disguised for _, v in told)
        mixed = [x for x in (x.strip(_SIGNS) for x in lowered.split() if not x.isalpha()) if x and not x.isalpha() and _MIXED.search(x)]
        for found in mixed:
            bare = "".join(_WORDS.findall(found.translate(DISGUISES)))
            disguised += bare in self.words and found not in self.words
        spaced = _SPACED.findall(lowered) if sum(map((1).__eq__, map(len, words))) > 2 else []
        for found in spaced:  # a word of one letter may stand before or behind
            bare = "".join(_WORDS.findall(found))
            disguised += bare in self.words or bare[1:] in self.words or bare[:-1] in self.words
        near, least = 0.0, 100.0
        if you and (own or start):
            places, at = np.array(you), np.array(sorted({i for i, _ in own} | {i for i, _ in start}))
            right = np.searchsorted(places, at)
            gaps = np.minimum(np.abs(places[np.minimum(right, len(places) - 1)] - at), np.abs(places[np.maximum(right - 1, 0)] - at))
            near, least = float((1 / (1 + gaps)).sum()), float(min(100, gaps.min()))
        size = len(raw)
        capitals = size - len(raw.translate(None, _CAPITALS))
        shouted = sum(w.isupper() and len(w) > 1 for w in _WORDS.findall(text)) if capitals * 4 > n else 0
        kinds = [len({words[i] for i, _ in x}) for x in (own, start)]
        return [
            np.log1p(n), np.log1p(len(own)), len(own) / n, kinds[0], sum(x for _, x in own) / n, np.log1p(len(start)), len(start) / n, kinds[1], sum(x for _, x in start) / n, np.log1p(disguised), disguised / n,
            len(you) / n, near, least, capitals / size, shouted / n, (size - len(raw.translate(None, _SIGNS.encode()))) / size, raw.count(b"!") / size, raw.count(b"?") / size,
            sum(1 for _ in _SHOUTS.finditer(text)) / n, len(mixed) / n, stretched / n, len(spaced) / n, sum(v.number for _, v in told) / n, sum(map(str.__eq__, words, words[1:])) / n,
        ]


@dataclass(frozen=True)
class Tree:
    """A complete tree: nodes in level order, a row goes right where its feature is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.leaves[node - (2**DEPTH - 1)]


def grow(bins: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, curvature: np.ndarray) -> Tree:
    """The tree that lowers the loss the most level by level; equally good splits by feature, then by threshold."""
    n_nodes = 2**DEPTH - 1
    feature, threshold = np.zeros(n_nodes, np.int64), np.full(n_nodes, np.inf)
    node = np.zeros(len(bins), np.int64)
    for level in range(DEPTH):
        first, width = 2**level - 1, 2**level
        best = np.full(width, 1e-9)
        chosen: list[tuple[int, int] | None] = [None] * width
        for f in range(bins.shape[1]):
            size = len(edges[f]) + 1
            if size < 2:
                continue
            key = (node - first) * size + bins[:, f]
            g = np.bincount(key, gradient, width * size).reshape(width, size).cumsum(1)
            h = np.bincount(key, curvature, width * size).reshape(width, size).cumsum(1)
            left_g, left_h, all_g, all_h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - all_g**2 / (all_h + RIDGE)
            gain[(left_h < LEAF_WEIGHT / 4) | (right_h < LEAF_WEIGHT / 4)] = 0
            at = gain.argmax(1)
            for w in range(width):
                if gain[w, at[w]] > best[w]:
                    best[w], chosen[w] = gain[w, at[w]], (f, int(at[w]))
        goes = np.zeros(len(bins), np.int64)
        for w, split in enumerate(chosen):
            if split:
                feature[first + w], threshold[first + w] = split[0], edges[split[0]][split[1]]
                mine = node == first + w
                goes[mine] = bins[mine, split[0]] > split[1]
        node = 2 * node + 1 + goes
    leaf = node - n_nodes
    g, h = np.bincount(leaf, gradient, 2**DEPTH), np.bincount(leaf, curvature, 2**DEPTH)
    return Tree(feature, threshold, -RATE * g / (h + RIDGE))


@dataclass(frozen=True)
class Forest:
    base: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.apply(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Trees fitted one after the other to what the sum so far leaves of the logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    margin, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(bins, edges, p - y, np.maximum(p * (1 - p), 1e-9))
        margin += tree.apply(x)
        grown.append(tree)
    return Forest(base, grown)


def isotonic(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the pools of adjacent violators, means smoothed by one half row of the whole mean."""
    order = np.argsort(margins, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, y in zip(margins[order].tolist(), labels[order].tolist(), strict=True):
        pools.append([float(y), 1.0, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    mean = (labels.sum() + 0.5) / (len(labels) + 1)
    at, value = np.array([m / n for _, n, m in pools]), np.array([(s + 0.5 * mean) / (n + 0.5) for s, n, _ in pools])
    return at, np.maximum.accumulate(value)


@dataclass(frozen=True)
class Model:
    """Scores are interpolated between the pools; a thousandth of the logistic curve keeps apart what lies in one pool."""

    lexicon: Lexicon
    forest: Forest
    at: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        margins = self.forest.margins(x)
        return 0.999 * np.interp(margins, self.at, self.value) + 0.001 / (1 + np.exp(-np.clip(margins, -30, 30)))


def constant(labels: np.ndarray) -> Model:
    """Without both classes: the smoothed mean label, 0.5 without any, whatever the text."""
    mean = (labels.sum() + 1) / (len(labels) + 2)
    return Model(Lexicon({}, {}), Forest(float(np.log(mean / (1 - mean))), []), np.zeros(1), np.array([mean]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry the toxic and clean texts of each fold that hold it, added up while a bounded table of entries lasts."""
    found: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        table = np.array(list(found.values()), np.int64).reshape(-1, 2 * FOLDS)
        out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.FixedSizeListArray.from_arrays(pa.array(table.reshape(-1)), 2 * FOLDS).cast(pa.list_(pa.int64()))], ["entry", "counts"])
        found.clear()
        return out

    for batch in batches:
        for text, label, fold in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True):
            for entry in grams(text or ""):
                if entry not in found:
                    found[entry] = np.zeros(2 * FOLDS, np.int64)
                found[entry][2 * fold + label] += 1
            if len(found) >= 200_000:
                yield flush()
    if found:
        yield flush()


def _chosen(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """The sample, written: doc_id, text, label, fold."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = named.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # a threshold on the hash leaves little more than the wanted rows
    share = min(1.0, 1.2 * rows / max(1, known.count()))
    sample = known.where(drawn < int(share * (1 << 30)) + 1).orderBy(drawn, "doc_id").limit(rows)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = source.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    found = common.scratch(texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")), "toxic-sample")
    # of `rows` rows at most
    kept = found.select("doc_id", F.octet_length("text").alias("size")).withColumn("upto", F.sum("size").over(Window.orderBy(drawn, "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    return found.join(F.broadcast(kept.where(F.coalesce("upto", F.lit(0)) <= SAMPLE_BYTES).select("doc_id")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most `rows` labelled documents, those whose id has the smallest hash, up to SAMPLE_BYTES of text.

    Null labels, and labels other than 0 and 1, are left out; of repeated labels of one id the largest counts, of repeated
    documents the smallest text. Entries are counted by Spark; the driver gets those in SUPPORT toxic texts that
    pass RATIO over all folds, and the features of the sample.
    """
    spark = docs.sparkSession
    sample = _chosen(docs, labels, label_col, rows, id_col, text_col)
    sizes = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    totals = np.array([[sizes.get((f, y), 0) for y in (0, 1)] for f in range(FOLDS)])
    if not totals[:, 0].sum() or not totals[:, 1].sum():
        return constant(np.repeat([0, 1], totals.sum(0)))
    counts = sample.select("text", "label", "fold").mapInArrow(common.resting(_counts), "entry string, counts array<long>")
    added = counts.groupBy("entry").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(2 * FOLDS)])
    toxic, clean = sum(F.col(f"c{2 * f + 1}") for f in range(FOLDS)), sum(F.col(f"c{2 * f}") for f in range(FOLDS))
    # a fold's lexicon may hold what all folds' lacks, but not by more than a fold's rows; half of the ratio bears that
    likely = (toxic >= SUPPORT) & ((toxic + 0.5) / int(totals[:, 1].sum() + 1) >= RATIO / 2 * (clean + 0.5) / int(totals[:, 0].sum() + 1))
    # at most 16 entries of either kind to each that a lexicon may have
    best = added.where(likely).orderBy(toxic.desc(), clean, "entry").limit(32 * LEXICON).toArrow()
    entries = best.column("entry").to_pylist()
    table = np.stack([best.column(f"c{i}").to_numpy() for i in range(2 * FOLDS)], 1).reshape(-1, FOLDS, 2) if entries else np.zeros((0, FOLDS, 2))

    def learned(folds: list[int]) -> Lexicon:
        part, rows = table[:, folds].sum(1), totals[folds].sum(0)
        return lexicon(entries, part[:, 1], part[:, 0], int(rows[1]), int(rows[0]))

    others = [learned([f for f in range(FOLDS) if f != k]) for k in range(FOLDS)]
    shared = spark.sparkContext.broadcast(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures = [Measure(x) for x in shared.value]
        for batch in batches:
            folds, texts = batch.column("fold").to_pylist(), batch.column("text").to_pylist()
            found = np.array([measures[f].features(t or "") for f, t in zip(folds, texts, strict=True)], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("fold"), pa.array(list(found), pa.list_(pa.float64()))], ["doc_id", "label", "fold", "x"])

    rows_of = sample.mapInArrow(common.resting(run), "doc_id long, label int, fold int, x array<double>").toArrow().sort_by("doc_id")
    x = np.stack(rows_of.column("x").to_numpy(zero_copy_only=False))
    return train(x, rows_of.column("label").to_numpy(), rows_of.column("fold").to_numpy(), learned(list(range(FOLDS))))


def train(x: np.ndarray, y: np.ndarray, folds: np.ndarray, entries: Lexicon) -> Model:
    """Trees over all rows, calibrated by the margins of each fold under trees of the others."""
    margins = np.zeros(len(y))
    for k in np.unique(folds):
        mine = folds == k
        margins[mine] = boost(x[~mine], y[~mine]).margins(x[mine]) if (~mine).any() else 0.0
    return Model(entries, boost(x, y), *isotonic(margins, y))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document; a null or empty text has the score of no words. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        measure = Measure(model.lexicon)
        for batch in batches:
            for part in common.text_slices(batch, "text"):
                x = np.array([measure.features(t or "") for t in part.column("text").to_pylist()]).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(common.resting(run), "doc_id long, score double")

"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword of +1 and -1 bits. For each bit a binary classifier weighs hashed byte
n-grams by the log ratio of their smoothed rates in the languages on either side. A text's bit margins
are compared with every codeword under the logistic loss; the nearest codeword wins, and a text whose
two nearest are close is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: n-gram lengths in bytes, and hash buckets, a power of two.
ORDERS, BUCKETS = (2, 3, 4), 1 << 16
SMOOTHING = 0.5
#: Overlapping n-grams repeat evidence: margins are divided by this, and held within ±MARGIN.
REPEAT, MARGIN = 3.0, 30.0
#: Below this score a prediction counts as ambiguous.
AMBIGUOUS = 0.9
#: The language of a text without letters.
UNDETERMINED = "und"

_TABLE = np.full(256, 32, np.uint8)
_TABLE[128:] = np.arange(128, 256)
_TABLE[97:123] = _TABLE[65:91] = np.arange(97, 123)
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_BREAK = b"    "


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of few languages, else a fixed random choice of about 10 log2 n splits."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 5:
        splits = [[1 if i == 0 or not k >> (i - 1) & 1 else -1 for i in range(n)] for k in range(1, 2 ** (n - 1))]
        return np.array(splits, np.int8).T
    rng = np.random.default_rng(n)
    while True:
        code = rng.choice(np.array([-1, 1], np.int8), (n, int(np.ceil(10 * np.log2(n)))))
        mixed = code[:, np.abs(code.sum(0, dtype=int)) < n]
        if len(np.unique(mixed, axis=0)) == n:
            return mixed


def grams(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket at each byte, and the (start, stop) of each text's bytes."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + len(_BREAK))[:-1]]).astype(np.int64)
    raw = _TABLE[np.frombuffer(b"".join(b" " + x + _BREAK for x in texts) + _BREAK, np.uint8)].astype(np.uint32)
    n = len(raw) - len(_BREAK)
    out, code = [], raw[:n]
    for k in range(1, max(ORDERS)):
        code = code << np.uint32(8) | raw[k : n + k]
        if k + 1 in ORDERS:
            out.append((code * np.uint32(2654435761) + np.uint32(k * 40503)) * np.uint32(2246822519) >> np.uint32(16))
    return out, np.stack([starts, starts + sizes], 1)


@dataclass(frozen=True)
class Model:
    """languages in order of their codewords, code (languages x bits), weights (buckets x bits)."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray

    def margins(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        if len(texts) and self.weights.shape[1]:
            each, spans = grams(texts)
            for buckets in each:
                for bit in range(total.shape[1]):
                    # one bit's column at a time keeps the gathered weights small
                    total[:, bit] += np.add.reduceat(self.weights[:, bit][buckets], spans.ravel())[::2]
        return np.clip(total / REPEAT, -MARGIN, MARGIN)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword of each row, ties to the first, and its share of exp(-loss)."""
        loss = np.zeros((len(margins), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0, -margins * word).sum(1)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        return loss.argmin(1), 1 / share.sum(1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in common.text_slices(batch, "text", 1 << 20):
            texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
            each, spans = grams(texts)
            names = sorted(set(langs))
            row = np.array([names.index(x) for x in langs], np.int64)
            size = spans[:, 1] - spans[:, 0]
            owner = np.repeat(row, size)
            at = np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(owner))
            for buckets in each:
                found = np.bincount(owner * BUCKETS + buckets[at], minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, x in zip(names, found, strict=True):
                    counts[name] = counts.get(name, 0) + x
    for name, x in counts.items():
        kept = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept)), pa.array(kept.astype(np.int32)), pa.array(x[kept].astype(np.int64))], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row with a text and a language; one shuffle of at most languages x buckets counts.

    What comes to the driver, and goes out with the tasks, is that bounded table. No rows: no languages.
    """
    rows = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counted = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(common.resting(_count), "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    rows_at = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[rows_at, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    rates = counts / np.maximum(counts.sum(1, keepdims=True), 1) * 1e6  # each language weighs the same
    code = codewords(len(languages))
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        sides = [np.log((x := rates[code[:, bit] == s].mean(0) + SMOOTHING) / x.sum()) for s in (1, -1)]
        weights[:, bit] = sides[0] - sides[1]
    blank = BUCKETS  # grams of blanks alone say nothing
    for buckets in grams([b"   "])[0]:
        weights[buckets[0] % blank] = 0
    return Model(languages, code, np.asfortranarray(weights))


def has_letter(text: bytes) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    if _LETTERS[np.frombuffer(text, np.uint8)].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, lang_pred, score (0 to 1), ambiguous boolean. No shuffle.

    A null text, one without letters, and any text if no language was learned, gives `und` with
    score 0, not ambiguous. Ties go to the first language in order. Repeated rows are each predicted.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in common.text_slices(batch, "text", 1 << 20):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                best, score = model.decode(model.margins(texts)) if model.languages else (np.zeros(len(texts), int), np.zeros(len(texts)))
                known = np.array([bool(model.languages) and has_letter(x) for x in texts], bool)
                names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(known & (score < AMBIGUOUS))], ["doc_id", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(common.resting(run), "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The rows whose text has a language, with all their columns. No shuffle.

    Null texts and those without a letter go. So do texts that the decoder flags as ambiguous, unless the language
    column bears out the nearest codeword, or names a language that wasn't learned: what two languages may be is none if nothing else says which. That column, if there is one, gets
    the prediction where it is null and stays as it is elsewhere. If no language was learned, nothing can be
    told apart or filled in, and the texts with letters stay. Rows decide each for itself, repeated ones too; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fills = lang_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        learned = set(model.languages)
        for batch in batches:
            for part in common.text_slices(batch, "__bytes", 1 << 20):
                texts = [x or b"" for x in part.column("__bytes").to_pylist()]
                known = np.array([has_letter(x) for x in texts], bool)
                rows = part.drop_columns(["__bytes"])
                if model.languages:
                    best, score = model.decode(model.margins(texts))
                    names = [model.languages[b] for b in best]
                    stated = rows.column(lang_col).to_pylist() if fills else [None] * len(names)
                    borne_out = np.array([a == b or a is not None and a not in learned for a, b in zip(stated, names, strict=True)], bool)
                    known &= borne_out | (score >= AMBIGUOUS)
                    if fills:
                        at = rows.schema.get_field_index(lang_col)
                        rows = rows.set_column(at, rows.schema.field(at), pc.coalesce(rows.column(at), pa.array(names, pa.string())))
                yield rows.filter(pa.array(known))

    return docs.withColumn("__bytes", F.col(text_col).cast("binary")).mapInArrow(common.resting(run), docs.schema)

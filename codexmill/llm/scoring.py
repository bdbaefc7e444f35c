"""Language-model scoring: context-tree weighting over bytes, beside a smoothed word model.

A text is coded as its bytes, A-Z lower-cased, and an end byte. Each byte is eight binary decisions; a
decision's node is found by the bits before it in the byte and by the 0 to DEPTH bytes before that. Every
node estimates its decision by Krichevsky and Trofimov's rule from its counts in the training texts, and
the weighting mixes the estimates of all depths by their posterior weights. The counts are gathered once
and then frozen, so texts are scored independently of each other.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of context of the deepest nodes.
DEPTH = 4
#: Nodes of a model that are in memory at once, on the driver and in a task; a larger model goes in slices of contexts.
SLICE_NODES = 6_000_000
#: Bytes of text that are scored at a time, and with a model in several slices, which each such run loads anew.
TEXT_BYTES, MORE_TEXT_BYTES = 2 << 20, 32 << 20
#: Words whose counts go to the tasks; the counts of others are joined.
FREQUENT = 400_000
#: Different words, or byte runs, that a task counts before it passes the counts on.
HELD_WORDS, HELD_RUNS = 500_000, 2_000_000
#: Stands before a text and after it; no UTF-8 text has this byte.
END = 0xFF

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_U = np.uint64


def run_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each coded byte the number that its context and it spell, and each text's (start, stop)."""
    gap = bytes([END]) * DEPTH
    raw = np.frombuffer(b"".join(gap + x.translate(_LOWER) + bytes([END]) for x in texts), np.uint8).astype(_U)
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    code = np.zeros(max(0, len(raw) - DEPTH), _U)
    for k in range(DEPTH + 1):
        code = code << _U(8) | raw[k : k + len(code)]
    # codes at the places of the gaps before a text are left out
    place = np.arange(starts[-1]) + np.repeat(np.arange(len(texts)) * DEPTH, sizes)
    return code[place], starts


# ---------------------------------------------------------------- counting


def _counted_runs(counts: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    codes, n = counts
    return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([a[0], b[0]])
    n = np.concatenate([a[1], b[1]])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (np.zeros(0, _U), np.zeros(0, np.int64))
    for batch in batches:
        for part in common.text_slices(batch, "text"):
            codes, _ = run_codes([x or b"" for x in part.column("text").to_pylist()])
            codes.sort()
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            held = _merge(held, (codes[first], np.diff(np.concatenate([first, [len(codes)]]))))
            if len(held[0]) > HELD_RUNS:
                yield _counted_runs(held)
                held = (held[0][:0], held[1][:0])
    yield _counted_runs(held)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for part in common.text_slices(batch, "text"):
            for text in part.column("text").to_pylist():
                counts.update((text or b"").translate(_LOWER).split())
                counts[b""] += 1  # the end
            if len(counts) > HELD_WORDS:
                yield out(counts)
                counts.clear()
    yield out(counts)


# ---------------------------------------------------------------- the tree


def _lgamma(z: Column) -> Column:
    """log of the gamma function for z >= 0.5: Stirling's series eight places up."""
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    y = z + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _estimates(nodes: DataFrame) -> DataFrame:
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    kt = _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - _lgamma(n0 + n1 + 1) - math.log(math.pi)
    return nodes.withColumn("own", kt).withColumn("one", (n1 + 0.5) / (n0 + n1 + 1))


def tree(runs: DataFrame) -> DataFrame:
    """depth, key, one: for each node the mixed probability of a 1 there when no deeper node is known.

    key is the context's bytes followed by 1 and the bits so far. Counts and weighted probabilities go up
    from the deepest nodes, each parent summing over its children; the mixture then comes down. Every level
    is written to the shared folder.
    """
    x = F.col("code").bitwiseAND(255)
    bits = F.array(*(F.struct(((F.shiftright("code", 8) * 256) + ((1 << i) + F.shiftright(x, 8 - i))).cast("long").alias("key"), F.shiftright(x, 7 - i).bitwiseAND(1).alias("bit")) for i in range(8)))
    leaf = runs.select(F.explode(bits).alias("b"), "n").groupBy("b.key").agg(F.sum(F.when(F.col("b.bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("b.bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
    leaf = _estimates(leaf).withColumn("weighted", F.col("own")).withColumn("beta", F.lit(1.0))
    levels = [common.scratch(leaf, f"depth-{DEPTH}")]
    for d in range(DEPTH - 1, -1, -1):
        parent = F.col("key").bitwiseAND((1 << 8 * (d + 1)) - 1)
        up = levels[0].groupBy(parent.alias("key")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        up = _estimates(up).withColumn("high", F.greatest("own", "below"))
        mixed = F.col("high") + F.log(F.exp(F.col("own") - F.col("high")) + F.exp(F.col("below") - F.col("high"))) - math.log(2)
        beta = 1 / (1 + F.exp(F.least(F.col("below") - F.col("own"), F.lit(700.0))))
        levels.insert(0, common.scratch(up.withColumn("weighted", mixed).withColumn("beta", beta).drop("high", "below"), f"depth-{d}"))
    out, above = None, None
    for d, level in enumerate(levels):
        if above is None:
            now = level.select("key", (F.col("beta") * F.col("one")).alias("sum"), (1 - F.col("beta")).alias("rest"))
        else:
            parent = level.withColumn("parent", F.col("key").bitwiseAND((1 << 8 * d) - 1))
            up = above.select(F.col("key").alias("parent"), F.col("sum").alias("s"), F.col("rest").alias("r"))
            now = parent.join(up, "parent").select("key", (F.col("s") + F.col("r") * F.col("beta") * F.col("one")).alias("sum"), (F.col("r") * (1 - F.col("beta"))).alias("rest"))
        above = common.scratch(now, f"mixed-{d}")
        part = above.select(F.lit(d).alias("depth"), "key", (F.col("sum") + F.col("rest") / 2).alias("one"))
        out = part if out is None else out.unionByName(part)
    return out


class Slice:
    """The nodes of some contexts, of all depths, and which two-byte contexts they are."""

    def __init__(self, table: pa.Table, contexts: np.ndarray):
        depth, key, one = (table.column(k).to_numpy() for k in ("depth", "key", "one"))
        self.contexts, self.levels = contexts, []
        for d in range(DEPTH + 1):
            at = np.flatnonzero(depth == d)
            at = at[np.argsort(key[at], kind="stable")]
            self.levels.append((key[at].astype(_U), one[at]))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """log2 of the probability of each code's last byte after its context."""
        out = np.zeros(len(codes))
        context, x = codes >> _U(8), codes & _U(255)
        for i in range(8):
            node = (x >> _U(8 - i)) + _U(1 << i)
            one, left = np.full(len(codes), 0.5), np.arange(len(codes))
            for d in range(DEPTH, -1, -1):
                keys, values = self.levels[d]
                if not len(left) or not len(keys):
                    continue
                wanted = (context[left] & _U((1 << 8 * d) - 1)) << _U(8) | node[left]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = keys[at] == wanted
                one[left[found]] = values[at[found]]
                left = left[~found]
            bit = (x >> _U(7 - i)) & _U(1)
            out += np.log2(np.where(bit == 1, one, 1 - one))
        return out


class _Known:
    """Remembers the code lengths that a task has worked out. Of a model in several slices one at a time is in memory."""

    def __init__(self, slices: list):
        self.slices, self.codes, self.values = slices, np.zeros(0, _U), np.zeros(0)

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        out, context = np.zeros(len(codes)), (codes >> _U(8)) & _U(0xFFFF)
        for shared in self.slices:
            model = shared.value
            ours = model.contexts[context]
            out[ours] = model.bits(codes[ours])
            if len(self.slices) > 1:
                del model, shared._value  # it is read from the worker's file again when it is needed
        return out

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """log2 probability of each text."""
        codes, starts = run_codes(texts)
        new = np.unique(codes)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, new), len(self.codes) - 1)
            new = new[self.codes[at] != new]
        if len(new):
            if len(self.codes) > HELD_RUNS:
                self.codes, self.values, new = self.codes[:0], self.values[:0], np.unique(codes)
            both = np.concatenate([self.codes, new])
            order = np.argsort(both, kind="stable")
            self.codes, self.values = both[order], np.concatenate([self.values, self._bits(new)])[order]
        each = self.values[np.searchsorted(self.codes, codes)]
        return np.add.reduceat(each, starts[:-1]) if len(texts) else np.zeros(0)


def _slices(nodes: DataFrame) -> Iterator[Slice]:
    total = nodes.count()
    count = max(1, -(-total // SLICE_NODES))
    contexts = np.arange(1 << 16)
    owner = (contexts * 2654435761 >> 7) % count
    context = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    number = F.pmod(F.shiftright(context * F.lit(2654435761), 7), F.lit(count))
    for k in range(count):
        yield Slice(nodes.where((F.col("depth") < 2) | (number == k)).toArrow(), owner == k)


class Model:
    """Word counts and the context tree of the training rows, in tables of the shared folder."""

    def __init__(self, docs: DataFrame, text_col: str = "text"):
        rows = docs.select(F.col(text_col).cast("binary").alias("text"))
        words = rows.mapInArrow(common.resting(_count_words), "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
        self.words = common.scratch(words.where("c > 0"), "words")
        self.total, self.different = (x or 0 for x in self.words.agg(F.sum("c"), F.count("*")).first())
        runs = rows.mapInArrow(common.resting(_count_runs), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        self.nodes = tree(runs)

    def frequent(self) -> tuple[int, dict[bytes, int]]:
        """The words counted at least 2 ** k times, for the smallest k that leaves at most FREQUENT; and that bound."""
        steps = self.words.groupBy(F.floor(F.log2("c")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
        least, held = 1 << 62, 0
        for k, n in sorted(((r.k, r.n) for r in steps), reverse=True):
            held += n
            if held > FREQUENT:
                break
            least = 1 << k
        table = self.words.where(F.col("c") >= least).toArrow()
        return least, dict(zip(table.column("token").to_pylist(), table.column("c").to_pylist(), strict=True))


_DOC = "rid long, doc_id long, n_bytes long, n_tokens long, n_known long, base double, bits double, token binary, n long"


def _score(known_words, slices: list, total: int, different: int):
    size = TEXT_BYTES if len(slices) == 1 else MORE_TEXT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tree_of = known_words.value, _Known(slices)
        logs = {w: math.log10((c + 0.5) / (total + 0.5 * (different + 1))) for w, c in words.items()}
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.text_slices(batch, "text", size):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                bits = tree_of.sums(texts)
                n_tokens, n_known, base, rare_rid, rare, rare_n = [], [], [], [], [], []
                for k, text in enumerate(texts):
                    found = text.translate(_LOWER).split()
                    found.append(b"")
                    values = list(map(logs.get, found))
                    if None in values:
                        other = Counter(w for w, v in zip(found, values, strict=True) if v is None)
                        rare_rid += [rid + k] * len(other)
                        rare += other.keys()
                        rare_n += other.values()
                        values = [v for v in values if v is not None]
                    n_tokens.append(len(found))
                    n_known.append(len(values))
                    base.append(math.fsum(values))
                n, m = len(texts), len(rare)
                columns = [
                    pa.array(np.arange(rid, rid + n)), part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(bits), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                ]
                names = [x.split()[0] for x in _DOC.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names)
                if m:
                    empty = [pa.nulls(m, pa.int64()) for _ in range(4)] + [pa.nulls(m, pa.float64()) for _ in range(2)]
                    yield pa.RecordBatch.from_arrays([pa.array(rare_rid, pa.int64()), *empty, pa.array(rare, pa.binary()), pa.array(rare_n, pa.int64())], names)
                rid += n

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    base_score is the word model's log10 probability of the text's words and its end, score the context
    tree's of its bytes and end; bits_per_byte divides the code length by the bytes and the end. A null or
    empty text has its end alone. Without training texts each bit costs one bit and no word is known.
    The texts are read once, whatever the model's size. Frequent words are scored where they stand; a rare word's count is joined to its uses, so neither a
    common word nor a large vocabulary meets in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    least, frequent = model.frequent()
    words = spark.sparkContext.broadcast(frequent)
    slices = [spark.sparkContext.broadcast(part) for part in _slices(model.nodes)]
    scored = common.scratch(rows.mapInArrow(common.resting(_score(words, slices, model.total, model.different)), _DOC), "scored")
    for shared in (words, *slices):
        shared.unpersist()
    rare = scored.where("token IS NOT NULL").select("rid", "token", "n")
    counts = model.words.where(F.col("c") < least)
    value = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / (model.total + 0.5 * (model.different + 1)))
    valued = rare.join(counts, "token", "left").groupBy("rid").agg(F.sum(value * F.col("n")).alias("rare"), F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"))
    out = scored.where("n_tokens IS NOT NULL").drop("token", "n").join(valued, "rid", "left")
    bits = F.col("bits")
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare", F.lit(0.0))).alias("base_score"), (bits * math.log10(2)).alias("score"), (-bits / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )

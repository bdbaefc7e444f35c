"""Benchmark decontamination by a distributed positional inverted index.

The index is split by document into segments. A segment's row for a term holds the term's positions in
it, delta-encoded; positions count words over the segment's documents, with a gap after each document,
so a phrase can't span two. A query phrase takes its terms from the rarest in the whole corpus on,
shifts their positions by their place in the phrase, and intersects until nothing is left. Test items
are handled in blocks of bounded size, each against all segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a window, and bytes of text and documents to a segment (a single longer document makes a longer one).
WINDOW, SEGMENT_BYTES, SEGMENT_DOCS = 13, 8 << 20, 1 << 16
#: Bytes of test text that are matched in one pass; more make more passes. Their windows take some hundred times as much.
BLOCK_BYTES = 512 << 10

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(_SEPARATORS + bytes(range(65, 91)), b" " * len(_SEPARATORS) + bytes(range(97, 123)))

INDEX_SCHEMA = "segment long, term binary, n long, postings binary, doc_id long, base long, h1 long, h2 long"


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, in order."""
    return text.translate(_TABLE).split()


class _Numbers(dict):
    """Numbers new keys in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Segment:
    def __init__(self, number: int):
        self.number, self.terms, self.ids, self.docs, self.length, self.bytes = number, _Numbers(), [], [], 0, 0

    def add(self, row: tuple, text: bytes) -> None:
        """row: the document's id and its text's hashes."""
        found = words(text)
        self.docs.append((row, self.length, len(found)))
        self.ids.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.length += len(found) + 1
        self.bytes += len(text)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """A row per term, then a row per document with a null term, n its words and base its first position."""
        names = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("postings", pa.binary()), ("doc_id", pa.int64()), ("base", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
        ids = np.concatenate(self.ids)
        bases = np.array([b for _, b, _ in self.docs], np.int64)
        sizes = np.array([n for _, _, n in self.docs], np.int64)
        positions = np.arange(len(ids)) + np.repeat(bases - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        order = np.argsort(ids, kind="stable")
        at = positions[order]
        counts = np.bincount(ids, minlength=len(self.terms))
        starts = np.concatenate([[0], np.cumsum(counts)])
        deltas = np.diff(at, prepend=0)
        deltas[starts[:-1]] = at[starts[:-1]]
        deltas = deltas.astype("<u4")
        terms = list(self.terms)
        for a in range(0, len(terms), 50_000):
            b = min(a + 50_000, len(terms))
            part = deltas[starts[a] : starts[b]]
            n = b - a
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), pa.array(terms[a:b], pa.binary()), pa.array(counts[a:b]), common.arrow_binary(part, starts[a : b + 1] - starts[a]), *(pa.nulls(n, pa.int64()) for _ in range(4))], schema=names)
        n = len(self.docs)
        own = [pa.array([row[k] for row, _, _ in self.docs], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number)), pa.nulls(n, pa.binary()), pa.array(sizes), pa.nulls(n, pa.binary()), own[0], pa.array(bases), own[1], own[2]], schema=names)


def _builder(most_bytes: int, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = _Segment(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for part in common.text_slices(batch, "text"):
                for *row, text in zip(*(part.column(k).to_pylist() for k in ("doc_id", "h1", "h2", "text")), strict=True):
                    text = text or b""
                    if segment.docs and (segment.bytes + len(text) > most_bytes or len(segment.docs) >= most_docs):
                        yield from segment.batches()
                        segment = _Segment(segment.number + 1)
                    segment.add(row, text)
        if segment.docs:
            yield from segment.batches()

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index of all words of all texts to the shared folder. No shuffle.

    Null and empty texts have a document row without words; repeated rows are indexed each.
    """
    h1, h2 = common.text_hashes(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).cast("binary").alias("text"))
    with common.batches_of(docs.sparkSession, common.SLICE_BYTES):
        return common.scratch(rows.mapInArrow(common.resting(_builder(SEGMENT_BYTES, SEGMENT_DOCS)), INDEX_SCHEMA), "positional-index")


def windows_of(found: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All runs of n words; a shorter text, if it has words, is one run."""
    if not found:
        return []
    return [tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))]


class Block:
    """The different windows of some items, each with its terms from the rarest on."""

    def __init__(self, items: list[tuple[str | None, bytes]], n: int):
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for w in windows_of(words(text), n):
                self.items.setdefault(w, set()).update([item] if item is not None else [])
        self.terms = sorted({t for w in self.items for t in w})

    def plan(self, frequency: dict[bytes, int]) -> None:
        """Order each window's places by the frequency of their terms; windows with an absent term can't occur."""
        self.windows = [(w, sorted(range(len(w)), key=lambda i: (frequency[w[i]], i)), sorted(self.items[w])) for w in self.items if all(t in frequency for t in w)]


def _among(values: np.ndarray, positions: np.ndarray) -> np.ndarray:
    at = np.searchsorted(positions, values)
    at[at == len(positions)] = 0
    return positions[at] == values


def phrase(window: tuple[bytes, ...], order: list[int], postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """The first positions of a phrase's occurrences; order: its places, rarest term first."""
    starts = postings[window[order[0]]] - order[0]
    for i in order[1:]:
        if not len(starts):
            break
        starts = starts[_among(starts + i, postings[window[i]])]
    return starts


def proximity(window: tuple[bytes, ...], order: list[int], postings: dict[bytes, np.ndarray], span: int, bases: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the shortest runs of at most `span` words of one document that hold every term, in any order.

    A term that the window has twice must occur twice.
    """
    rare = postings[window[order[0]]]
    merged = []
    for term in sorted(set(window)):
        at = postings[term]
        near = np.searchsorted(at, rare - span + 1), np.searchsorted(at, rare + span - 1, side="right")
        kept = np.unique(np.concatenate([np.arange(0), *(np.arange(a, b) for a, b in zip(*near, strict=True))]).astype(np.int64))
        merged += [(int(p), term) for p in at[kept]]
    merged.sort()
    need = {t: window.count(t) for t in set(window)}
    have, missing, left, out = dict.fromkeys(need, 0), len(window), 0, []
    owner = np.searchsorted(bases, [p for p, _ in merged], side="right") if merged else []
    for right, (p, term) in enumerate(merged):
        have[term] += 1
        missing -= have[term] <= need[term]
        while left < right and (owner[left] != owner[right] or p - merged[left][0] >= span):
            missing += have[merged[left][1]] <= need[merged[left][1]]
            have[merged[left][1]] -= 1
            left += 1
        while not missing and have[merged[left][1]] > need[merged[left][1]]:
            have[merged[left][1]] -= 1
            left += 1
        if not missing:
            out.append((merged[left][0], p + 1))
    return out


def _decode(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u4"), dtype=np.int64)


def _match(block: Block, slop: int, table: pa.Table) -> pa.Table:
    is_doc = pc.is_null(table.column("term"))
    docs = table.filter(is_doc).sort_by("base")
    bases = docs.column("base").to_numpy()
    rows = table.filter(pc.invert(is_doc))
    coded = dict(zip(rows.column("term").to_pylist(), rows.column("postings").to_pylist(), strict=True))
    postings: dict[bytes, np.ndarray] = {}
    firsts, ends, which = [], [], []
    for k, (window, order, _) in enumerate(block.windows):
        if not all(t in coded for t in window):
            continue
        for t in window:
            if t not in postings:
                postings[t] = _decode(coded[t])
        if slop:
            runs = np.array(proximity(window, order, postings, len(window) + slop, bases), np.int64).reshape(-1, 2)
            first, end = runs[:, 0], runs[:, 1]
        else:
            first = phrase(window, order, postings)
            end = first + len(window)
        if len(first):
            firsts.append(first)
            ends.append(end)
            which.append(np.full(len(first), k))
    out: dict[str, list] = {"segment": [], "base": [], "hits": [], "items": []}
    if firsts:
        first, end, window_of = map(np.concatenate, (firsts, ends, which))
        doc = np.searchsorted(bases, first, side="right") - 1
        order = np.lexsort((first, doc))
        cuts = np.flatnonzero(np.diff(doc[order], prepend=-1))
        for group in np.split(order, cuts[1:]):
            base = int(bases[doc[group[0]]])
            runs: list[list[int]] = []
            for a, b in zip(first[group], end[group], strict=True):
                if runs and a - base <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], int(b) - base)
                else:
                    runs.append([int(a) - base, int(b) - base])
            items = {x for k in np.unique(window_of[group]) for x in block.windows[k][2]}
            out["segment"].append(int(docs.column("segment")[0].as_py()))
            out["base"].append(base)
            out["hits"].append([{"first": a, "end": b} for a, b in runs])
            out["items"].append(sorted(items))
    return pa.table(out, schema=pa.schema([("segment", pa.int64()), ("base", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]))


def _matcher(shared, slop: int):
    def run(table: pa.Table) -> pa.Table:
        try:
            return _match(shared.value, slop, table)
        finally:
            common.give_back()

    return run


def _blocks(items: DataFrame, n: int) -> Iterator[Block]:
    """Test items in blocks of about BLOCK_BYTES, dealt by a hash; only one block is on the driver at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // BLOCK_BYTES) or 1
    for k in range(count):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k).toArrow()
        yield Block(list(zip(part.column("item").to_pylist(), part.column("text").to_pylist(), strict=True)), n)


def match(index: DataFrame, tests: DataFrame, n: int = WINDOW, slop: int = 0, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """A row per indexed document: doc_id, n_words, n_hit, items (array, sorted as strings), hits (array of first, end), h1, h2 (of its text).

    A hit is a word inside an occurrence of one of the tests' windows of n words: of the exact phrase,
    or with slop a run of at most n + slop words that holds all of the window's. Items with null text
    have no window; those with a null id hit, but aren't listed. Without tests nothing is hit.
    """
    items = tests.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text IS NOT NULL")
    spark, found = index.sparkSession, None
    for block in _blocks(items, n):
        if not block.terms:
            continue
        terms = spark.createDataFrame([(bytearray(t),) for t in block.terms], "term binary")
        held = index.join(F.broadcast(terms), "term", "left_semi")  # a block's terms are bounded by its bytes
        frequency = held.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        block.plan(dict(zip(frequency.column("term").to_pylist(), frequency.column("n").to_pylist(), strict=True)))
        if not block.windows:
            continue
        shared = spark.sparkContext.broadcast(block)
        rows = held.select("segment", "term", "postings", "base").unionByName(index.where("term IS NULL").select("segment", "term", "postings", "base"))
        matched = rows.groupBy("segment").applyInArrow(_matcher(shared, slop), "segment long, base long, hits array<struct<first: long, end: long>>, items array<string>")
        matched = common.scratch(matched, "matched")  # the plan doesn't grow with the blocks
        shared.unpersist()
        found = matched if found is None else found.unionByName(matched)
    docs = index.where("term IS NULL").select("segment", "base", "doc_id", "h1", "h2", F.col("n").alias("n_words"))
    if found is None:
        found = spark.createDataFrame([], "segment long, base long, hits array<struct<first: long, end: long>>, items array<string>")
    merged = found.groupBy("segment", "base").agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    length = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, h: F.struct(F.greatest(acc["end"], h["end"]).alias("end"), (acc["total"] + F.greatest(F.lit(0), h["end"] - F.greatest(acc["end"], h["first"]))).alias("total")),
    )["total"]
    joined = docs.join(merged.withColumn("n_hit", length), ["segment", "base"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "hits", "h1", "h2")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """Hit in at least one word and in at least a twentieth of them."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't contaminated, with all their columns; rows go by id and text, so that no other row's text decides."""
    found = match(build_index(docs, id_col, text_col), tests).where(contaminated())
    return common.by_row(docs, found, "left_anti", id_col, text_col)

"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to unit length and cut in halves; each half has its own codebook, and a pair of
codewords names a cell. A query visits cells in order of the summed distances to its halves, found with
a heap, until they hold a wanted number of vectors, and reranks what they hold by exact cosine. That number
is fitted by brute force: for some sample rows the true neighbours among all rows are found in one pass, and
so many vectors are visited that a wanted part of these neighbours is reached.

Index and queries meet by regions of neighbouring cells: each (region, part of its entries, part of its queries)
is one group of bounded size, so neither a crowded cell nor a crowd of queries grows a task, and the plan is the
same for any number of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: About so many rows, drawn by a hash of their id, are what the codebooks are fitted on; and so many of them are searched by brute force.
SAMPLE_ROWS, SAMPLE_QUERIES = 65_536, 128
#: There are about so many cells to a vector, until a half has the most codewords that the sample bears.
CELLS_A_ROW, MOST_CODEWORDS = 2, 2048
#: The part of the sample's true neighbours that is visited.
TARGET = 0.97
#: Index entries and queries of a group.
REGION_ROWS, QUERY_ROWS = 2048, 512


def codebook(rows: np.ndarray, size: int, steps: int = 10, seed: int = 0) -> np.ndarray:
    """Centroids of Lloyd's algorithm; empty ones stay where they were."""
    centres = rows[np.random.default_rng(seed).choice(len(rows), min(size, len(rows)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(rows, centres)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centres[used] = np.add.reduceat(rows[order], first, axis=0) / np.diff(np.append(first, len(rows)))[:, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms, out = (centres**2).sum(1), np.empty(len(rows), np.int64)
    for a in range(0, len(rows), 4096):
        out[a : a + 4096] = (norms - 2 * rows[a : a + 4096] @ centres.T).argmin(1)
    return out


def in_order(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> Iterator[int]:
    """The cells that hold something in order of first[i] + second[j]; cell (i, j) is i * len(second) + j."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, width = first[a].tolist(), second[b].tolist(), len(second)
    a, b = (a * width).tolist(), b.tolist()
    heap = [(da[0] + db[0], 0, 0)]
    while heap:
        _, i, j = heap[0]
        # (i, j) is reached once: along the second list, and from its start along the first
        if j + 1 < width:
            heapq.heapreplace(heap, (da[i] + db[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(da):
            heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        cell = a[i] + b[j]
        if counts[cell]:
            yield cell


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """The first cells in order that hold `wanted` vectors together, or all."""
    out, held = [], 0
    for cell in in_order(first, second, counts):
        out.append(cell)
        held += counts[cell]
        if held >= wanted:
            break
    return out


def sums(first: np.ndarray, second: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The summed distances of cells."""
    return first[cells // len(second)] + second[cells % len(second)]


def _scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit, such that squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _scaled(rows)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector to each row, in double precision, by one fixed order of operations."""
    query, rows = _scaled(query[None])[0], _scaled(rows)
    return np.einsum("ij,j->i", rows, query) / (np.sqrt(np.einsum("ij,ij->i", rows, rows)) * np.sqrt(np.einsum("j,j->", query, query)))


class Quantiser:
    """Two codebooks over the halves of unit vectors; of a width of 1 both halves are the whole."""

    def __init__(self, sample: np.ndarray, total: int):
        unit = _unit(sample)
        self.width, self.half = unit.shape[1], max(1, unit.shape[1] // 2)
        size = int(min(MOST_CODEWORDS, max(4, 2 ** round(np.log2(max(1.0, np.sqrt(total * CELLS_A_ROW)))))))
        a, b = self.halves(unit)
        self.first, self.second = codebook(a, size), codebook(b, size, seed=1)
        self.cells = len(self.first) * len(self.second)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return unit[:, : self.half], unit[:, self.half :] if self.width > 1 else unit

    def assign(self, rows: np.ndarray) -> np.ndarray:
        a, b = self.halves(_unit(rows))
        return nearest(a, self.first) * len(self.second) + nearest(b, self.second)

    def distances(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.halves(_unit(row[None]))
        return ((self.first - a) ** 2).sum(1), ((self.second - b) ** 2).sum(1)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _best(near: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the places of its k largest values above -inf."""
    k = min(k, near.shape[1])
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return [b[row[b] > -np.inf] for b, row in zip(best, near, strict=True)]


def _enter(quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("vector"), quantiser.value.width)
                cells = quantiser.value.assign(rows).astype(np.int32)
                plain = rows + 0.0  # one form of zero
                names = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in plain], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("asks"), names, pa.array(cells), batch.column("vector")], ["id", "asks", "name", "cell", "vector"])

    return run


def _by_force(sample, width: int, k: int):
    """Of the sample's rows the nearest other entries in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, unit = sample.value
        number = {x: i for i, x in enumerate(names)}
        for batch in batches:
            for a in range(0, batch.num_rows, REGION_ROWS):
                part = batch.slice(a, REGION_ROWS)
                near = unit @ _unit(_matrix(part.column("vector"), width)).T
                for j, name in enumerate(part.column("name").to_pylist()):
                    if name in number:
                        near[number[name], j] = -np.inf
                best, cells = _best(near, k), part.column("cell").to_numpy()
                q = np.repeat(np.arange(len(best), dtype=np.int32), [len(x) for x in best])
                at = np.concatenate(best).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cells[at]), pa.array(near[q, at])], ["q", "cell", "score"])

    return run


def _reach(model, counts):
    """How many vectors a query visits before it has been in each of its neighbours' cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needed: list[int] = []
            for row, cells in zip(_matrix(batch.column("vector"), model.value.width), batch.column("cells").to_pylist(), strict=True):
                left, held = {c: cells.count(c) for c in cells}, 0
                for cell in in_order(*model.value.distances(row), counts.value):
                    held += int(counts.value[cell])
                    needed += [held] * left.pop(cell, 0)
                    if not left:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(needed, pa.int64())], ["needed"])

    return run


def _probe(model, counts, regions, wanted: float):
    """Queries with each region that they visit and the radius up to which its cells are visited, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region_of = regions.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            at, region, radius = [], [], []
            for i, row in enumerate(_matrix(batch.column("vector"), model.value.width)):
                first, second = model.value.distances(row)
                visited = np.array(visit(first, second, counts.value, wanted), np.int64)
                met = np.unique(region_of[visited])
                at += [i] * len(met)
                region.append(met)
                radius += [float(sums(first, second, visited).max())] * len(met)
            yield pa.RecordBatch.from_arrays([batch.column("name").take(pa.array(at)), batch.column("vector").take(pa.array(at)), pa.array(np.concatenate(region).astype(np.int32)), pa.array(radius)], ["name", "vector", "region", "radius"])

    return run


def _deal(regions):
    """Entries with their region and their part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region_of, parts = regions.value
        for batch in batches:
            region = region_of[batch.column("cell").to_numpy()]
            part = np.array([int.from_bytes(x[:4], "big") for x in batch.column("name").to_pylist()], np.int64) % parts[region]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region, pa.int32()), pa.array(part, pa.int32())], [*batch.schema.names, "region", "part"])

    return run


def _group(model, k: int):
    """The k best entries of a group for each of its queries, by exact cosine and then by their smallest id.

    The first pass is a product of matrices, whose last digits are those of another formula: every entry whose value may
    reach the k-th, by the error that such sums can have, is scored exactly, however many are equal.
    """
    width = model.value.width
    error = 8 * (width + 8) * np.finfo(np.float64).eps

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"name": pa.array([], pa.binary()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())})
        if not entries.num_rows or not queries.num_rows:
            return empty
        asked, rows = (_matrix(x.column("vector").combine_chunks(), width) for x in (queries, entries))
        cells, local = np.unique(entries.column("cell").to_numpy(), return_inverse=True)
        near = _unit(asked) @ _unit(rows).T
        radius = queries.column("radius").to_numpy()
        visited = np.stack([sums(*model.value.distances(q), cells) <= r for q, r in zip(asked, radius, strict=True)])
        near[~visited[:, local]] = -np.inf
        ids = entries.column("ids").combine_chunks()
        smallest = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
        best, score = [], []
        for q, row in zip(asked, near, strict=True):
            last = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
            likely = np.flatnonzero((row >= last - error) & (row > -np.inf))
            exact = cosines(q, rows[likely])
            order = np.lexsort((smallest[likely], -exact))[:k]
            best.append(likely[order])
            score.append(exact[order])
        which = np.concatenate(best).astype(np.int64)
        names = queries.column("name").take(pa.array(np.repeat(np.arange(len(best)), [len(b) for b in best])))
        return pa.table({"name": names, "ids": entries.column("ids").take(pa.array(which)), "score": pa.array(np.concatenate(score) if score else np.zeros(0))})

    return run


class Index:
    """The multi-index of vectors of one width: entries in the shared folder, codebooks and counts with the tasks."""

    def __init__(self, rows: DataFrame, width: int, total: int, k: int):
        self.spark, self.width, self.k = rows.sparkSession, width, k
        # about SAMPLE_ROWS, by a threshold on the hash, so that no task gathers other tasks' rows
        share = min(1.0, SAMPLE_ROWS / total)
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "vector").toArrow().sort_by("id")
        sample = _matrix(drawn.column("vector").combine_chunks(), width)
        self.model = self.spark.sparkContext.broadcast(Quantiser(sample, total))
        schema = "id long, asks boolean, name binary, cell int, vector array<double>"
        self.entered = common.scratch(rows.select("id", "asks", "vector").mapInArrow(_enter(self.model), schema), "entered")
        # the window's limit works before its shuffle, so copies of one vector don't meet in one task
        first = Window.partitionBy("name").orderBy("id")
        few = self.entered.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
        entries = few.groupBy("name", "cell").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max(F.when(F.col("n") == 1, F.col("vector"))).alias("vector"))
        self.entries = common.scratch(entries, "multi-index")
        held = self.entries.groupBy("cell").agg(F.count("*").alias("n")).toArrow()
        counts = np.zeros(self.model.value.cells, np.int64)
        counts[held.column("cell").to_numpy()] = held.column("n").to_numpy()
        self.total = int(counts.sum())
        self.counts = self.spark.sparkContext.broadcast(counts)
        before = np.cumsum(counts) - counts
        _, region_of = np.unique(before // REGION_ROWS, return_inverse=True)
        parts = -(-np.bincount(region_of, counts).astype(np.int64) // REGION_ROWS)
        self.regions = self.spark.sparkContext.broadcast((region_of.astype(np.int32), np.maximum(parts, 1)))
        self.wanted = self._fitted(sample)

    def _fitted(self, sample: np.ndarray) -> int:
        """So many vectors are visited that TARGET of the sample queries' true neighbours are among them, 64 k at least."""
        asked = sample[np.unique(np.linspace(0, len(sample) - 1, min(SAMPLE_QUERIES, len(sample))).astype(int))]
        names = [xxhash.xxh3_128_digest((x + 0.0).tobytes()) for x in asked]
        shared = self.spark.sparkContext.broadcast((names, _unit(asked)))
        near = self.entries.select("name", "cell", "vector").mapInArrow(_by_force(shared, self.width, self.k), "q int, cell int, score double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))
        cells = near.withColumn("rank", rank).where(F.col("rank") <= self.k).groupBy("q").agg(F.collect_list("cell").alias("cells"))
        queries = self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "q int, vector array<double>").repartition(16, "q")
        needed = queries.join(cells, "q").select("vector", "cells").mapInArrow(_reach(self.model, self.counts), "needed long").toArrow().column("needed").to_numpy()
        fitted = int(np.quantile(needed, TARGET, method="higher")) if len(needed) else self.total
        return min(self.total, max(fitted, 64 * self.k))

    def search(self) -> DataFrame:
        """query_id, rank, vec_id, score of the rows that ask."""
        asking = common.scratch(self.entered.where("asks").select("id", "name").distinct(), "asking")
        queries = self.entries.join(asking.select("name").distinct(), "name").select("name", "vector")
        probes = common.scratch(queries.mapInArrow(_probe(self.model, self.counts, self.regions, self.wanted), "name binary, vector array<double>, region int, radius double"), "probes")
        crowds = probes.groupBy("region").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("crowds"))
        parts = self.regions.value[1]
        most = int(parts.max())
        sizes = self.spark.createDataFrame([(int(r), int(parts[r])) for r in np.flatnonzero(parts > 1)], "region int, parts int") if most > 1 else None
        asked = probes.join(crowds, "region").withColumn("crowd", F.pmod(F.xxhash64("name"), F.col("crowds")).cast("int")).drop("crowds")
        if sizes is None:
            asked = asked.withColumn("part", F.lit(0))
        else:  # at most a row for each REGION_ROWS entries
            asked = asked.join(sizes, "region", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        entries = self.entries.mapInArrow(_deal(self.regions), "name binary, cell int, ids array<long>, vector array<double>, region int, part int")
        entries = entries.join(crowds, "region").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds", "name")
        keys = ("region", "part", "crowd")
        found = entries.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_group(self.model, self.k + 1), "name binary, ids array<long>, score double")
        best = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
        listed = found.select("name", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= self.k + 1)
        mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        others = asking.select(F.col("id").alias("query_id"), "name").join(listed, "name").where("vec_id <> query_id")
        return others.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def indexes(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> list[Index]:
    """An index for each number of components that the vectors which take part have."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    valid = rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    widths = valid.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect()
    return [Index(valid.where(F.size("vector") == r.width), r.width, r.n, k) for r in widths]


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row for which the column `is_query` holds, its k nearest other rows.

    Nearest by cosine, ties to the smaller id; all candidates if there are fewer than k. Rows with a null id, a
    null, empty or zero vector, or a null or non-finite component take no part. A cosine needs vectors of equal
    length, so each length is a search of its own, with its own index; there should be few. Equal vectors are one
    entry that lists its k + 1 smallest ids, and equal queries are searched once. Rows of one id are one another's
    candidates only if their vectors differ, and never their own.
    """
    found = [x.search() for x in indexes(vectors, is_query, k, id_col, vector_col)]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    if len(found) == 1:
        return out
    # rows of one id may stand in several searches
    mine = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k)

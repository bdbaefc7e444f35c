"""Product codes of vectors by Yinyang Lloyd on integers.

Vectors are scaled to integers and cut into parts, each with a codebook of few entries. Lloyd's rounds assign every
part to its nearest entry and move entries to the floor of their parts' mean. The entries of a codebook are clustered
into groups. Of every part an upper bound of the distance to its own entry is kept, and one lower bound for each group,
which holds for all entries of the group but the own one. When entries move, the bounds drift with them, and only
groups are scanned whose lower bound isn't above the upper one. Bounds are rounded outwards and a scan compares exact
squared integer distances, equal ones by the entry's index, so the result is that of comparing all entries.

Vectors and bounds lie in a table in the shared folder, written anew each round beside the sums of the entries. The
driver gets only these sums, added up by Spark: their number depends on the codebooks alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from codexmill.sources.scratch import forget

#: Vectors have so many parts, codebooks so many entries in so many groups, and entries move in so many rounds.
PARTS, ENTRIES, GROUPS, ROUNDS = 8, 16, 4, 6
SCALE = 4096
#: Vectors whose largest component times the root of their length is below have squared distances of 64 bits.
NARROW = 1 << 30
#: Sums travel in pieces of so many bits, so that adding them up fits 64 bits.
LIMB = 40
LONGEST = (1 << 63) - 1

_STATE = "vec_id long, label {}, vector array<{}>, code binary, upper array<float>, lower array<float>, error long"
_SUMS = "slot int, limb int, part_sum long"
#: Slot of the number of distances that were worked out.
_WORK = -1


@dataclass(frozen=True)
class Codebooks:
    """entries[p][e]: whole numbers, as Python's own; groups[p][e]: the group of entry e; width of all vectors."""

    entries: list[list[list[int]]]
    groups: list[list[int]]
    width: int

    def cuts(self) -> list[int]:
        """Where parts begin and end; equal parts if the width is a multiple of PARTS."""
        return [p * self.width // PARTS for p in range(PARTS + 1)]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for entry in book for x in entry).encode()).hexdigest()


def scaled(x: float) -> int:
    """floor(SCALE * x), exactly."""
    return int(x) * SCALE if abs(x) >= 1 << 53 else math.floor(x * SCALE)


def _clustered(entries: list[list[int]], groups: int = GROUPS, steps: int = 5) -> list[int]:
    """Entries into groups by Lloyd's steps from evenly spaced ones; any grouping gives the same codes."""
    points = np.array([[float(min(max(x, -1e150), 1e150)) for x in e] for e in entries]).reshape(len(entries), -1)
    centres = points[np.linspace(0, len(points) - 1, min(groups, len(points))).astype(int)].copy()
    for _ in range(steps):
        near = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in range(len(centres)):
            if (near == g).any():
                centres[g] = points[near == g].mean(0)
    return [int(x) for x in near]


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers, points by entries."""
    out = np.zeros((len(points), len(entries)), points.dtype)
    for d in range(points.shape[1]):
        gap = points[:, d, None] - entries[None, :, d]
        out += gap * gap
    return out


def _up(squares: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _down(squares: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


@dataclass
class Part:
    """One part of a slice of vectors: points, their entries and bounds."""

    points: np.ndarray
    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray

    def drift(self, moved: np.ndarray, groups: np.ndarray) -> None:
        """Entries moved by no more than `moved`: upper bounds grow by the own entry's way, lower ones shrink by their group's longest."""
        self.upper = np.nextafter(self.upper + moved[self.code], np.float32(np.inf))
        farthest = np.array([moved[groups == g].max(initial=0) for g in range(self.lower.shape[1])], np.float32)
        self.lower = np.maximum(np.nextafter(self.lower - farthest, np.float32(-np.inf)), np.float32(0))

    def assign(self, entries: np.ndarray, groups: np.ndarray) -> int:
        """Move each point to its nearest entry, the least of equally near ones; the number of distances that took."""
        # strictly above: an equally near entry of a lower index may be in a group whose bound is equal
        rows = np.flatnonzero(self.upper >= self.lower.min(1))
        if not len(rows):
            return 0
        code, points = self.code[rows].astype(np.int64), self.points[rows]
        gap = points - entries[code]
        own = (gap * gap).sum(1)
        work = len(rows)
        self.upper[rows] = _up(own)
        failing = self.upper[rows][:, None] >= self.lower[rows]
        first, first_own = code.copy(), own.copy()
        best, best_code = own.copy(), code.copy()
        scans = {}
        for g in range(self.lower.shape[1]):
            members, hit = np.flatnonzero(groups == g), np.flatnonzero(failing[:, g])
            if len(members) and len(hit):
                found = distances(points[hit], entries[members])
                scans[g] = (members, hit, found)
                work += found.size
                for k, entry in enumerate(members):
                    d = found[:, k]
                    better = (d < best[hit]) | (d == best[hit]) & (entry < best_code[hit])
                    best[hit[better]], best_code[hit[better]] = d[better], entry
        for g in range(self.lower.shape[1]):
            if g in scans:
                members, hit, found = scans[g]
                bound = np.full(len(hit), np.float32(np.inf))
                for k, entry in enumerate(members):
                    bound = np.where(best_code[hit] == entry, bound, np.minimum(bound, _down(found[:, k])))
                self.lower[rows[hit], g] = bound
            # an entry that was left counts again for the bound of its group
            left = (best_code != first) & (groups[first] == g)
            if left.any() and g in scans:
                left[scans[g][1]] = False
            self.lower[rows[left], g] = np.minimum(self.lower[rows[left], g], _down(first_own[left]))
        changed = best_code != first
        self.upper[rows[changed]] = _up(best[changed])
        self.code[rows] = best_code
        return work


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, i = (1 if value >= 0 else -1), abs(value), 0
    while rest:
        yield i, sign * (rest & (1 << LIMB) - 1)
        rest >>= LIMB
        i += 1


def _ways(before: Codebooks, after: Codebooks) -> list[np.ndarray]:
    """How far each entry moved, at most."""
    out = []
    for old, new in zip(before.entries, after.entries, strict=True):
        squares = [float(min(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), 10**300)) for x, y in zip(old, new, strict=True)]
        out.append(_up(np.array(squares)) * (np.array(squares) > 0))
    return out


def _step(books: Codebooks, moved: list[np.ndarray] | None, final: bool):
    """The map of one round over the state's batches: new state, and the sums of entries as rows of their own."""
    cuts = books.cuts()
    groups = [np.array(g, np.int64) for g in books.groups]
    vacant = np.array([[g not in book for g in range(GROUPS)] for book in books.groups])
    largest = max((abs(x) for b in books.entries for e in b for x in e), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                n, vectors = part.num_rows, part.column("vector")
                values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, books.width)
                # Python's whole numbers where 64 bits could overflow; bounds aren't used there
                wide = max(largest, SCALE * np.abs(values).max(initial=0)) * math.sqrt(books.width) >= NARROW
                ints = np.array([[scaled(x) for x in row] for row in values.tolist()], object).reshape(values.shape) if wide else np.floor(values * SCALE).astype(np.int64)
                fresh = moved is None
                code = np.zeros((n, PARTS), np.uint8) if fresh else np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(n, PARTS).copy()
                upper = np.full((n, PARTS), np.inf, np.float32) if fresh else part.column("upper").flatten().to_numpy().reshape(n, PARTS).copy()
                lower = np.where(vacant, np.float32(np.inf), np.zeros((n, 1, 1), np.float32)) if fresh else part.column("lower").flatten().to_numpy().reshape(n, PARTS, GROUPS).copy()
                error = np.zeros(n, object if wide else np.int64)
                for p in range(PARTS):
                    entries = np.array(books.entries[p], object if wide else np.int64).reshape(len(books.entries[p]), -1)
                    points = ints[:, cuts[p] : cuts[p + 1]]
                    if wide:
                        found = distances(points, entries)
                        code[:, p] = [min(range(len(entries)), key=lambda e: (row[e], e)) for row in found]
                        upper[:, p], lower[:, p] = np.inf, 0
                    else:
                        state = Part(points, code[:, p], upper[:, p], lower[:, p])
                        if not fresh:
                            state.drift(moved[p], groups[p])
                        sums[_WORK] = sums.get(_WORK, 0) + state.assign(entries, groups[p])
                        code[:, p], upper[:, p], lower[:, p] = state.code, state.upper, state.lower
                    gap = points - entries[code[:, p].astype(np.int64)]
                    if final:
                        error += (gap * gap).sum(1)
                    else:
                        for e in np.unique(code[:, p]).tolist():
                            mine = points[code[:, p] == e]
                            slot = (p * ENTRIES + e) * (books.width + 1)
                            sums[slot] = sums.get(slot, 0) + len(mine)
                            for d, x in enumerate(mine.sum(0).tolist() if mine.shape[1] else []):
                                sums[slot + 1 + d] = sums.get(slot + 1 + d, 0) + x
                yield _state(part, code, upper, lower, [x if x <= LONGEST else None for x in error.tolist()])
            kinds = [batch.schema.field(x).type for x in ("vec_id", "label", "vector")]
        rows = [(slot, limb, piece) for slot, total in sums.items() for limb, piece in _limbs(total)]
        if rows:
            yield _sums(rows, kinds)

    return run


_FIELDS = [pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.int64()]
_SUM_FIELDS = [pa.int32(), pa.int32(), pa.int64()]
_NAMES = [x.split(" ")[0] for x in f"{_STATE}, {_SUMS}".split(", ")]


def _rows_of(values: np.ndarray) -> pa.Array:
    n, width = len(values), values[0].size if len(values) else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def _state(part: pa.RecordBatch, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, error: list) -> pa.RecordBatch:
    codes = common.arrow_binary(code.reshape(-1), np.arange(len(code) + 1) * PARTS)
    columns = [part.column("vec_id"), part.column("label"), part.column("vector"), codes, _rows_of(upper), _rows_of(lower), pa.array(error, pa.int64())]
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(len(code), t) for t in _SUM_FIELDS], _NAMES)


def _sums(rows: list[tuple[int, int, int]], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SUM_FIELDS, strict=True)]
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), t) for t in kinds + _FIELDS] + columns, _NAMES)


def _moved(books: Codebooks, table: DataFrame) -> tuple[Codebooks, int]:
    """The codebooks after a round, from the sums of its table, and the number of distances worked out."""
    totals: dict[int, int] = {}
    for slot, limb, total in table.where("slot IS NOT NULL").groupBy("slot", "limb").agg(F.sum("part_sum")).collect():
        totals[slot] = totals.get(slot, 0) + (total << LIMB * limb)
    entries = []
    for p, book in enumerate(books.entries):
        new = []
        for e, entry in enumerate(book):
            slot = (p * ENTRIES + e) * (books.width + 1)
            count = totals.get(slot, 0)
            new.append([totals.get(slot + 1 + d, 0) // count for d in range(len(entry))] if count else entry)
        entries.append(new)
    return Codebooks(entries, books.groups, books.width), totals.get(_WORK, 0)


@dataclass(frozen=True)
class Coded:
    """rows: vec_id, label, code (one byte a part), error; work: distances that each round worked out."""

    rows: DataFrame
    books: Codebooks | None
    work: list[int]


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> Coded:
    """Codebooks of all vectors and each vector's code.

    Vectors that are null, or hold null or non-finite components, are dropped. The first codebooks are the parts of the
    vectors with the smallest ids (null ids last, equal ids by their vector). All others must be as long as the first
    of these: of another length they get neither code nor error. If the length is no multiple of PARTS, some parts are one
    component longer than others. An error beyond a long is null. Repeated rows count each. Fewer vectors
    than entries give smaller codebooks; an empty table gives none.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    named = vectors.schema[label_col].dataType.simpleString()
    value = F.col(vector_col).cast(f"array<{kind}>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(value.isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), value.alias("vector"))
    first = [r["vector"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()]
    if not first:
        return Coded(kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None, [])
    width = len(first[0])
    plain = Codebooks([], [], width)
    cuts = plain.cuts()
    entries = [[[scaled(x) for x in v[cuts[p] : cuts[p + 1]]] for v in first if len(v) == width] for p in range(PARTS)]
    books = Codebooks(entries, [_clustered(book) for book in entries], width)
    same = F.size("vector") == width
    state, old, moved, work = kept.where(same), None, None, []
    for r in range(rounds + 1):
        path = common.scratch_path(spark, "codes")
        out = state.mapInArrow(common.resting(_step(books, moved, r == rounds)), f"{_STATE.format(named, kind)}, {_SUMS}")
        out.write.option("compression", "zstd").parquet(path)
        table = spark.read.schema(out.schema).parquet(path)
        if old:
            forget(spark, old)  # the round before is in the new table now
        after, done = _moved(books, table)
        moved, old = _ways(books, after), path
        work.append(done)
        books = after if r < rounds else books
        state = table.where("slot IS NULL")
    others = kept.where(~same).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return Coded(state.select("vec_id", "label", "code", "error").unionAll(others), books, work)


def with_label_errors(coded: Coded) -> DataFrame:
    """vec_id, code (hex), error, label_error (the errors of all rows of that label added up, nulls together; null beyond a long), codebooks_sha256."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.rows.groupBy("label").agg(F.when(total <= LONGEST, total).cast("long").alias("label_error")).withColumnRenamed("label", "__label")
    sums = common.scratch(sums, "label-errors")
    sums = F.broadcast(sums) if sums.count() <= common.BROADCAST_IDS else sums
    joined = coded.rows.join(sums, F.col("label").eqNullSafe(F.col("__label")), "left")
    digest = F.lit(coded.books.digest() if coded.books else hashlib.sha256(b"").hexdigest())
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))

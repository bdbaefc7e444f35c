"""Near-duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Texts with the same set of shingles form a class, which is compared once. Classes that share a band of
their signatures are candidates. A pair's signatures are compared batch by batch, and it is dropped as
soon as the posterior probability that its similarity reaches the threshold falls below the miss
probability. The surviving pairs' groups are verified on full sets. Pairs already connected need no check,
since only components are asked for; every component is that of all links.

A crowded bucket, or group, is compared in blocks of bounded size, some of its members being in every block.
What that connects most of the members to needs no further comparison among itself: only the members outside
of the largest component meet all others, so a mass of copies costs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

#: Words of a shingle; hashes of a signature; rows of a band and number of bands. At similarity 0.85 all
#: bands differ with probability (1 - 0.85 ** 5) ** 25, less than one in a million; at 0.8 one in 20,000.
WORDS, HASHES, ROWS, BANDS = 5, 128, 5, 25
#: Hashes compared at a time, and the posterior probability of a link below which a pair is dropped.
BATCH, MISS = 32, 1e-6
#: A block holds about so many classes, and about so many shingles; about so many classes of a group are in all its blocks.
BLOCK_CLASSES, BLOCK_SHINGLES, LEADERS = 192, 1 << 21, 16
#: A bucket with more blocks of members outside of its largest component is cut by further bands, of so many rows: at similarity
#: 0.85 all differ with probability (1 - 0.85 ** 7) ** 40, two in ten million; texts that merely share a passage hardly meet.
OUTSIDE_BLOCKS, FINE_ROWS, FINE_BANDS = 40, 7, 40
#: Rows of band buckets that are compared in one call, if there are more than a call for each shuffle partition.
BIN_ROWS = 1 << 13
#: Tables of ids up to this size are broadcast to find their texts.
BROADCAST_BYTES = 32 << 20
#: Words that a worker remembers the hash of.
MEMO_WORDS = 200_000
#: Bytes of text that are shingled at a time; words and hashes of a text take some ten times its bytes.
TEXT_BYTES = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(20)
_PLACES = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_FINE = [_RNG.permutation(HASHES)[:FINE_ROWS].tolist() for _ in range(FINE_BANDS)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's sorted different 64-bit shingle hashes: of all runs of five words, or of all words if fewer."""
    words = [x.translate(_LOWER).split() for x in texts]
    if len(_hashes) > MEMO_WORDS:
        _hashes.clear()
    sizes = np.array([len(x) for x in words], np.int64)
    total = int(sizes.sum())
    flat = np.fromiter((h for x in words for h in map(_hashes.__getitem__, x)), np.uint64, total)
    last = max(0, total - WORDS + 1)
    mixed = np.zeros(last, np.uint64)
    for k in range(WORDS):
        mixed += flat[k : k + last] * _PLACES[k]
    mixed = _mix(mixed)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= WORDS:
            out.append(np.unique(mixed[at : at + n - WORDS + 1]))
        elif n:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for k in range(n):
                    whole += flat[at + k] * _PLACES[k]
                whole += np.uint64(n)
            out.append(_mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each hash function the smallest value over the set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), 2048):
        np.minimum(out, (low[a : a + 2048, None] * _FACTORS + _OFFSETS).min(0), out=out)
    return out


_ROW = "doc_id long, h1 long, h2 long"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.text_slices(batch, "text", TEXT_BYTES):
            sets = shingle_sets([x or b"" for x in part.column("text").to_pylist()])
            columns = [part.column(k) for k in ("doc_id", "h1", "h2")]
            columns.append(pa.array([len(x) for x in sets], pa.int64()))
            columns.append(pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()))
            columns.append(pa.array([signature(x).astype("<u4").tobytes() if len(x) else None for x in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "n_shingles", "class", "signature"])


@cache
def fewest_matches(threshold: float, miss: float = MISS, hashes: int = HASHES, batch: int = BATCH) -> dict[int, int]:
    """For each number n of compared hashes the fewest matches m that keep a pair.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1); the pair stays while its
    mass at or above the threshold is at least `miss`.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold].sum() >= miss * mass.sum():
                out[n] = m
                break
    return out


class _Overlaps:
    """Intersection sizes of one set with many others at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        different, self.places = np.unique(np.concatenate(sets), return_inverse=True)
        self.marked = np.zeros(len(different), np.uint8)

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.places[self.starts[i] : self.starts[i] + self.sizes[i]]
        self.marked[own] = 1
        out = np.empty(len(others), np.int64)
        ends = np.cumsum(self.sizes[others])
        a = 0
        while a < len(others):
            done = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, done + (1 << 20), side="right")))
            sizes = self.sizes[others[a:b]]
            firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            at = np.repeat(self.starts[others[a:b]] - firsts, sizes) + np.arange(sizes.sum())
            out[a:b] = np.add.reduceat(self.marked[self.places[at]], firsts, dtype=np.int64)
            a = b
        self.marked[own] = 0
        return out


class _Labels:
    """Which items are connected so far. known: labels to begin with."""

    def __init__(self, n: int, known: np.ndarray | None = None):
        self.of = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
        self.members: dict[int, list[int]] = {}
        for i, x in enumerate(self.of.tolist()):
            self.members.setdefault(x, []).append(i)

    def join(self, i: int, j: int) -> bool:
        """Connect two items; whether they weren't yet."""
        a, b = int(self.of[i]), int(self.of[j])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members.pop(b)
        return True


def links(sets: list[np.ndarray], signatures: np.ndarray, side: np.ndarray | None, percent: int, keep: dict[int, int], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that connect what all links connect. side: 0 or 1, then only pairs across are compared.

    No set is empty. A set is first verified against the likeliest member of each group that the links so far
    have made, then against all likely members of the groups that it still isn't linked with.
    """
    batches = [np.ascontiguousarray(signatures[:, n - BATCH : n]) for n in keep]
    overlaps = _Overlaps(sets)
    sizes, labels, out = overlaps.sizes, _Labels(len(sets), known), []
    across = None if side is None else np.flatnonzero(side == 1)

    def verify(i: int, others: np.ndarray) -> None:
        both = overlaps.of(i, others)
        out.extend((i, j) for j in others[100 * both >= percent * (sizes[i] + sizes[others] - both)].tolist() if labels.join(i, j))

    for i in range(len(sets)) if side is None else np.flatnonzero(side == 0).tolist():
        rest = np.arange(i + 1, len(sets)) if across is None else across
        rest = rest[(labels.of[rest] != labels.of[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))]
        matched = np.zeros(len(rest), np.int64)
        for part, fewest in zip(batches, keep.values(), strict=True):
            if not len(rest):
                break
            matched += (part[rest] == part[i]).sum(1)
            rest, matched = rest[matched >= fewest], matched[matched >= fewest]
        if len(rest):
            rest = rest[np.argsort(-matched, kind="stable")]
            first = np.sort(np.unique(labels.of[rest], return_index=True)[1])
            verify(i, rest[first])
            rest = np.delete(rest, first)
            verify(i, rest[labels.of[rest] != labels.of[i]])
    return out


def _known(table: pa.Table, order: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """The side and the label of each row, if the rows are those of a second comparison."""
    if "side" not in table.column_names:
        return None, None
    return table.column("side").to_numpy()[order], np.array(table.column("label").to_pylist(), object).astype("S16")[order]


def _verifier(percent: int, keep: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        names = table.column("class").to_pylist()
        order = np.argsort(np.array(names, object).astype("S16"), kind="stable")
        sets = [np.frombuffer(table.column("shingles")[i].as_py(), "<u8") for i in order.tolist()]
        signatures = np.stack([np.frombuffer(table.column("signature")[i].as_py(), "<u4") for i in order.tolist()])
        side, known = _known(table, order)
        found = links(sets, signatures, side, percent, keep, known)
        return pa.table({"a": pa.array([names[order[i]] for i, _ in found], pa.binary()), "b": pa.array([names[order[j]] for _, j in found], pa.binary())})

    return run


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.text_slices(batch, "text", TEXT_BYTES):
            sets = shingle_sets([x or b"" for x in part.column("text").to_pylist()])
            ours = [xxhash.xxh3_128_digest(x.tobytes()) == y for x, y in zip(sets, part.column("class").to_pylist(), strict=True)]  # another text may have the hashes
            columns = [part.column(k) for k in ("class", "key", "blocks")]
            columns.append(pa.array([signature(x).astype("<u4").tobytes() for x in sets], pa.binary()))
            columns.append(pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["class", "key", "blocks", "signature", "shingles"]).filter(pa.array(ours, pa.bool_()))


def _sieve_bucket(short: np.ndarray, side: np.ndarray | None, known: np.ndarray | None, keep: dict[int, int]) -> list[tuple[int, int]]:
    """Pairs that survive the pruning and connect what all surviving pairs connect."""
    labels, out = _Labels(len(short), known), []
    across = None if side is None else np.flatnonzero(side == 1)
    for i in range(len(short)) if side is None else np.flatnonzero(side == 0).tolist():
        rest = np.arange(i + 1, len(short)) if across is None else across
        rest = rest[labels.of[rest] != labels.of[i]]
        matched = np.zeros(len(rest), np.int64)
        for n, fewest in keep.items():
            if not len(rest):
                break
            matched += (short[rest, n - BATCH : n] == short[i, n - BATCH : n]).sum(1)
            rest, matched = rest[matched >= fewest], matched[matched >= fewest]
        if len(rest):
            out += [(i, j) for j in rest[np.unique(labels.of[rest], return_index=True)[1]].tolist() if labels.join(i, j)]
    return out


def _siever(keep: dict[int, int]):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        keys = table.column("key").to_numpy()[order]
        side, known = _known(table, order)
        short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, HASHES)[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.concatenate([starts[1:], [len(keys)]])
        first, second = [], []
        if side is None:  # buckets of two, most of all, at once
            two = starts[ends - starts == 2]
            likely = np.ones(len(two), bool)
            matched = np.zeros(len(two), np.int64)
            for n, fewest in keep.items():
                matched += (short[two, n - BATCH : n] == short[two + 1, n - BATCH : n]).sum(1)
                likely &= matched >= fewest
            first, second = two[likely].tolist(), (two[likely] + 1).tolist()
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a > 2 or b - a == 2 and side is not None:
                for i, j in _sieve_bucket(short[a:b], None if side is None else side[a:b], None if known is None else known[a:b], keep):
                    first.append(a + i)
                    second.append(a + j)
        names = table.column("class").combine_chunks()
        left, right = (names.take(pa.array(order[np.array(x, np.int64)])) for x in (first, second))
        return pa.table({"a": left, "b": right})

    return run


def _finer(rows: DataFrame) -> DataFrame:
    """The rows (key, class, short) of crowded buckets, in buckets by key and a further band."""
    keys = F.array(*(F.xxhash64("key", F.lit(k), F.concat(*(F.substring("short", i + 1, 1) for i in places))) for k, places in enumerate(_FINE)))
    fine = rows.select("class", "short", F.explode(keys).alias("key"))
    sizes = common.scratch(fine.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "fine-buckets")
    return fine.join(sizes, "key").select("key", "class", "short", F.ceil(F.col("n") / BLOCK_CLASSES).cast("int").alias("blocks"))


def _connected(rows: DataFrame, compare, bins: int | None = None, finer=None) -> DataFrame:
    """class, root of what `compare` connects among the rows (key, class, blocks and what it needs) of each key.

    The rows of a key are dealt over its blocks by their hash, some of them to all of its blocks, and compared within
    these. If a key has several blocks, its members outside of the largest component are then compared with those
    members that they aren't connected with, in groups of a block of the one and a block of the other. If these
    outsiders are many, `finer` deals the key's rows over smaller keys instead, and that is done once more with them.
    """
    rows = common.scratch(rows, "compared")
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    leads = F.pmod(F.xxhash64(F.lit("leads"), "class"), F.col("blocks") * BLOCK_CLASSES) < LEADERS
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = rows.withColumn("block", F.explode(F.when(leads, every).otherwise(F.array(own)))).withColumn("bin", F.pmod("key", F.lit(bins)) if bins else F.col("key"))
    found = components.connected_components(dealt.groupBy("bin", "block").applyInArrow(compare, "a binary, b binary"))
    large = rows.where("blocks > 1")
    if large.isEmpty():
        return found
    found = common.scratch(found, "components")
    labelled = common.scratch(large.join(found, large["class"] == found["node"], "left").select(large["*"], F.coalesce("root", "class").alias("label")), "labelled")
    sizes = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = common.scratch(sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), (F.sum("n") - F.max("n")).alias("outside")), "largest")
    # of a key's blocks outside of the largest component; a key without such members needs no more
    most = most.where("outside > 0").withColumn("parts", F.ceil(F.col("outside") / BLOCK_CLASSES).cast("int"))
    again = finer is not None and not most.where(F.col("parts") > OUTSIDE_BLOCKS).isEmpty()
    ready = labelled.join(most.where(F.col("parts") <= OUTSIDE_BLOCKS) if again else most, "key").withColumn("block", own)
    part = F.pmod(F.xxhash64(F.lit("outside"), "class"), F.col("parts")).cast("int")
    outside = ready.where(F.col("label") != F.col("most")).withColumn("part", part).withColumn("block", F.explode(every)).withColumn("side", F.lit(0))
    members = ready.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    more = outside.unionByName(members).groupBy("key", "block", "part").applyInArrow(compare, "a binary, b binary")
    stars = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    if again:
        crowded = labelled.join(most.where(F.col("parts") > OUTSIDE_BLOCKS), "key", "left_semi")
        stars = stars.union(_connected(finer(crowded), compare, bins).select("node", "root"))
    return components.connected_components(stars.union(more))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest byte of each hash: equal hashes stay equal, and few others become so."""
    for batch in batches:
        full = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
        short = full.astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("keys"), pa.array([x.tobytes() for x in short], pa.binary())], ["class", "keys", "short"])


def _candidate_groups(classes: DataFrame, keep: dict[int, int]) -> DataFrame:
    """class, root for classes that some banded pair which isn't pruned connects with another.

    A band's bucket is compared in blocks of bounded size; small buckets share a task. Each gives a forest of
    its surviving pairs, no more rows than it has, so groups hold every survivor though few are written.
    """
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)))
    banded = classes.select("class", "signature", keys.alias("keys")).select("class", F.explode("keys").alias("key"))
    sizes = common.scratch(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    bins = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BIN_ROWS))
    kept = banded.join(sizes, "key").groupBy("class").agg(F.collect_list(F.struct("key", "n")).alias("keys"))
    with_signatures = kept.join(classes.select("class", "signature"), "class")
    rows = with_signatures.mapInArrow(common.resting(_shorten), "class binary, keys array<struct<key: bigint, n: bigint>>, short binary").select("class", "short", F.inline("keys"))
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")).drop("n")
    return _connected(rows, _siever(keep), bins, _finer).select(F.col("node").alias("class"), "root")


def _rows(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document: doc_id, h1, h2 (of its text), n_shingles, class, root of its component (both null without shingles)."""
    if percent < 80:
        raise ValueError("the bands find pairs of a similarity of 0.8 or more")
    h1, h2 = common.text_hashes(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).cast("binary").alias("text"))
    signed = common.scratch(source.mapInArrow(common.resting(_sign), _ROW + ", n_shingles long, class binary, signature binary"), "signatures")
    one = F.min(F.struct("h1", "h2"))
    classes = signed.where("class IS NOT NULL").groupBy("class").agg(one.alias("h"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature"))
    classes = common.scratch(classes, "classes")
    keep = fewest_matches(percent / 100)  # worked out once, on the driver
    groups = common.scratch(_candidate_groups(classes, keep), "groups")

    members = common.scratch(groups.join(classes.select("class", "h", "n_shingles"), "class"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = common.scratch(members.groupBy("root").agg(blocks.alias("blocks")), "sizes")
    members = common.scratch(members.join(sizes, "root").select("h.h1", "h.h2", "class", F.col("root").alias("key"), "blocks"), "members")
    wanted = F.broadcast(members) if members.count() * 80 <= BROADCAST_BYTES else members
    # copies of a text meet in the partial aggregate, before anything is shuffled
    texts = source.drop("doc_id").join(wanted, ["h1", "h2"]).groupBy("class", "key", "blocks").agg(F.min("text").alias("text"))
    loaded = texts.mapInArrow(common.resting(_load), "class binary, key binary, blocks int, signature binary, shingles binary")
    linked = common.scratch(_connected(loaded, _verifier(percent, keep)), "linked")
    return signed.drop("signature").join(linked, signed["class"] == linked["node"], "left").drop("node").withColumn("root", F.coalesce("root", "class"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets; a percent below 80 is
    refused. component_id is the smallest doc_id reachable, and kept tells whether it is the own one. Null and empty
    texts, and those of blanks, have no shingle, stand alone and are kept. Rows without an id take part; their
    component_id is that of the others they reach, and they are kept only if there is none. Repeated rows with one
    id have one component, and all of its rows are kept together.
    """
    rows = common.scratch(_rows(docs, percent, id_col, text_col).select("doc_id", "n_shingles", "root"), "rooted")
    least = common.scratch(rows.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    own_or = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", own_or.alias("component_id"), F.coalesce(F.col("doc_id") == own_or, own_or.isNull()).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id, then text hash; and all rows without shingles.

    Rows without an id come last, so one of them stays if the group has no other. Of repeated rows, with one id and one
    text, one stays.
    """
    rows = _rows(docs, percent, id_col, text_col).where("root IS NOT NULL").groupBy("root", "doc_id", "h1", "h2").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2", "n")
    chosen = common.scratch(rows.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias("__id"), F.col("m.h1").alias("__h1"), F.col("m.h2").alias("__h2"), F.col("m.n").alias("__n")), "chosen")
    side = F.broadcast(chosen) if chosen.count() <= common.BROADCAST_IDS else chosen
    h1, h2 = common.text_hashes(text_col)
    joined = docs.join(side, docs[id_col].cast("long").eqNullSafe(side["__id"]) & (h1 == side["__h1"]) & (h2 == side["__h2"]), "left")
    blank = ~F.coalesce(F.rlike(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    kept = joined.where(blank | F.col("__n").isNotNull())
    if not chosen.where("__n > 1").isEmpty():
        kept = kept.where("__n IS NULL OR __n = 1").unionByName(kept.where("__n > 1").dropDuplicates(["__id", "__h1", "__h2"]))
    return kept.select(docs.columns)

"""Conversation structure repair: A* on the edit lattice.

A conversation is read row by row. Keep, Rerole and Delete consume a row, Insert consumes none, and the roles that
stay must read `(s?(ua)+)?` by their initials. A node of the lattice is (rows consumed, place in the pattern); nodes
are expanded in the order of (cost so far + heuristic, audit), where the heuristic adds up, for the rows that are left,
the deletions that blank and duplicate rows need and the least that a truncated row costs. It never exceeds
the true rest and falls by no more than an edit costs, so the first time that a node is taken is its best.

Long conversations go through in blocks of BLOCK_ROWS rows: of each block the best way to each place of the pattern
stays, with the audit and the running hash of its text. So one conversation never lies in memory whole, however many
rows it has. Its hash is by definition over its rows in their order, which one task must read one after the other.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Rows of one conversation that one search takes.
BLOCK_ROWS = 512
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Places in the pattern: nothing yet, after the system's, the user's and the assistant's row; and where a role leads from each.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NAMES = {"u": "user", "a": "assistant"}
COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
#: White space of the contract, and a text's ends of sentences.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"


@dataclass
class Row:
    role: str
    text: str
    fault: str = ""

    @property
    def must_go(self) -> bool:
        return self.fault in ("blank", "duplicate")


@dataclass
class Way:
    """The best way to one place of the pattern: its cost, the audit behind the common start, the hash of what it keeps."""

    cost: int = 0
    audit: str = ""
    digest: object = field(default_factory=hashlib.sha256)
    empty: bool = True

    def extended(self, cost: int, audit: str, rows: list[tuple[str, str]]) -> Way:
        digest, empty = self.digest.copy(), self.empty
        for role, text in rows:
            digest.update((("" if empty else "\n") + f"{role}:{text}").encode())
            empty = False
        return Way(cost, audit, digest, empty)


def rest_costs(rows: list[Row]) -> list[int]:
    """For each place, the least that the rows from there on cost: deletions that must be, and what truncation costs anyway."""
    out = [0] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = out[i + 1] + (DELETE if rows[i].must_go else min(DELETE, TRUNCATED) if rows[i].fault == "truncated" else 0)
    return out


def search(rows: list[Row], ways: dict[int, Way], last: bool) -> dict[int, Way]:
    """The best ways over these rows, from those that lead to them; of the last rows only to places where a conversation may end."""
    rest, n = rest_costs(rows), len(rows)
    heap = [(way.cost + rest[0], way.audit, 0, place, place, way.cost, None) for place, way in ways.items()]
    heapq.heapify(heap)
    done: set[tuple[int, int]] = set()
    found: dict[int, Way] = {}
    while heap:
        _, audit, i, place, origin, cost, trail = heapq.heappop(heap)
        if (i, place) in done:
            continue
        done.add((i, place))
        if i == n and (not last or place in (START, ASSISTANT)):
            kept = []
            while trail:
                kept.append(trail[1])
                trail = trail[0]
            found[place] = ways[origin].extended(cost, audit, kept[::-1])
            if last:
                break
        steps = STEPS[place]

        def push(mark: str, after: int, to: int, more: int, row: tuple[str, str] | None) -> None:
            if (after, to) not in done:
                now = cost + more
                heapq.heappush(heap, (now + rest[after], audit + mark, after, to, origin, now, (trail, row) if row else trail))

        if i < n:
            row = rows[i]
            push("D", i + 1, place, DELETE, None)
            if not row.must_go:
                charge = TRUNCATED if row.fault == "truncated" else 0
                if row.role[:1] in steps:
                    push("K", i + 1, steps[row.role[:1]], charge, (row.role, row.text))
                for initial, name in NAMES.items():
                    if initial in steps:
                        push("R", i + 1, steps[initial], REROLE + charge, (name, row.text))
        if i < n or last:
            for initial, name in NAMES.items():
                if initial in steps:
                    push("I", i, steps[initial], INSERT, (name, ""))
    return found


class Repair:
    """One conversation, fed in the order of its turns."""

    def __init__(self, block: int = BLOCK_ROWS) -> None:
        self.block, self.rows, self.ways = block, [], {START: Way()}
        self.audit: list[str] = []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.turn = None
        self.turns = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, row: Row) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.first, self.turn = turn if self.first is None else self.first, turn
        if self.before is not None:
            self.illegal += self.before + row.role[:1] not in ("su", "ua", "au")
        self.before = row.role[:1]
        if row.fault:
            self.counts[row.fault] += 1
        if len(self.rows) == self.block:
            self._close(False)
        self.rows.append(row)

    def _close(self, last: bool) -> None:
        self.ways = search(self.rows, self.ways, last)
        self.rows = []
        # what all ways begin with needs no more comparing
        audits = [way.audit for way in self.ways.values()]
        low, high = min(audits), max(audits)
        same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        self.audit.append(low[:same])
        for way in self.ways.values():
            way.audit = way.audit[same:]

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        self._close(True)
        (way,) = self.ways.values()
        gaps = self.turn - self.first + 1 - self.turns if self.first is not None else 0
        return gaps, *self.counts.values(), self.illegal, way.cost, "".join(self.audit) + way.audit, way.digest.hexdigest()


def _spelled(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame, parts: int = 20) -> DataFrame:
    """conv_id, turn, role, text after damage, by crc32(`conv_id:turn`) % parts; rows that are dropped stay with a null role.

    Nulls count as one space. 0 drops a row, 1 empties its text, 2 takes the ends of its sentences, 3 gives it twice,
    4 makes it the user's. Rows decide by themselves, repeated ones alike.
    """
    kind = F.crc32(F.concat(_spelled("conv_id"), F.lit(":"), _spelled("turn")).cast("binary")) % parts
    source = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _spelled("role").alias("role"), _spelled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).when(F.col("kind") != 0, F.col("text"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return source.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """The rows with their first fault: blank, duplicate, truncated, or none.

    The window's rows lie in the partition of their conversation already, so this shuffles by conv_id once.
    """
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    seen = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(seen == "", "blank").when(F.col("earlier") > 1, "duplicate").when(~seen.isin(*ENDS), "truncated").otherwise("")
    return rows.repartition("conv_id").select("conv_id", "turn", "role", "text", earlier.alias("earlier")).withColumn("fault", fault)


def repair(rows: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Each conversation's faults and cheapest repair, from rows (conv_id, turn, role, text).

    Rows of one conversation are taken by turn, nulls first, then by role and text; a null id is one conversation. A
    row of null role only names its conversation, which has no rows if it has no others: zeros, an empty audit
    and the hash of the empty string. Further columns are passed by. An empty table gives none.
    """
    ordered = faults(rows).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "earlier")
    names = [x.split(" ")[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, current = None, None
        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "fault")), strict=True):
                if current is None or conv_id != conv:
                    if current is not None:
                        done.append((conv, *current.result()))
                    conv, current = conv_id, Repair(block)
                if role is not None:
                    current.add(turn, Row(role, text, fault))
            if len(done) >= 1024:
                yield _records(done, names)
                done = []
        if current is not None:
            done.append((conv, *current.result()))
        if done:
            yield _records(done, names)

    return ordered.mapInArrow(common.resting(run), COLUMNS)


def _records(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

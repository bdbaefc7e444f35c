"""What the training-data operators share: scratch tables, folds and Arrow plumbing.

Conventions that hold for every operator of this subpackage unless its docstring says otherwise:

* only the columns that an operator names are read, so extra or clashing columns pass by;
* every row is treated by itself: repeated rows and repeated ids give repeated result rows;
* a null text counts as an empty one, a null id stays null and belongs to no fold.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.sources.scratch import scratch, scratch_path, shared_dir  # noqa: F401

#: Bytes of text that one vectorised step handles at a time; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20
#: So many ids, of some 30 bytes in a hash table, are broadcast at most.
BROADCAST_IDS = 1_000_000


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def is_fold(id_col: str, n: int, k: int) -> Column:
    """Whether the id is in fold k of n; false for a null id."""
    return F.coalesce(fold(id_col, n) == k, F.lit(False))


def outside_fold(id_col: str, n: int, k: int) -> Column:
    """Whether the id is in another fold than k of n; false for a null id."""
    return F.coalesce(fold(id_col, n) != k, F.lit(False))


def text_hashes(text_col: str = "text") -> tuple[Column, Column]:
    """128 bits of a text's hash; null has one too."""
    return F.xxhash64(F.lit(1), F.col(text_col).cast("binary")), F.xxhash64(F.lit(2), F.col(text_col).cast("binary"))


def by_row(docs: DataFrame, rows: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text are (left_semi), or aren't (left_anti), among `rows` (doc_id, h1, h2); null equals null.

    The rows are broadcast if they are few enough, else both sides are shuffled.
    """
    side = scratch(rows.select(F.col("doc_id").alias("__id"), F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct(), "rows")
    side = F.broadcast(side) if side.count() <= BROADCAST_IDS else side
    h1, h2 = text_hashes(text_col)
    return docs.join(side, docs[id_col].cast("long").eqNullSafe(side["__id"]) & (h1 == side["__h1"]) & (h2 == side["__h2"]), how)


def give_back() -> None:
    """Return freed memory to the system, as a worker lives on after its task and shares a machine with others."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a libc without it
        ctypes.CDLL(None).malloc_trim(0)


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same map over batches, with memory given back after a task's last."""

    @wraps(run)
    def rested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rested


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run inside gets Arrow batches of about so many bytes, which JVM and workers hold whole beside what they make of them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bound_batches(spark: SparkSession, size: int = SLICE_BYTES) -> None:
    """From here on the session's Arrow batches have about so many bytes, or fewer if it has so set.

    For maps whose table is returned and runs later, as those take batches as the session has them then; nothing puts it back.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if most <= 0 or most > size:
        spark.conf.set(name, str(size))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `limit` bytes together, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def arrow_binary(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column whose row i is the bytes of values[starts[i]:starts[i + 1]]."""
    offsets = pa.py_buffer((starts * values.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values).tobytes())])

"""Packing by power-of-two decomposition: every piece of a document is a sequence of binary length.

A document of n ids is cut at the binary digits of n: as many whole sequences of the largest length
as fit, then one piece for each set bit of the rest, longest first. A piece fills its sequence, so
nothing is padded, no sequence crosses documents, and sequences of one length form a bucket from
which batches of equal shape are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def decompose(counts: np.ndarray, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents of so many ids, in order: each one's document, start and binary length, longest first."""
    bits = largest >> 1 >> np.arange(largest.bit_length() - 1)  # the lengths below the largest, falling
    has = (counts[:, None] & bits) > 0
    whole = counts // largest
    per_row = whole + has.sum(1)
    rows = np.repeat(np.arange(len(counts)), per_row)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    size = np.full(len(rows), largest, np.int64)
    size[nth >= whole[rows]] = np.broadcast_to(bits, has.shape)[has]
    stops = np.cumsum(size)
    before = np.repeat(np.cumsum(counts) - counts, per_row)
    return rows, stops - size - before, size


def pack(docs: DataFrame, tokenizer: str, end_id: int, largest: int = 2048, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and, if wanted, ids.

    `largest` is a power of two. A null text is one piece, the end id; so is an empty one. Repeated
    rows are packed each by itself; an empty table gives no rows. `bucket` is log2 of the length.
    Sequence ids are the task's number times 2**33 plus a count, unique without a shuffle.
    """
    if largest < 1 or largest & (largest - 1):
        raise ValueError("the largest length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, next_id = tokens.encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in common.text_slices(batch, "text", tokens.SLICE_BYTES):
                ids, counts = encoder.encode(part.column("text"), end_id)
                rows, start, size = decompose(counts, largest)
                stops, n = np.cumsum(size), len(size)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stops - size).tolist(), stops.tolist(), strict=True)]
                columns = [
                    part.column("doc_id").take(pa.array(rows)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(counts[rows]),
                    pa.array(np.arange(next_id, next_id + n)), pa.array(np.zeros(n, np.int64)), pa.array(np.log2(size).round().astype(np.int32)),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids.view(np.int32))))
                    names.append("ids")
                next_id += n
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(common.resting(run), SCHEMA + ", ids array<int>" * with_ids)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences, with their ids, into a folder for each length, of which batches of equal shape are read."""
    packed.write.partitionBy("bucket").option("compression", "zstd").parquet(path)


def read_bucket(spark, path: str, length: int) -> DataFrame:
    """The sequences of one length; the folders of other lengths aren't read."""
    return spark.read.parquet(path).where(F.col("bucket") == length.bit_length() - 1)

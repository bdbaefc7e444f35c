"""Token-ID output: ORC files whose integer columns are run-length encoded, read back by stripe.

ORC's writer encodes the id lists as RLE v2 integers, keeps a row index every `stride` rows and a
Bloom filter on the document id, so a reader takes stripes in parallel and a lookup of one document
skips the stripes and row groups whose statistics or filter exclude it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Bytes of an ORC stripe, the unit that readers take in parallel.
STRIPE_BYTES = 16 << 20
#: Rows to an entry of the row index, and so to a Bloom filter.
INDEX_STRIDE = 1_000
#: The Bloom filters' rate of false positives.
BLOOM_FPP = 0.01


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pos = tokens.encoder(path), 0
        for batch in batches:
            for part in common.text_slices(batch, "text", tokens.SLICE_BYTES):
                ids, counts = encoder.encode(part.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.view(np.int32)))
                places = pa.array(np.arange(pos, pos + len(counts)))
                pos += len(counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), places, pa.array(counts), lists], ["doc_id", "pos", "n_tokens", "ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append `end_id` and write the ids in ascending order of the document id.

    A null text gives the end id alone; null ids come first; rows of one id keep any order among
    themselves, as long as the files hold it. An empty table gives files without rows. The text, which
    is smaller than its ids, is what the range exchange moves; rows of one id that outgrow a task are
    dealt over several adjacent parts by a hash of their text. `part` numbers the parts in order.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = sized.repartitionByRange(*order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = dealt.mapInArrow(common.resting(_encode(tokenizer, end_id)), "doc_id long, pos long, n_tokens long, ids array<int>")
    (
        rows.withColumn("part", F.spark_partition_id())
        .write.option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written: part int, pos long (in the part), doc_id long, n_tokens long, ids array<int>."""
    return spark.read.schema("doc_id long, pos long, n_tokens long, ids array<int>, part int").orc(path)


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """One document's rows; the filter reaches the stripes' statistics and Bloom filters."""
    return read(spark, path).where(F.col("doc_id") == doc_id)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), batch.column("pos")], ["part", "doc_id", "n_tokens", "ids_crc32", "pos"])


def index(spark: SparkSession, path: str) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 long.

    Only counts and checksums are shuffled. Each part's total goes to its rows through a running
    sum over parts (as many rows as parts); within a part, which the range exchange has bounded,
    a window sums in order.
    """
    digest = read(spark, path).select("part", "doc_id", "pos", "ids").mapInArrow(common.resting(_digest), "part int, doc_id long, n_tokens long, ids_crc32 long, pos long")
    rows = common.scratch(digest, "digests")  # read twice, so that the files are read once
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("inner")).cast("long").alias("start"), "n_tokens", "ids_crc32")
    )

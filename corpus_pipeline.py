"""The corpus pipeline: documents by way of five of the training-data operators to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of documents, and any
further ones. An empty table passes through all stages. Long texts are taken whole. A stage sets the session's Arrow
batches to 4 MB, unless they are smaller, and leaves them so: its table runs after it has returned, and batches as Spark
makes them otherwise lie whole in the JVM and in each Python worker.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.llm import common, decontamination, language, minhash, packing, pii


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, no letter, or ambiguous by the decoder and not borne out by their column; a null language is filled in.

    Each row decides for itself, repeated ones too. Without any language to learn from none is filled in.
    """
    common.bound_batches(spark)
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, that with the smallest id; null ids come last.

    Of repeated rows one stays. Texts without words, null among them, are in no group and stay.
    """
    common.bound_batches(spark)
    return minhash.deduplicate(docs, percent=85)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth of the words lie in passages of the benchmark.

    Rows decide by id and text, so rows of one id, or of none, don't decide for each other. Null texts stay, and
    all rows do if the benchmark is empty.
    """
    common.bound_batches(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind and n_chars follows; every row stays, null texts as they are."""
    common.bound_batches(spark)
    redacted = pii.redact_column(docs, "text")
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary length, none across documents; a null text is its end alone, repeated rows are packed each."""
    common.bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
    return docs

"""Cutting texts into overlapping windows, and counting the pieces. All in built-in expressions, without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.config import ChunkConfig
from codexmill.functions import text as T

#: Texts with fewer characters, stripped, aren't chunked.
MIN_CHARS = 50


def _starts(n: Column, step: int) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def windows(units: Column, size: int, overlap: int, joined_by: str) -> Column:
    """Slices of `size` units, each beginning size - overlap after the one before, to the last unit; blank ones are left out."""
    cut = lambda u: F.transform(_starts(F.size(u), size - overlap), lambda i: F.array_join(F.slice(u, i + 1, size), joined_by))
    return F.filter(T.bound(units, cut), T.not_blank)


def char_windows(text: Column, size: int, overlap: int) -> Column:
    """The same of characters. Windows begin and end at multiples of one length, of which the text is cut once."""
    step = math.gcd(size, overlap)
    runs = F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{step}}})"), 1)
    return windows(runs, size // step, overlap // step, "")


def pieces(text: Column, config: ChunkConfig) -> Column:
    """The windows of a text by a configuration's unit.

    Words lie between white space; sentences end with a full stop; passages are parted by blank lines, pages
    by form feeds; tokens are words and single marks. A null text has none.
    """
    size, overlap = config.chunk_size, config.chunk_overlap
    if config.split_by == "word":
        return windows(T.words(text), size, overlap, " ")
    if config.split_by == "sentence":
        return windows(F.split(text, r"\."), size, overlap, ".")
    if config.split_by == "char":
        return char_windows(text, size, overlap)
    if config.split_by == "passage":
        return windows(F.filter(F.split(text, r"\n\s*\n"), T.not_blank), size, overlap, "\n\n")
    if config.split_by == "page":
        return windows(F.split(text, "\f"), size, overlap, "\f")
    return windows(F.regexp_extract_all(text, F.lit(r"(\w+|[^\w\s])"), 1), size, overlap, " ")


def split_code(code: Column, limit: int = 1000, overlap: int = 100) -> Column:
    """Windows of `limit` words, ending with the one that reaches the end; a text within the limit stays as it is."""
    held = min(overlap, limit - 1)
    step = max(1, limit - held)

    def cut(parts: Column) -> Column:
        n = F.size(parts)
        starts = F.sequence(F.lit(0), F.greatest(n - 1 - held, F.lit(0)), F.lit(step))
        return F.when(n > limit, F.transform(starts, lambda i: F.array_join(F.slice(parts, i + 1, limit), " ")))

    return F.coalesce(T.bound(T.words(code), cut), F.array(code))


def eligible(path: Column, size: Column, config: ChunkConfig) -> Column:
    """Whether a file is chunked: small enough, not excluded, and of a wanted extension if some are named.

    An excluding pattern with a dot in front must end the name; another may stand anywhere in the path.
    """
    name = T.base_name(path)
    ok = size <= F.lit(int(config.max_file_size_mb * 1024 * 1024))
    for pattern in config.exclude_patterns or ():
        ok = ok & ~(F.endswith(name, F.lit(pattern)) if pattern.startswith(".") else F.contains(path, F.lit(pattern)))
    if config.include_extensions is not None:
        wanted = sorted({x.lower() for x in config.include_extensions})
        ok = ok & (F.lower(T.extension(path)).isin(wanted) | name.isin(list(config.include_extensions)))
    return F.coalesce(ok, F.lit(False))


def long_enough(text: Column) -> Column:
    return F.coalesce(F.length(T.strip(text)) >= MIN_CHARS, F.lit(False))


def chunk_files(files: DataFrame, config: ChunkConfig) -> DataFrame:
    """doc_chunks of files (path, size, text): eligible ones of some length, cleaned first in long-text mode.

    chunk_size counts words in word mode, else characters. chunk_id is the path's and order's hash.
    """
    config = config.floored()
    kept = files.where(eligible(F.col("path"), F.col("size"), config)).where(long_enough(F.col("text")))

    def cut(text: Column) -> Column:
        return pieces(T.clean_long_text(text) if config.long_text_mode else text, config)

    out = kept.select("path", "size", F.posexplode(T.bound(T.strip(F.col("text")), cut)).alias("chunk_order", "chunk_text"))
    measure = T.word_count(F.col("chunk_text")) if config.split_by == "word" else F.length("chunk_text")
    doc = F.substring(F.sha2("path", 256), 1, 16)
    return out.select(
        F.concat_ws("_", doc, F.lit("chunk"), "chunk_order").alias("chunk_id"), F.col("path").alias("original_file"), "chunk_text", doc.alias("parent_doc_id"), "chunk_order", measure.cast("int").alias("chunk_size"),
        F.struct(T.base_name(F.col("path")).alias("file_name"), F.col("path").alias("file_path"), F.col("size").cast("long").alias("file_size"), T.extension(F.col("path")).alias("file_extension")).alias("metadata"),
    )


def split_chunks(chunks: DataFrame, limit: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks whose code is over the limit fan out; the parent's id is the node's with eight digits of a hash of both."""
    parent = F.concat_ws(":", "node_id", F.substring(F.sha2(F.concat("node_id", "code"), 256), 1, 8))
    wide = chunks.withColumn("parts", split_code(F.col("code"), limit, overlap)).withColumn("parent", parent)
    several = F.size("parts") > 1
    fanned = wide.select("*", F.posexplode("parts").alias("at", "part"))
    changes = {
        "code": F.col("part"), "chunk_order": F.when(several, F.col("at")).otherwise(F.col("chunk_order")),
        "parent_doc_id": F.when(several, F.col("parent")).otherwise(F.col("parent_doc_id")), "chunk_id": F.when(several, F.concat(F.col("parent"), F.lit("_chunk_"), F.col("at"))).otherwise(F.col("chunk_id")),
    }
    return fanned.withColumns(changes).select(chunks.columns)


def statistics(chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, total_size, avg_chunk_size; zeros for no chunk."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).alias("total_size"), F.coalesce(F.avg("chunk_size"), F.lit(0.0)).alias("avg_chunk_size"))


def per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("original_file").agg(F.count("*").alias("n"))


def per_extension(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("metadata.file_extension").alias("ext")).agg(F.count("*").alias("n")).orderBy("ext")


def top_files(chunks: DataFrame, n: int = 10) -> DataFrame:
    return per_file(chunks).orderBy(F.desc("n"), "original_file").limit(n)


def of_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("original_file") == path)


def samples(chunks: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
    """The first chunks by file and order, with the beginning of their text."""
    return chunks.orderBy("original_file", "chunk_order").limit(n).select("chunk_id", "original_file", "chunk_order", "chunk_size", F.substring("chunk_text", 1, chars).alias("preview"))

"""The driver's tables as the engine's: documents as files, orders and parts as a graph, suppliers as functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path (source/doc_id.lang), size, text, lang."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws("", "source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"), F.col("n_chars").alias("size"), "text", "lang")


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that follow one another in an order: src, dst (longs), each pair once, no self-loops."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return pairs.where("dst IS NOT NULL AND src <> dst").distinct()


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_edges as CALLS between node ids; seq and pos, the two parts' keys, order a node's edges by the other part."""
    return part_edges(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("CALLS").alias("relation"), F.col("src").alias("seq"), F.col("dst").cast("int").alias("pos"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as functions: class is the nation or region.nation, the file the region, the key line and order."""
    s, n, r = (table(spark, sf_dir, x) for x in ("supplier", "nation", "region"))
    key = F.col("s_suppkey")
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    cls = F.when(key % 2 == 0, F.col("n_name")).otherwise(F.concat_ws(".", "r_name", "n_name"))
    short = F.when(key % 10 == 1, F.concat(F.lit("u"), key)).otherwise(F.concat(F.lit("m"), key % 4))
    return joined.select(
        key.alias("seq"), F.concat_ws(".", cls, short).alias("name"), F.col("r_name").alias("file_path"), cls.alias("contract_name"), key.cast("int").alias("line_number"), key.cast("int").alias("start_line"),
        F.concat(F.lit("body of "), short).alias("content"), F.when(key % 3 == 0, "private").otherwise("public").alias("visibility"), F.array(F.lit("view"), F.lit("virtual")).alias("modifiers"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call per customer: call_id, src (the caller's key), call."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    total = table(spark, sf_dir, "supplier").agg(F.count("*").alias("total"))
    named = functions(spark, sf_dir).select(F.col("seq").alias("other"), F.col("name").alias("other_name"))
    k = F.col("c_custkey")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).crossJoin(F.broadcast(total)).withColumn("other", (k * 7) % F.col("total")).join(named, "other")
    sixth = F.floor(k / 6) % 4
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("self.m"), sixth)).when(k % 6 == 1, F.concat(F.col("n_name"), F.lit(".m"), sixth)).when(k % 6 == 2, F.concat(F.lit("m"), F.floor(k / 7) % 4))
        .when(k % 6 == 3, F.col("other_name")).when(k % 6 == 4, F.concat(F.lit("ext"), k % 4)).otherwise(F.concat(F.lit("u"), (k * 10) % F.col("total") + 1))
    )
    return rows.select(k.alias("call_id"), (k % F.col("total")).alias("src"), text.alias("call"))


def functions_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as functions with their calls in order of the customers."""
    made = calls(spark, sf_dir).groupBy(F.col("src").alias("seq")).agg(F.transform(F.array_sort(F.collect_list(F.struct("call_id", "call"))), lambda x: x["call"]).alias("calls"))
    return functions(spark, sf_dir).join(made, "seq", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<string>")))


def traders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, parts and suppliers as functions: name."""
    named = lambda name, key, mark: table(spark, sf_dir, name).select(F.concat(F.lit(mark), key).alias("name"))
    return named("customer", "c_custkey", "c").union(named("part", "p_partkey", "p")).union(named("supplier", "s_suppkey", "s"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller, callee: a customer and the parts of its orders, a part and its suppliers."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    part = F.concat(F.lit("p"), "l_partkey")
    bought = lines.join(orders, "l_orderkey").select(F.concat(F.lit("c"), "o_custkey").alias("caller"), part.alias("callee"))
    return bought.union(lines.select(part, F.concat(F.lit("s"), "l_suppkey"))).distinct()

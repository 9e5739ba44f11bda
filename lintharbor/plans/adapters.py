"""Deterministic projections of the driver's tables onto the domain's schemas, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("tool"), F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("file"), (F.col("event_id") % 250).cast("int").alias("line"),
        F.concat(F.lit("v"), (F.floor("value").cast("int") % 10).cast("string")).alias("vuln"),
    )


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("func_ord"), F.col("p_brand").alias("file"), F.concat(F.lit("f"), key.cast("string")).alias("name"), (key % 200 + 1).alias("start"), (key % 200 + 1 + F.col("p_size")).alias("end"),
        F.col("p_size").cast("long").alias("loc"), (F.col("p_type") != "PROMO").alias("reachable"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of eight lines."""
    rows = functions(spark, sf_dir).select("*", F.posexplode(F.sequence(F.col("start"), F.col("end"), F.lit(8).cast("long"))).alias("block_ord", "block_start"))
    rows = rows.withColumn("block_end", F.least(F.col("block_start") + 7, F.col("end")))
    return rows.withColumn("block_id", F.col("func_ord") * 100 + F.col("block_ord")).withColumn("block_loc", F.col("block_end") - F.col("block_start") + 1)


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("exec_id"), F.col("l_partkey").cast("int").alias("edge"))
    return rows.agg(F.least(F.sum(F.floor("l_quantity")), F.lit(255)).cast("int").alias("cnt"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("seed_id"), (F.floor("o_totalprice") % 997 + 1).alias("len"), (F.col("o_custkey") + 1).alias("exec_us"), (k % 500 + 1).alias("bitmap_size"), (F.col("o_custkey") % 6).cast("int").alias("handicap"),
        (k % 30).cast("int").alias("depth"), (k % 40 - 1).cast("double").alias("distance"), (k % 3 == 0).alias("favored"),
    )


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash per conversation, of three sanitizers and two types."""
    frame = F.struct(F.col("turn").cast("int").alias("id"), F.lower(F.substring("text", 1, 1)).alias("file"), F.col("role").alias("function"), (F.length("text") % 50).alias("line"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(frame)).alias("stack_trace"))
    sanitizer = F.when(F.col("conv_id") % 3 == 0, "addresssanitizer").when(F.col("conv_id") % 3 == 1, "leaksanitizer").otherwise("memorysanitizer")
    return rows.select(F.concat(F.lit("/c/"), F.col("conv_id").cast("string")).alias("input_file"), sanitizer.alias("sanitizer"), F.when(F.col("conv_id") % 2 == 0, "segv").otherwise("uaf").alias("vuln_type"), "stack_trace")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree over the parts, with further edges that make second paths and cycles."""
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).filter("k > 1")
    tree = p.select(F.floor(k / 2).alias("src"), k.alias("dst"))
    back, second = p.filter("k % 5 = 0").select(k.alias("src"), (k * 31 % 150 + 1).alias("dst")), p.filter("k % 7 = 0").select((F.floor(k / 3) + 1).alias("src"), k.alias("dst"))
    return tree.unionByName(back).unionByName(second).distinct()


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operand pairs of conditions per execution."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).cast("int").alias("cnd_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("exec_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_returnflag") == "R").alias("outcome"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A campaign per user: counters that move at some of its events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("campaign"), "event_id", "ts", F.count("*").over(w).alias("execs"), F.sum((F.col("value") > 50).cast("long")).over(w).alias("paths"), F.sum((F.col("value") > 95).cast("long")).over(w).alias("crashes"))
    return rows


FLAGS_SQL = "flags AS (SELECT DISTINCT event_type AS tool, 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS file, CAST(event_id % 250 AS INTEGER) AS line, 'v' || CAST(CAST(floor(value) AS INTEGER) % 10 AS VARCHAR) AS vuln FROM events)"
FUNCTIONS_SQL = "functions AS (SELECT p_partkey AS func_ord, p_brand AS file, p_partkey % 200 + 1 AS s, p_partkey % 200 + 1 + p_size AS e, CAST(p_size AS BIGINT) AS loc, p_type <> 'PROMO' AS reachable FROM part)"
BLOCKS_SQL = FUNCTIONS_SQL + ", blocks AS (SELECT func_ord, file, loc, b AS bs, least(b + 7, e) AS be, least(b + 7, e) - b + 1 AS bloc FROM (SELECT *, unnest(range(s, e + 1, 8)) AS b FROM functions))"
TRACE_SQL = "trace AS (SELECT l_orderkey AS exec_id, CAST(l_partkey AS INTEGER) AS edge, CAST(least(sum(CAST(floor(l_quantity) AS BIGINT)), 255) AS INTEGER) AS cnt FROM lineitem GROUP BY 1, 2)"
BUCKET_SQL = "CASE WHEN cnt < 1 THEN 0 WHEN cnt < 2 THEN 1 WHEN cnt < 3 THEN 2 WHEN cnt < 4 THEN 4 WHEN cnt < 8 THEN 8 WHEN cnt < 16 THEN 16 WHEN cnt < 32 THEN 32 WHEN cnt < 128 THEN 64 ELSE 128 END"
SEEDS_SQL = "seeds AS (SELECT o_orderkey AS seed_id, CAST(floor(o_totalprice) AS BIGINT) % 997 + 1 AS len, o_custkey + 1 AS exec_us, o_orderkey % 500 + 1 AS bitmap_size, o_custkey % 6 AS handicap, o_orderkey % 30 AS depth, CAST(o_orderkey % 40 - 1 AS DOUBLE) AS distance, o_orderkey % 3 = 0 AS favored FROM orders)"
CRASHES_SQL = "crashes AS (SELECT '/c/' || CAST(conv_id AS VARCHAR) AS input_file, CASE conv_id % 3 WHEN 0 THEN 'addresssanitizer' WHEN 1 THEN 'leaksanitizer' ELSE 'memorysanitizer' END AS sanitizer, CASE conv_id % 2 WHEN 0 THEN 'segv' ELSE 'uaf' END AS vuln_type, list({'id': CAST(turn AS INTEGER), 'file': lower(substr(text, 1, 1)), 'function': role, 'line': CAST(length(text) % 50 AS INTEGER)} ORDER BY CAST(turn AS INTEGER), lower(substr(text, 1, 1)), role, length(text) % 50) AS t FROM conversations GROUP BY conv_id)"
EDGES_SQL = "edges AS (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey * 31 % 150 + 1 FROM part WHERE p_partkey > 1 AND p_partkey % 5 = 0 UNION SELECT p_partkey // 3 + 1, p_partkey FROM part WHERE p_partkey > 1 AND p_partkey % 7 = 0)"
CONDITIONS_SQL = "conditions AS (SELECT CAST(l_partkey % 100 AS INTEGER) AS cnd_id, l_orderkey * 10 + l_linenumber AS exec_id, l_partkey AS a, l_suppkey AS b, l_returnflag = 'R' AS outcome FROM lineitem)"
SERIES_SQL = "series AS (SELECT user_id AS campaign, event_id, ts, count(*) OVER w AS execs, CAST(sum(CAST(value > 50 AS BIGINT)) OVER w AS BIGINT) AS paths, CAST(sum(CAST(value > 95 AS BIGINT)) OVER w AS BIGINT) AS crashes FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"

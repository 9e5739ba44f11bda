"""Registered queries of further operators over the adapted tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basename, difficulty_factor, edge_only, first_and_last_difference, linear_cycle_interval, raw_distance, simplified
from ..operators import coverage, directed, findings, graph
from . import adapters as A
from .adapters import BUCKET_SQL, CONDITIONS_SQL, EDGES_SQL, SEEDS_SQL, TRACE_SQL
from .queries import QUERIES, SQL, query


@query(
    """WITH lines AS (SELECT l_returnflag AS file, CAST(l_partkey % 50 AS INTEGER) AS function, CAST(l_suppkey % 200 AS INTEGER) AS block_id, CAST(l_orderkey % 500 AS INTEGER) AS line FROM lineitem),
f AS (SELECT file, function, CASE WHEN function % 13 > 0 THEN function * 7 % 300 END AS first FROM (SELECT DISTINCT file, function FROM lines))
SELECT file, function, block_id, min(line) AS start, max(line) AS "end", count(DISTINCT line) AS loc FROM lines JOIN f USING (file, function) WHERE line > 0 AND line >= first GROUP BY 1, 2, 3"""
)
def line_statistics(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("file"), (F.col("l_partkey") % 50).cast("int").alias("function"), (F.col("l_suppkey") % 200).cast("int").alias("block_id"), (F.col("l_orderkey") % 500).cast("int").alias("line"))
    functions = lines.select("file", "function").distinct().withColumn("first", F.when(F.col("function") % 13 > 0, F.col("function") * 7 % 300))
    return findings.line_statistics(lines, functions)


@query("SELECT p_partkey, '/a/' || p_brand AS path, p_brand AS base, least(p_size / CAST(5 AS DOUBLE) + 1, 1.0) AS difficulty, CASE WHEN p_size % 4 = 1 THEN 1.0 ELSE p_size % 4 * CAST(0.5 AS DOUBLE) END AS raw, CAST(p_size > 3 AS INTEGER) AS edge, CASE WHEN p_size > 3 THEN 128 ELSE 1 END AS simple, 3600 + p_size AS cycle FROM part")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    p, size = A.table(spark, d, "part"), F.col("p_size")
    path, n = F.concat(F.lit("/a/"), "p_brand"), F.when(size > 3, size).otherwise(0)
    return p.select("p_partkey", path.alias("path"), basename(path).alias("base"), difficulty_factor(size).alias("difficulty"), raw_distance(size % 4 / 200).alias("raw"), edge_only(n).alias("edge"), simplified(n).alias("simple"), linear_cycle_interval(F.lit(3600), size).alias("cycle"))


@query(
    """WITH a AS (SELECT l_orderkey, list(l_partkey % 4 ORDER BY l_linenumber, l_partkey % 4, l_suppkey % 4) AS x, list(l_suppkey % 4 ORDER BY l_linenumber, l_partkey % 4, l_suppkey % 4) AS y FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey, list_filter(range(len(x)), lambda i: x[i + 1] <> y[i + 1]) AS ends FROM a) SELECT l_orderkey, CAST(coalesce(list_min(ends), -1) AS INTEGER) AS first, CAST(coalesce(list_max(ends), -1) AS INTEGER) AS last FROM b"""
)
def difference_ends(spark: SparkSession, d: str) -> DataFrame:
    row = F.struct("l_linenumber", (F.col("l_partkey") % 4).alias("x"), (F.col("l_suppkey") % 4).alias("y"))
    rows = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return rows.select("l_orderkey", first_and_last_difference(F.transform("r", lambda r: r["x"]), F.transform("r", lambda r: r["y"])).alias("z")).select("l_orderkey", "z.first", "z.last")


_CALLS = "calls AS (SELECT p_partkey AS node, CAST(p_size % 7 AS BIGINT) AS callee, 0 AS ordinal FROM part WHERE p_partkey % 53 = 0 UNION ALL SELECT p_partkey, CAST(p_partkey % 11 AS BIGINT), 1 FROM part WHERE p_partkey % 53 = 0), fd AS (SELECT i AS node, 1 + i % 4 * CAST(0.5 AS DOUBLE) AS distance FROM range(0, 9) r(i))"
_NEAREST = "nearest AS (SELECT node, callee, distance FROM (SELECT c.node, c.callee, 10 * fd.distance AS distance, row_number() OVER (PARTITION BY c.node ORDER BY fd.distance, c.ordinal, c.callee) AS k FROM calls c JOIN fd ON fd.node = c.callee) WHERE k = 1)"
_HOPS = "hops(source, node, dist) AS (SELECT node, node, 0 FROM given UNION SELECT h.source, e.src, h.dist + 1 FROM hops h JOIN edges e ON e.dst = h.node WHERE h.dist < 60)"


def _calls(spark, d) -> tuple[DataFrame, DataFrame]:
    p = A.table(spark, d, "part").filter("p_partkey % 53 = 0")
    calls = p.select(F.col("p_partkey").alias("node"), (F.col("p_size") % 7).cast("long").alias("callee"), F.lit(0).alias("ordinal")).unionByName(p.select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % 11).alias("callee"), F.lit(1).alias("ordinal")))
    return calls, spark.range(9).select(F.col("id").alias("node"), (1 + F.col("id") % 4 * 0.5).alias("distance"))


@query(f"WITH {_CALLS}, {_NEAREST} SELECT * FROM nearest")
def nearest_callees(spark: SparkSession, d: str) -> DataFrame:
    return graph.nearest_callees(*_calls(spark, d))


def _targets(spark, d) -> DataFrame:
    return A.table(spark, d, "part").filter("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node"))


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, {_CALLS}, {_NEAREST}, given AS (SELECT p_partkey AS node, CAST(0 AS DOUBLE) AS base FROM part WHERE p_partkey % 97 = 0 UNION ALL SELECT node, distance FROM nearest WHERE node % 97 <> 0),
{_HOPS}, least_hops AS (SELECT source, node, min(dist) AS dist FROM hops WHERE node NOT IN (SELECT node FROM given) GROUP BY 1, 2)
SELECT node, round(base, 9) AS distance FROM given UNION ALL SELECT h.node, round(1 / sum(1 / (h.dist + g.base)), 9) FROM least_hops h JOIN given g ON g.node = h.source GROUP BY 1"""
)
def block_distances(spark: SparkSession, d: str) -> DataFrame:
    return graph.block_distances(A.edges(spark, d), _targets(spark, d), graph.nearest_callees(*_calls(spark, d))).select("node", F.round("distance", 9).alias("distance"))


_COST = "cost AS (SELECT 't' || CAST(s AS VARCHAR) AS target, i AS callee, CAST(10 * (1 + (i + s) % 5) AS DOUBLE) AS cost FROM range(0, 9) r(i), range(0, 3) q(s))"


@query(
    f"""WITH RECURSIVE {EDGES_SQL}, {_CALLS}, {_NEAREST}, {_COST}, plain AS (SELECT p_partkey AS node, CAST(p_partkey AS VARCHAR) AS target FROM part WHERE p_partkey % 97 = 0 AND p_partkey NOT IN (SELECT node FROM nearest)),
given AS (SELECT * FROM plain UNION ALL SELECT node, 'call:' || CAST(node AS VARCHAR) FROM nearest), {_HOPS}
SELECT h.node, g.target, CAST(min(h.dist) AS DOUBLE) AS dist FROM hops h JOIN given g ON g.node = h.source WHERE h.node NOT IN (SELECT node FROM given) GROUP BY 1, 2
UNION ALL SELECT node, target, 0 FROM plain UNION ALL SELECT n.node, c.target, c.cost FROM nearest n JOIN cost c USING (callee)"""
)
def block_target_distances(spark: SparkSession, d: str) -> DataFrame:
    calls, known = _calls(spark, d)
    pairs = spark.range(27).select(F.expr("id % 9").alias("i"), F.expr("id div 9").alias("s"))
    cost = pairs.select(F.concat(F.lit("t"), F.col("s").cast("string")).alias("source"), F.col("i").alias("node"), (10 * (1 + (F.col("i") + F.col("s")) % 5)).alias("cost"))
    return graph.block_target_distances(A.edges(spark, d), _targets(spark, d).select(F.col("node").alias("target"), "node"), calls, cost, "parity", known)


@query(
    f"""WITH {SEEDS_SQL}, s AS (SELECT *, seed_id % 7 AS campaign, seed_id % 5 = 0 AS was_fuzzed FROM seeds), p AS (SELECT campaign, bool_or(favored AND NOT was_fuzzed) AS pending, count(*) AS n FROM s GROUP BY 1)
SELECT seed_id, CASE WHEN pending THEN CASE WHEN was_fuzzed OR NOT favored THEN 99 ELSE 0 END WHEN favored OR n <= 10 THEN 0 WHEN NOT was_fuzzed THEN 75 ELSE 95 END AS skip_percent FROM s JOIN p USING (campaign)"""
)
def skip_probability(spark: SparkSession, d: str) -> DataFrame:
    s = A.seeds(spark, d).select("seed_id", "favored", (F.col("seed_id") % 7).alias("campaign"), (F.col("seed_id") % 5 == 0).alias("was_fuzzed"))
    return directed.skip_probability(s).select("seed_id", "skip_percent")


@query("SELECT DISTINCT l_orderkey AS seed_id FROM lineitem WHERE l_partkey % 40 IN (SELECT i FROM range(0, 40, 3) r(i))")
def rare_target_seeds(spark: SparkSession, d: str) -> DataFrame:
    hits = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seed_id"), (F.col("l_partkey") % 40).alias("target_id"))
    return directed.rare_target_seeds(hits, spark.range(40).select(F.col("id").alias("target_id"), F.when(F.col("id") % 3 == 0, "active").otherwise("paused").alias("state")))


@query("WITH c AS (SELECT p_partkey % 300 AS block, CAST(p_size AS INTEGER) AS cnd_id, p_partkey AS ordinal FROM part WHERE p_partkey % 4 > 0), l AS (SELECT block, max_by(cnd_id, ordinal) AS cnd_id FROM c GROUP BY 1) SELECT b.block, coalesce(cnd_id, 0) AS cnd_id FROM (SELECT DISTINCT p_partkey % 500 AS block FROM part) b LEFT JOIN l USING (block)")
def block_conditions(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    records = p.filter("p_partkey % 4 > 0").select((F.col("p_partkey") % 300).alias("cbb_id"), F.col("p_size").cast("int").alias("cnd_id"), F.col("p_partkey").alias("ordinal"))
    return directed.conditions_of(p.select((F.col("p_partkey") % 500).alias("block")).distinct(), records)


@query(
    f"""WITH {SEEDS_SQL}, found AS (SELECT CAST(event_id % 20000 AS BIGINT) AS src, CAST(user_id + 1 AS BIGINT) AS len, event_id % 2 = 0 AS is_target, event_id AS nth FROM events), top AS (SELECT max(seed_id) AS m FROM seeds)
SELECT seed_id, CAST(depth AS INTEGER) AS depth, len, CAST(1 AS BIGINT) AS n_fuzz, FALSE AS is_target FROM seeds
UNION ALL SELECT m + row_number() OVER (ORDER BY nth, src), CAST(coalesce(s.depth, 0) + 1 AS INTEGER), found.len, 1, is_target FROM found LEFT JOIN seeds s ON s.seed_id = found.src, top"""
)
def queue_append(spark: SparkSession, d: str) -> DataFrame:
    queue = A.seeds(spark, d).select("seed_id", "depth", "len", F.lit(1).cast("long").alias("n_fuzz"), F.lit(False).alias("is_target"))
    found = A.table(spark, d, "events").select((F.col("event_id") % 20000).alias("src"), (F.col("user_id") + 1).alias("len"), (F.col("event_id") % 2 == 0).alias("is_target"), F.col("event_id").alias("at"))
    return directed.append_to_queue(queue, found)


@query(
    """WITH m AS (SELECT user_id AS input_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS at, event_id % 8 AS flags FROM events)
SELECT a.input_id, a.at FROM m a JOIN m b ON b.input_id = a.input_id AND b.at BETWEEN a.at AND a.at + 1 WHERE b.flags & 2 <> 0 GROUP BY 1, 2 HAVING count(*) = 2"""
)
def mask_positions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return directed.mask_positions(A.table(spark, d, "events").select(F.col("user_id").alias("input_id"), at.alias("at"), (F.col("event_id") % 8).alias("flags")), 2, 2)


@query(
    f"""WITH {TRACE_SQL.replace("trace AS", "every AS")}, trace AS (SELECT * FROM every WHERE exec_id IN (SELECT exec_id FROM every WHERE edge % 3 = 0)),
e AS (SELECT exec_id, row_number() OVER (ORDER BY exec_id) AS pos FROM (SELECT DISTINCT exec_id FROM trace)),
h AS (SELECT edge, pos, row_number() OVER (PARTITION BY edge ORDER BY pos) AS k FROM trace JOIN e USING (exec_id) WHERE cnt > 0),
n AS (SELECT min(pos) AS pos FROM h GROUP BY edge UNION SELECT coalesce(max(CASE WHEN pos = k THEN pos END), 0) + 1 FROM h GROUP BY edge)
SELECT exec_id FROM e WHERE pos = 1 OR pos IN (SELECT pos FROM n) ORDER BY exec_id LIMIT 5000"""
)
def unique_crashes(spark: SparkSession, d: str) -> DataFrame:
    t = A.trace(spark, d)
    return coverage.unique_crashes(t, t.filter("edge % 3 = 0"))


@query(
    f"""WITH {TRACE_SQL}, {SEEDS_SQL}, {CONDITIONS_SQL}, w AS (SELECT edge % 50 AS block, seed_id, row_number() OVER (PARTITION BY edge % 50 ORDER BY distance, exec_us * len, seed_id DESC) AS k FROM trace JOIN seeds ON exec_id = seed_id),
hits AS (SELECT edge % 50 AS block, count(*) AS hits FROM trace GROUP BY 1), r AS (SELECT cnd_id, exec_id, row_number() OVER (PARTITION BY cnd_id ORDER BY 64 - bit_count(xor(a, b)) DESC, exec_id) AS k FROM conditions),
o AS (SELECT cnd_id, bit_or(CASE WHEN outcome THEN 2 ELSE 1 END) AS x FROM conditions GROUP BY 1)
SELECT seed_id FROM w JOIN hits USING (block) WHERE k = 1 AND block % 5 > 0 AND hits < 1000000 UNION SELECT exec_id FROM r JOIN o USING (cnd_id) WHERE k = 1 AND x < 3 UNION SELECT seed_id FROM seeds WHERE seed_id % 1000 = 1"""
)
def directed_favourites(spark: SparkSession, d: str) -> DataFrame:
    t, s, c = A.trace(spark, d), A.seeds(spark, d), A.conditions(spark, d)
    blocks = t.select("exec_id", (F.col("edge") % 50).alias("block"))
    solved = blocks.select("block").distinct().filter("block % 5 = 0")
    hits = blocks.groupBy("block").agg(F.count("*").alias("hits"))
    return coverage.directed_favourites(coverage.block_winners(blocks, s), hits, solved, coverage.conformance_holders(c), 1_000_000, coverage.condition_outcomes(c), s.filter("seed_id % 1000 = 1"))


@query(f"WITH {TRACE_SQL} SELECT exec_id, edge // 64 AS word, bit_or(CAST(1 AS BIGINT) << (edge % 64)) AS bits FROM (SELECT exec_id, edge FROM trace WHERE cnt > 0 AND edge % 64 < 63) GROUP BY 1, 2")
def presence_bitmap(spark: SparkSession, d: str) -> DataFrame:
    return coverage.presence_bitmap(A.trace(spark, d).filter("edge % 64 < 63"))


@query(f"WITH {TRACE_SQL}, {SEEDS_SQL} SELECT depth AS cycle, min(distance) AS min_distance, max(distance) AS max_distance FROM seeds WHERE distance > 0 GROUP BY 1")
def distance_bounds(spark: SparkSession, d: str) -> DataFrame:
    return directed.distance_bounds(A.seeds(spark, d).withColumn("cycle", F.col("depth").cast("long")))


@query(f"WITH {TRACE_SQL}, c AS (SELECT count(DISTINCT edge) AS covered, count(DISTINCT CASE WHEN edge % 9 = 0 THEN edge END) AS variable FROM trace WHERE cnt > 0) SELECT covered, variable, covered * CAST(100 AS DOUBLE) / 262144 AS coverage, 100 - variable * CAST(100 AS DOUBLE) / covered AS stability FROM c")
def map_stability(spark: SparkSession, d: str) -> DataFrame:
    t = A.trace(spark, d)
    return coverage.stability(t, t.filter("edge % 9 = 0"))


@query("SELECT hex(encode(c)) AS symbol, count(*) AS n FROM (SELECT unnest(string_split(p_brand, '')) AS c FROM part) GROUP BY 1")
def symbol_histogram(spark: SparkSession, d: str) -> DataFrame:
    return coverage.symbol_histogram(A.table(spark, d, "part").select(F.col("p_brand").cast("binary").alias("content")))


@query(f"WITH {TRACE_SQL}, {CONDITIONS_SQL}, t AS (SELECT exec_id, edge, {BUCKET_SQL} AS bucket FROM trace WHERE cnt > 0), n AS (SELECT DISTINCT exec_id FROM (SELECT exec_id, row_number() OVER (PARTITION BY edge, bucket ORDER BY exec_id) AS k FROM t) WHERE k = 1) SELECT exec_id FROM n UNION SELECT exec_id FROM (SELECT exec_id // 10 AS exec_id FROM conditions WHERE cnd_id = 7)")
def kept_executions(spark: SparkSession, d: str) -> DataFrame:
    records = A.conditions(spark, d).filter("cnd_id = 7").select(F.expr("exec_id div 10").alias("exec_id"))
    return coverage.kept(coverage.novelty(A.trace(spark, d)), records)


__all__ = ["QUERIES", "SQL"]

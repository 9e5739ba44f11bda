"""The registered queries of the engine's own operators over the adapted tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import CRITICAL_HITS, cooling, decode_trace, encode_trace, hit_bucket, hit_bucket_human, log_cycle_interval, next_p2, response_class
from ..operators import campaign, coverage, crashes, directed, findings, graph
from . import adapters as A
from .adapters import BLOCKS_SQL, BUCKET_SQL, CONDITIONS_SQL, CRASHES_SQL, EDGES_SQL, FLAGS_SQL, FUNCTIONS_SQL, SEEDS_SQL, SERIES_SQL, TRACE_SQL

QUERIES, SQL = {}, {}
GROUPED = ["tool", "file", "line", "vuln", "n_flg_lines", "n_all_lines", "n_run_tools", "n_all_tools", "score"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {FLAGS_SQL} SELECT * FROM flags")
def flags_normalise(spark: SparkSession, d: str) -> DataFrame:
    return A.flags(spark, d).dropDuplicates()


@query(f"WITH {FLAGS_SQL} SELECT * FROM flags WHERE line % 2 = 0 UNION SELECT * FROM flags WHERE line % 3 = 0")
def flags_union_distinct(spark: SparkSession, d: str) -> DataFrame:
    f = A.flags(spark, d)
    return findings.union(f.filter("line % 2 = 0"), f.filter("line % 3 = 0"))


@query(f"WITH {FLAGS_SQL} SELECT * FROM flags EXCEPT SELECT * FROM flags WHERE line % 3 = 0")
def set_remove(spark: SparkSession, d: str) -> DataFrame:
    f = A.flags(spark, d)
    return findings.remove(f, f.filter("line % 3 = 0"))


@query(
    f"""WITH {FLAGS_SQL}, above AS (SELECT * FROM flags WHERE line > 0)
SELECT NOT EXISTS (SELECT * FROM flags EXCEPT SELECT DISTINCT * FROM flags) AS same, NOT EXISTS (SELECT * FROM flags EXCEPT SELECT * FROM above) AND NOT EXISTS (SELECT * FROM above EXCEPT SELECT * FROM flags) AS other"""
)
def set_equal(spark: SparkSession, d: str) -> DataFrame:
    f = A.flags(spark, d)
    return spark.createDataFrame([(findings.equal(f, f.dropDuplicates()), findings.equal(f, f.filter("line > 0")))], "same boolean, other boolean")


@query(f"WITH {FLAGS_SQL}, {FUNCTIONS_SQL} SELECT * FROM flags f WHERE EXISTS (SELECT 1 FROM functions u WHERE u.file = f.file AND u.reachable AND f.line BETWEEN u.s AND u.e)")
def reachability_filter(spark: SparkSession, d: str) -> DataFrame:
    return findings.reachable(A.flags(spark, d).dropDuplicates(), A.functions(spark, d))


_TOTAL = "total AS (SELECT CAST(count(DISTINCT tool) AS INTEGER) AS n_all_tools FROM flags)"
_SCORE = "0.5 * CASE WHEN n_all_lines = 0 THEN 0 ELSE CAST(n_flg_lines AS DOUBLE) / n_all_lines END + 0.5 * CASE WHEN n_all_tools = 0 THEN 0 ELSE CAST(n_run_tools AS DOUBLE) / n_all_tools END AS score"
_NAMES = "string_agg(DISTINCT tool, '-' ORDER BY tool) AS tool, string_agg(DISTINCT vuln || ':' || CAST(line AS VARCHAR), '-' ORDER BY vuln || ':' || CAST(line AS VARCHAR)) AS vuln"
_COUNTS = "CAST(count(DISTINCT line) AS INTEGER) AS n_flg_lines, CAST(count(DISTINCT tool) AS INTEGER) AS n_run_tools"
_FIRST = "SELECT f.*, u.* EXCLUDE (file), row_number() OVER (PARTITION BY f.tool, f.file, f.line, f.vuln ORDER BY {order}) AS k FROM flags f JOIN {of} u ON u.file = f.file AND f.line BETWEEN u.{s} AND u.{e}"
_OUT = f"tool, file, line, vuln, n_flg_lines, n_all_lines, n_run_tools, n_all_tools, {_SCORE}"


@query(
    f"""WITH {FLAGS_SQL}, {BLOCKS_SQL}, {_TOTAL}, m AS ({_FIRST.format(order="func_ord, bs", of="blocks", s="bs", e="be")}),
g AS (SELECT file, CAST(bs AS INTEGER) AS pos, CAST(bloc AS INTEGER) AS n_all_lines, func_ord, {_NAMES}, {_COUNTS} FROM m WHERE k = 1 GROUP BY file, func_ord, bs, bloc)
SELECT DISTINCT {_OUT} FROM (SELECT *, pos AS line FROM g, total)"""
)
def group_block(spark: SparkSession, d: str) -> DataFrame:
    return findings.group_by_block(A.flags(spark, d), A.blocks(spark, d), rounded=False)


@query(
    f"""WITH {FLAGS_SQL}, {FUNCTIONS_SQL}, {_TOTAL}, m AS ({_FIRST.format(order="func_ord", of="functions", s="s", e="e")}),
g AS (SELECT file, CAST(s + 1 AS INTEGER) AS pos, CAST(loc AS INTEGER) AS n_all_lines, func_ord, {_NAMES}, {_COUNTS} FROM m WHERE k = 1 GROUP BY file, func_ord, s, loc)
SELECT DISTINCT {_OUT} FROM (SELECT *, pos AS line FROM g, total)"""
)
def group_function(spark: SparkSession, d: str) -> DataFrame:
    return findings.group_by_function(A.flags(spark, d), A.functions(spark, d), rounded=False)


@query(
    f"""WITH {FLAGS_SQL}, {BLOCKS_SQL}, {_TOTAL}, m AS ({_FIRST.format(order="func_ord", of="functions", s="s", e="e")}),
c AS (SELECT func_ord, CAST(loc AS INTEGER) AS n_all_lines, {_COUNTS} FROM m WHERE k = 1 GROUP BY func_ord, loc),
g AS (SELECT m.file, m.func_ord, CAST(b.bs AS INTEGER) AS pos, {_NAMES} FROM m JOIN blocks b ON m.func_ord = b.func_ord AND m.line BETWEEN b.bs AND b.be WHERE k = 1 GROUP BY m.file, m.func_ord, b.bs, b.be)
SELECT DISTINCT {_OUT} FROM (SELECT g.*, g.pos AS line, c.* EXCLUDE (func_ord), n_all_tools FROM g JOIN c USING (func_ord), total)"""
)
def group_block_v2(spark: SparkSession, d: str) -> DataFrame:
    return findings.group_by_function_blocks(A.flags(spark, d), A.functions(spark, d), A.blocks(spark, d), rounded=False)


@query(
    f"""WITH {FLAGS_SQL.replace("flags AS", "every AS")}, {BLOCKS_SQL}, flags AS (SELECT * FROM every f WHERE EXISTS (SELECT 1 FROM functions u WHERE u.file = f.file AND u.reachable AND f.line BETWEEN u.s AND u.e)),
{_TOTAL}, m AS ({_FIRST.format(order="func_ord, bs", of="blocks", s="bs", e="be")}),
g AS (SELECT file, CAST(bs AS INTEGER) AS pos, CAST(bloc AS INTEGER) AS n_all_lines, func_ord, {_NAMES}, {_COUNTS} FROM m WHERE k = 1 GROUP BY file, func_ord, bs, bloc)
SELECT DISTINCT * REPLACE (CAST(format('{{:.3f}}', score) AS DOUBLE) AS score) FROM (SELECT {_OUT} FROM (SELECT *, pos AS line FROM g, total))"""
)
def score_round3(spark: SparkSession, d: str) -> DataFrame:
    return findings.findings_pipeline(A.flags(spark, d), A.functions(spark, d), A.blocks(spark, d))


@query(f"WITH {FLAGS_SQL}, {BLOCKS_SQL}, m AS ({_FIRST.format(order='func_ord, bs', of='blocks', s='bs', e='be')}) SELECT tool, file, line, vuln, func_ord, bs AS block_start FROM m WHERE k = 1")
def first_match_block(spark: SparkSession, d: str) -> DataFrame:
    met = findings._first_match(A.flags(spark, d).dropDuplicates(), A.blocks(spark, d), "block_start", "block_end", ["func_ord", "block_ord"], ["block_start"])
    return met.select("tool", "file", "line", "vuln", "func_ord", "block_start")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def props_json_extract(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")).filter("k is not null")


@query(f"WITH {TRACE_SQL} SELECT exec_id, edge, cnt, {BUCKET_SQL} AS bucket, CASE {BUCKET_SQL} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 3 WHEN 8 THEN 4 WHEN 16 THEN 5 WHEN 32 THEN 6 WHEN 64 THEN 7 ELSE 8 END AS human FROM trace")
def hit_buckets(spark: SparkSession, d: str) -> DataFrame:
    return A.trace(spark, d).select("*", hit_bucket(F.col("cnt")).alias("bucket"), hit_bucket_human(F.col("cnt")).alias("human"))


@query(f"WITH {TRACE_SQL} SELECT exec_id, count(*) FILTER (cnt <> 0) AS n_edges, count(*) FILTER (cnt <> 255) AS n_not_full, CAST(sum(bit_count(cnt)) AS BIGINT) AS n_bits FROM trace GROUP BY exec_id")
def edge_stats(spark: SparkSession, d: str) -> DataFrame:
    return coverage.edge_statistics(A.trace(spark, d))


@query(
    f"""WITH {TRACE_SQL}, t AS (SELECT exec_id, edge, {BUCKET_SQL} AS bucket FROM trace WHERE cnt > 0),
n AS (SELECT exec_id, CASE WHEN exec_id = min(exec_id) OVER (PARTITION BY edge) THEN 2 WHEN exec_id = min(exec_id) OVER (PARTITION BY edge, bucket) THEN 1 ELSE 0 END AS x FROM t)
SELECT exec_id, max(x) AS novelty FROM n GROUP BY exec_id"""
)
def novelty_class(spark: SparkSession, d: str) -> DataFrame:
    return coverage.novelty(A.trace(spark, d))


@query(
    f"""WITH {TRACE_SQL}, e AS (SELECT exec_id, row_number() OVER (ORDER BY exec_id) AS pos FROM (SELECT DISTINCT exec_id FROM trace)),
h AS (SELECT edge, pos, row_number() OVER (PARTITION BY edge ORDER BY pos) AS k FROM trace JOIN e USING (exec_id) WHERE cnt > 0),
n AS (SELECT min(pos) AS pos FROM h GROUP BY edge UNION SELECT coalesce(max(CASE WHEN pos = k THEN pos END), 0) + 1 FROM h GROUP BY edge)
SELECT exec_id, CASE WHEN e.pos = 1 OR n.pos IS NOT NULL THEN 1 ELSE 0 END AS "unique" FROM e LEFT JOIN n ON e.pos = n.pos"""
)
def crash_novelty_simplified(spark: SparkSession, d: str) -> DataFrame:
    return coverage.crash_novelty(A.trace(spark, d))


@query(f"WITH {TRACE_SQL}, {SEEDS_SQL}, r AS (SELECT edge, seed_id, exec_us * len AS cost, row_number() OVER (PARTITION BY edge ORDER BY exec_us * len, seed_id DESC) AS k FROM trace JOIN seeds ON exec_id = seed_id) SELECT edge, seed_id, cost FROM r WHERE k = 1")
def top_rated_edge(spark: SparkSession, d: str) -> DataFrame:
    return coverage.edge_winners(A.trace(spark, d), A.seeds(spark, d))


@query(f"WITH {TRACE_SQL}, {SEEDS_SQL}, r AS (SELECT edge % 50 AS block, seed_id, distance, exec_us * len AS cost, row_number() OVER (PARTITION BY edge % 50 ORDER BY distance, exec_us * len, seed_id DESC) AS k FROM trace JOIN seeds ON exec_id = seed_id) SELECT block, seed_id, distance, cost FROM r WHERE k = 1")
def top_rated_block(spark: SparkSession, d: str) -> DataFrame:
    return coverage.block_winners(A.trace(spark, d).select("exec_id", (F.col("edge") % 50).alias("block")), A.seeds(spark, d))


@query(f"WITH {TRACE_SQL} SELECT edge, {BUCKET_SQL} AS bucket, count(DISTINCT exec_id) AS n FROM trace WHERE cnt > 0 GROUP BY 1, 2")
def tuple_frequency(spark: SparkSession, d: str) -> DataFrame:
    return coverage.tuple_frequency(A.trace(spark, d))


@query(f"WITH {TRACE_SQL}, {SEEDS_SQL}, r AS (SELECT edge, {BUCKET_SQL} AS bucket, seed_id, row_number() OVER (PARTITION BY edge, {BUCKET_SQL} ORDER BY len, seed_id) AS k FROM trace JOIN seeds ON exec_id = seed_id) SELECT edge, bucket, seed_id FROM r WHERE k = 1")
def best_file_per_tuple(spark: SparkSession, d: str) -> DataFrame:
    return coverage.best_file_per_tuple(A.trace(spark, d), A.seeds(spark, d))


@query()
def greedy_cover_edges(spark: SparkSession, d: str) -> DataFrame:
    return coverage.greedy_edge_cover(A.trace(spark, d), A.seeds(spark, d))


@query()
def greedy_cover_files(spark: SparkSession, d: str) -> DataFrame:
    return coverage.greedy_file_cover(A.trace(spark, d), A.seeds(spark, d))


@query(
    f"""WITH {TRACE_SQL}, t AS (SELECT exec_id % 500 AS input_id, exec_id, edge % 20 AS edge, max(cnt) AS cnt FROM trace GROUP BY 1, 2, 3), n AS (SELECT input_id, count(DISTINCT exec_id) AS n FROM t GROUP BY 1),
p AS (SELECT input_id, edge, count(*) AS k, min({BUCKET_SQL}) AS a, max({BUCKET_SQL}) AS b FROM t WHERE cnt > 0 GROUP BY 1, 2) SELECT input_id, edge FROM p JOIN n USING (input_id) WHERE k < n OR a <> b"""
)
def variable_edges(spark: SparkSession, d: str) -> DataFrame:
    runs = A.trace(spark, d).groupBy((F.col("exec_id") % 500).alias("input_id"), "exec_id", (F.col("edge") % 20).alias("edge")).agg(F.max("cnt").alias("cnt"))
    return coverage.variable_edges(runs)


@query(
    f"""WITH {TRACE_SQL}, s AS (SELECT exec_id, list((edge, {BUCKET_SQL}) ORDER BY edge) AS k FROM trace WHERE cnt > 0 GROUP BY exec_id)
SELECT exec_id, count(*) OVER (PARTITION BY k) AS n_fuzz FROM s"""
)
def path_frequency(spark: SparkSession, d: str) -> DataFrame:
    return coverage.path_frequency(A.trace(spark, d)).select("exec_id", "n_fuzz")


@query(f"WITH {CONDITIONS_SQL}, r AS (SELECT cnd_id, exec_id, CAST(64 - bit_count(xor(a, b)) AS INTEGER) AS bits FROM conditions), w AS (SELECT *, max(bits) OVER (PARTITION BY cnd_id ORDER BY exec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r) SELECT cnd_id, exec_id, bits FROM w WHERE best IS NULL OR bits > best")
def conformance_running_max(spark: SparkSession, d: str) -> DataFrame:
    return coverage.conformance_records(A.conditions(spark, d))


@query(f"WITH {CONDITIONS_SQL}, r AS (SELECT cnd_id, exec_id, CAST(64 - bit_count(xor(a, b)) AS INTEGER) AS bits FROM conditions), w AS (SELECT *, row_number() OVER (PARTITION BY cnd_id ORDER BY bits DESC, exec_id) AS k FROM r) SELECT cnd_id, exec_id, bits FROM w WHERE k = 1")
def conformance_holder(spark: SparkSession, d: str) -> DataFrame:
    return coverage.conformance_holders(A.conditions(spark, d))


@query(f"WITH {CONDITIONS_SQL} SELECT cnd_id, bit_or(CASE WHEN outcome THEN 2 ELSE 1 END) AS outcomes FROM conditions GROUP BY cnd_id")
def condition_outcome_or(spark: SparkSession, d: str) -> DataFrame:
    return coverage.condition_outcomes(A.conditions(spark, d))


@query(f"WITH {TRACE_SQL} SELECT edge, least(count(*), 536870911) AS hits, count(*) < {CRITICAL_HITS} AS rare FROM trace GROUP BY edge")
def target_hits(spark: SparkSession, d: str) -> DataFrame:
    return coverage.hit_counts(A.trace(spark, d), "edge", CRITICAL_HITS)


def _dedup_sql(n: int | None, fields: str) -> str:
    head = "t" if n is None else f"t[1:{n}]"
    return f"WITH {CRASHES_SQL}, k AS (SELECT input_file, list_transform({head}, lambda f: {fields}) AS key, sanitizer, vuln_type FROM crashes) SELECT input_file, CAST(dense_rank() OVER (ORDER BY sanitizer, vuln_type, key) - 1 AS INTEGER) AS bug_id FROM k"


_ID, _FILE, _LINE = "{'id': f.id, 'function': f.function}", "{'id': f.id, 'file': f.file, 'function': f.function}", "{'id': f.id, 'function': f.function, 'line': f.line}"


def _dedup(spark, d, *a) -> DataFrame:
    return crashes.dedup(A.crashes(spark, d), *a).select("input_file", "bug_id")


@query(_dedup_sql(None, _ID))
def crash_dedup_all(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d)


@query(_dedup_sql(1, _ID))
def crash_dedup_n1(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, 1)


@query(_dedup_sql(5, _ID))
def crash_dedup_n5(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, 5)


@query(_dedup_sql(2, _FILE))
def crash_dedup_files(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, 2, True)


@query(_dedup_sql(2, _LINE))
def crash_dedup_lines(spark: SparkSession, d: str) -> DataFrame:
    return _dedup(spark, d, 2, False, True)


@query(_dedup_sql(1, _FILE))
def crash_merge(spark: SparkSession, d: str) -> DataFrame:
    of = crashes.dedup(A.crashes(spark, d), 5)
    return crashes.merge(of.filter("bug_id % 2 = 0").unionByName(of.filter("bug_id % 2 = 1")), 1, True).select("input_file", "bug_id")


@query(f"WITH {CRASHES_SQL} SELECT input_file, array_to_string(list_transform(t, lambda f: '#' || CAST(f.id AS VARCHAR) || ':' || f.file || ':' || f.function || ':' || CAST(f.line AS VARCHAR)), '=') AS code, CAST(len(t) AS INTEGER) AS n FROM crashes WHERE len(list_filter(t, lambda f: f.file IN (':', '='))) = 0")
def trace_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = A.crashes(spark, d).filter(~F.exists("stack_trace", lambda f: f["file"].isin(":", "="))).select("input_file", encode_trace(F.col("stack_trace")).alias("code"))
    return rows.select("input_file", "code", F.size(decode_trace(F.col("code"))).alias("n"))


_BFS = f"WITH RECURSIVE {EDGES_SQL}, r(node, dist) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.dist + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.dist < 40)"


@query(f"{_BFS} SELECT DISTINCT node FROM r")
def reach_from_entry(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable_nodes(A.edges(spark, d), spark.createDataFrame([(1,)], "node long"))


@query(f"{_BFS} SELECT node, min(dist) AS dist FROM r GROUP BY node")
def bfs_distance(spark: SparkSession, d: str) -> DataFrame:
    return graph.distances(A.edges(spark, d), spark.createDataFrame([(0, 1)], "source int, node long")).select("node", "dist")


_TAINT = f"WITH RECURSIVE {EDGES_SQL}, target AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 97 = 0), taint(node) AS (SELECT node FROM target UNION SELECT e.src FROM taint t JOIN edges e ON e.dst = t.node)"


def _taint(spark, d) -> DataFrame:
    return graph.tainted(A.edges(spark, d), A.table(spark, d, "part").filter("p_partkey % 97 = 0").select(F.col("p_partkey").alias("node")))


@query(
    f"""{_TAINT}, m AS (SELECT e.src, e.dst, CASE WHEN t.node IS NULL THEN 1 ELSE 2 END AS value FROM edges e JOIN taint s ON s.node = e.src LEFT JOIN taint t ON t.node = e.dst),
c AS (SELECT src FROM m GROUP BY src HAVING count(*) > 1 AND min(value) = 1) SELECT m.* FROM m JOIN c USING (src)"""
)
def critical_blocks(spark: SparkSession, d: str) -> DataFrame:
    return graph.critical_blocks(A.edges(spark, d), _taint(spark, d))


_MATRIX = "matrix AS (SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(l_partkey % 40 AS INTEGER) AS col, min(CAST(l_linenumber AS INTEGER) * 10 - 10) AS dist FROM lineitem GROUP BY 1, 2), harmonic AS (SELECT row, coalesce(count(*) FILTER (dist > 0 AND col % 2 = 0) / sum(CASE WHEN dist > 0 AND col % 2 = 0 THEN 1.0 / CAST(dist AS DOUBLE) END), -1) AS distance FROM matrix GROUP BY row)"


def _matrix(spark, d) -> DataFrame:
    rows = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"))
    return rows.agg(F.min(F.col("l_linenumber") * 10 - 10).alias("dist"))


def _harmonic(spark, d) -> DataFrame:
    m = _matrix(spark, d)
    return directed.critical_distances(m, m.filter("col % 2 = 0").select("col"))


@query(f"WITH {_MATRIX} SELECT row, round(distance, 6) AS distance FROM harmonic")
def harmonic_distance(spark: SparkSession, d: str) -> DataFrame:
    return _harmonic(spark, d).select("row", F.round("distance", 6).alias("distance"))


_VULN = "hits AS (SELECT DISTINCT l_orderkey AS exec_id, l_partkey % 40 AS target_id FROM lineitem), targets AS (SELECT i AS target_id, (i + 1) / 40.0 AS score FROM range(0, 40, 2) r(i)), met AS (SELECT exec_id, CAST(coalesce(sum(score), 0) AS DOUBLE) AS met FROM hits LEFT JOIN targets USING (target_id) GROUP BY 1), factors AS (SELECT exec_id, 5 - (4 * met / (SELECT CAST(sum(score) AS DOUBLE) FROM targets) + 1) + 1 AS factor FROM met)"


def _factors(spark, d) -> DataFrame:
    hits = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("exec_id"), (F.col("l_partkey") % 40).alias("target_id"))
    return directed.vulnerability_factors(hits, spark.range(0, 40, 2).select(F.col("id").alias("target_id"), ((F.col("id") + 1) / 40.0).alias("score")))


@query(f"WITH {_VULN} SELECT exec_id, round(factor, 6) AS factor FROM factors")
def vuln_factor(spark: SparkSession, d: str) -> DataFrame:
    return _factors(spark, d).select("exec_id", F.round("factor", 6).alias("factor"))


@query(
    f"""WITH {_MATRIX}, {_VULN}, x AS (SELECT DISTINCT l_orderkey AS exec_id, CAST(l_suppkey AS INTEGER) AS row FROM lineitem),
m AS (SELECT exec_id, avg(distance) AS mean FROM x JOIN harmonic USING (row) WHERE distance >= 0 GROUP BY 1)
SELECT exec_id, round(coalesce(mean * (0.5 + 0.5 * factor), -1), 6) AS distance FROM (SELECT DISTINCT exec_id FROM x) LEFT JOIN m USING (exec_id) LEFT JOIN factors USING (exec_id)"""
)
def seed_distance(spark: SparkSession, d: str) -> DataFrame:
    diverged = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("exec_id"), F.col("l_suppkey").cast("int").alias("row"))
    return directed.seed_distances(diverged, _harmonic(spark, d), _factors(spark, d)).select("exec_id", F.round("distance", 6).alias("distance"))


_POWER_T = "CAST(1.0 / pow(20.0, 0.25) AS DOUBLE)"


@query(
    f"""WITH {SEEDS_SQL}, a AS (SELECT floor(avg(exec_us)) AS u, floor(avg(bitmap_size)) AS m FROM seeds),
s1 AS (SELECT *, CASE WHEN exec_us * CAST(0.1 AS DOUBLE) > u THEN 10 WHEN exec_us * CAST(0.25 AS DOUBLE) > u THEN 25 WHEN exec_us * CAST(0.5 AS DOUBLE) > u THEN 50 WHEN exec_us * CAST(0.75 AS DOUBLE) > u THEN 75 WHEN exec_us * 4 < u THEN 300 WHEN exec_us * 3 < u THEN 200 WHEN exec_us * 2 < u THEN 150 ELSE 100 END AS p FROM seeds, a),
s2 AS (SELECT *, floor(p * CASE WHEN bitmap_size * CAST(0.3 AS DOUBLE) > m THEN 3.0 WHEN bitmap_size * CAST(0.5 AS DOUBLE) > m THEN 2.0 WHEN bitmap_size * CAST(0.75 AS DOUBLE) > m THEN 1.5 WHEN bitmap_size * 3 < m THEN 0.25 WHEN bitmap_size * 2 < m THEN 0.5 WHEN bitmap_size * CAST(1.5 AS DOUBLE) < m THEN 0.75 ELSE 1.0 END) AS p2 FROM s1),
s3 AS (SELECT *, p2 * CASE WHEN handicap >= 4 THEN 4 WHEN handicap > 0 THEN 2 ELSE 1 END * CASE WHEN depth <= 3 THEN 1 WHEN depth <= 7 THEN 2 WHEN depth <= 13 THEN 3 WHEN depth <= 25 THEN 4 ELSE 5 END AS p3 FROM s2)
SELECT seed_id, CAST(least(CASE WHEN distance > 0 THEN floor(CAST(p3 AS DOUBLE) * pow(CAST(2 AS DOUBLE), 10 * ((1 - (distance - 1) / 37) * (1 - {_POWER_T}) + 0.5 * {_POWER_T} - 0.5))) ELSE p3 END, 1600) AS BIGINT) AS perf_score FROM s3"""
)
def power_schedule(spark: SparkSession, d: str) -> DataFrame:
    return directed.power_schedule(A.seeds(spark, d), 1.0, 38.0, 0.25)


@query(f"WITH {SEEDS_SQL} SELECT seed_id, row_number() OVER (ORDER BY NOT favored, distance = -1, distance, seed_id) AS rank FROM seeds")
def queue_order(spark: SparkSession, d: str) -> DataFrame:
    return directed.queue_order(A.seeds(spark, d)).select("seed_id", "rank")


def _durations(spark, d) -> DataFrame:
    return A.table(spark, d, "events").groupBy(F.col("user_id").alias("campaign")).agg((F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("duration"))


_DURATIONS = "durations AS (SELECT user_id AS campaign, CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) - CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS duration FROM events GROUP BY 1)"


@query(
    f"""WITH RECURSIVE {_DURATIONS}, c(campaign, duration, cycle, starts, ends) AS (SELECT campaign, duration, 0, CAST(0 AS BIGINT), CAST(3600 AS BIGINT) FROM durations WHERE duration >= 0
UNION ALL SELECT campaign, duration, cycle + 1, ends, ends + 3600 + CAST(floor(log2(ends / CAST(3600 AS DOUBLE) + 1) * 150) AS BIGINT) FROM c WHERE ends <= duration) SELECT campaign, cycle, starts, ends FROM c"""
)
def cycle_windows(spark: SparkSession, d: str) -> DataFrame:
    return directed.cycle_boundaries(_durations(spark, d), 3600)


@query()
def target_state_machine(spark: SparkSession, d: str) -> DataFrame:
    e = A.table(spark, d, "events").select((F.col("user_id") % 10).alias("campaign"), F.dense_rank().over(_by_day()).cast("int").alias("cycle"), (F.col("event_id") % 7).alias("target_id"))
    hits = e.groupBy("campaign", "cycle", "target_id").agg(F.count("*").alias("n"))
    cycles = hits.groupBy("campaign", "cycle").agg((F.sum("n") * 5).alias("inputs"), F.map_from_entries(F.collect_list(F.struct("target_id", "n"))).alias("hits"))
    cycles = cycles.select("campaign", "cycle", "inputs", (F.col("cycle") % 4 == 0).alias("solved"), F.lit(False).alias("exhausted"), "hits")
    targets = e.select("campaign").distinct().crossJoin(spark.range(7).select(F.col("id").alias("target_id"), ((F.col("id") + 1) / 7.0).alias("score")))
    return directed.target_state_machine(cycles, targets)


def _by_day():
    from pyspark.sql import Window

    return Window.partitionBy(F.col("user_id") % 10).orderBy(F.to_date("ts"))


@query(f"SELECT campaign, CAST(3600 + floor(log2(duration / CAST(3600 AS DOUBLE) + 1) * 150) AS BIGINT) AS next_interval FROM (SELECT user_id AS campaign, CAST(epoch(date_trunc('second', max(ts))) AS BIGINT) - CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS duration FROM events GROUP BY 1)")
def cycle_length(spark: SparkSession, d: str) -> DataFrame:
    return _durations(spark, d).select("campaign", log_cycle_interval(F.lit(3600), F.col("duration")).alias("next_interval"))


@query(
    f"""WITH {SERIES_SQL}, l AS (SELECT campaign, max(execs) AS execs_done, max(paths) AS paths, max(crashes) AS crashes FROM series GROUP BY 1),
i AS (SELECT *, campaign % 3 <> 0 AS alive, 100000 - campaign * 7 AS run_time FROM l)
SELECT count(*) FILTER (alive) AS n_alive, count(*) FILTER (NOT alive) AS n_dead, CAST(coalesce(sum(run_time) FILTER (alive), 0) AS BIGINT) AS total_time, CAST(coalesce(sum(execs_done) FILTER (alive), 0) AS BIGINT) AS total_execs,
 CAST(coalesce(sum(execs_done // run_time) FILTER (alive), 0) AS BIGINT) AS total_rate, CAST(coalesce(sum(paths // 2) FILTER (alive), 0) AS BIGINT) AS pending_favs, CAST(coalesce(sum(paths) FILTER (alive), 0) AS BIGINT) AS pending_total,
 CAST(coalesce(sum(crashes) FILTER (alive), 0) AS BIGINT) AS crashes, CAST(coalesce(sum(run_time) FILTER (alive), 0) AS BIGINT) // 86400 AS days, CAST(coalesce(sum(run_time) FILTER (alive), 0) AS BIGINT) // 3600 % 24 AS hours,
 CAST(sum(paths // 2) FILTER (alive) AS BIGINT) // count(*) FILTER (alive) AS mean_pending_favs, CAST(sum(paths) FILTER (alive) AS BIGINT) // count(*) FILTER (alive) AS mean_pending_total FROM i"""
)
def campaign_rollup(spark: SparkSession, d: str) -> DataFrame:
    last = A.series(spark, d).groupBy("campaign").agg(F.max("execs").alias("execs_done"), F.max("paths").alias("pending_total"), F.max("crashes").alias("unique_crashes"))
    snap = last.select("*", (F.col("campaign") % 3 != 0).alias("alive"), (F.col("campaign") * 7).alias("start_time"), F.expr("pending_total div 2").alias("pending_favs"), F.lit(1).cast("long").alias("cur_path"), F.lit(2).cast("long").alias("paths_total"))
    return campaign.rollup(snap, 100000)


@query(f"WITH {SERIES_SQL}, b AS (SELECT *, lag(paths) OVER w AS p, lag(crashes) OVER w AS c FROM series WINDOW w AS (PARTITION BY campaign ORDER BY ts, event_id)) SELECT campaign, event_id, paths, crashes FROM b WHERE p IS NULL OR p <> paths OR c <> crashes")
def change_only_series(spark: SparkSession, d: str) -> DataFrame:
    return campaign.change_only(A.series(spark, d), "campaign", ["ts", "event_id"], ["paths", "crashes"]).select("campaign", "event_id", "paths", "crashes")


@query(
    f"""WITH RECURSIVE {SERIES_SQL}, s AS (SELECT campaign, epoch_us(ts) // 1000 AS at_ms, execs, row_number() OVER (PARTITION BY campaign ORDER BY epoch_us(ts) // 1000, execs) AS k FROM series),
r(campaign, at_ms, execs, k, rate) AS (SELECT campaign, at_ms, execs, k, CASE WHEN at_ms > 0 THEN CAST(execs * 1000 AS DOUBLE) / at_ms ELSE 0 END FROM s WHERE k = 1
UNION ALL SELECT s.campaign, s.at_ms, s.execs, s.k, CASE WHEN r.execs = 0 THEN CAST(s.execs * 1000 AS DOUBLE) / s.at_ms WHEN s.at_ms = r.at_ms THEN r.rate
  WHEN x.v * 5 < r.rate OR x.v / 5 > r.rate THEN x.v * (1 - CAST(1 AS DOUBLE) / 16) + x.v / 16 ELSE r.rate * (1 - CAST(1 AS DOUBLE) / 16) + x.v / 16 END
  FROM r JOIN s ON s.campaign = r.campaign AND s.k = r.k + 1, LATERAL (SELECT CAST((s.execs - r.execs) * 1000 AS DOUBLE) / nullif(s.at_ms - r.at_ms, 0) AS v) x)
SELECT campaign, at_ms, execs, round(rate, 9) AS rate FROM r"""
)
def ewma_rate(spark: SparkSession, d: str) -> DataFrame:
    s = A.series(spark, d).select("campaign", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "execs", F.lit(0).cast("long").alias("start_ms"))
    return campaign.execution_rate(s, "campaign", "at_ms", "execs", "start_ms").withColumn("rate", F.round("rate", 9))


@query("SELECT p_partkey, CASE WHEN p_size <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(p_size))) AS BIGINT) END AS p2 FROM part")
def next_power(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "part").select("p_partkey", next_p2(F.col("p_size")).alias("p2"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 1 OR l_suppkey % 9 = 1 OR l_linenumber = 1 OR l_orderkey % 9 = 1 THEN CASE WHEN l_partkey % 9 = 1 AND l_suppkey % 9 = 1 AND l_linenumber = 1 AND l_orderkey % 9 = 1 THEN 'none' ELSE 'minor' END WHEN l_partkey % 9 = l_suppkey % 9 AND l_partkey % 9 = l_linenumber AND l_partkey % 9 = l_orderkey % 9 THEN 'fixed' ELSE 'variable' END AS cls FROM lineitem")
def byte_response(spark: SparkSession, d: str) -> DataFrame:
    t = A.table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", response_class(F.lit(1), F.col("l_partkey") % 9, F.col("l_suppkey") % 9, F.col("l_linenumber"), F.col("l_orderkey") % 9).alias("cls"))


@query("SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN 1 / pow(20.0, x) WHEN 1 THEN 1 / (1 + 2 * ln(1 + x * CAST(13358.7268297 AS DOUBLE))) WHEN 2 THEN 1 / (1 + 19 * x) ELSE 1 / (1 + 19 * x * x) END, 9) AS t FROM (SELECT o_orderkey, CAST(o_orderkey % 100 AS DOUBLE) / 100 AS x FROM orders)")
def cooling_schedules(spark: SparkSession, d: str) -> DataFrame:
    x, k = (F.col("o_orderkey") % 100) / F.lit(100.0), F.col("o_orderkey") % 4
    t = F.when(k == 0, cooling(x, "exp")).when(k == 1, cooling(x, "log")).when(k == 2, cooling(x, "lin")).otherwise(cooling(x, "quad"))
    return A.table(spark, d, "orders").select("o_orderkey", F.round(t, 9).alias("t"))


@query(
    f"""WITH {TRACE_SQL}, t AS (SELECT o_custkey AS input_id, o_orderkey AS exec_id, CAST(floor(o_totalprice) AS BIGINT) AS us FROM orders),
p AS (SELECT input_id, count(*) AS n_runs, sum(us) AS us, max(exec_id) AS exec_id FROM t GROUP BY input_id),
b AS (SELECT exec_id, count(*) AS n FROM trace WHERE cnt > 0 GROUP BY exec_id)
SELECT input_id, n_runs, CAST(us // n_runs AS BIGINT) AS exec_us, coalesce(b.n, 0) AS bitmap_size FROM p LEFT JOIN b USING (exec_id)"""
)
def calibration(spark: SparkSession, d: str) -> DataFrame:
    times = A.table(spark, d, "orders").select(F.col("o_custkey").alias("input_id"), F.col("o_orderkey").alias("exec_id"), F.floor("o_totalprice").alias("us"))
    return coverage.calibration(times, A.trace(spark, d).join(times.select("input_id", "exec_id"), "exec_id"))


@query(
    f"""WITH {SEEDS_SQL}, {CONDITIONS_SQL}, o AS (SELECT DISTINCT exec_id // 10 AS seed_id FROM conditions WHERE cnd_id % 4 = 0)
SELECT seed_id, len <= 500 AND (seed_id % 7 = 0 OR o.seed_id IS NOT NULL) AS need_sniff FROM seeds LEFT JOIN o USING (seed_id)"""
)
def need_sniff(spark: SparkSession, d: str) -> DataFrame:
    waiting = A.conditions(spark, d).filter("cnd_id % 4 = 0").select(F.expr("exec_id div 10").alias("seed_id"))
    return directed.needs_sniffing(A.seeds(spark, d).withColumn("is_rare_target", F.expr("seed_id % 7 = 0")), waiting, 500)

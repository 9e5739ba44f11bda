"""Queries that write the adapted tables in the formats of files and read them back, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode_trace
from ..operators import campaign, crashes, findings
from ..sources import readers, writers
from ..workspace import shared_folder
from . import adapters as A
from .adapters import BLOCKS_SQL, CRASHES_SQL, FLAGS_SQL, SERIES_SQL
from .queries import QUERIES, SQL, query


def _text(rows: DataFrame, folder: str) -> str:
    rows.write.text(folder)
    return folder


@query(f"WITH {FLAGS_SQL} SELECT * FROM flags")
def flags_csv(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "flags")
    writers.write_flags(A.flags(spark, d).dropDuplicates(), folder)
    return readers.read_flags(spark, folder)


@query(SQL["group_block"])
def grouped_csv(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "grouped")
    writers.write_flags(findings.group_by_block(A.flags(spark, d), A.blocks(spark, d), rounded=False), folder)
    return readers.read_grouped_flags(spark, folder)


@query(f"WITH {FLAGS_SQL} SELECT * FROM flags")
def sarif_lines(spark: SparkSession, d: str) -> DataFrame:
    f = A.flags(spark, d).dropDuplicates()
    place = F.struct(F.struct(F.struct(F.concat(F.lit("/src/"), "file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.concat(F.lit("r-"), "vuln").alias("ruleId"), F.array(place).alias("locations"))
    rule = F.struct(F.concat(F.lit("r-"), "vuln").alias("id"), F.col("vuln").alias("name"))
    runs = f.groupBy("tool").agg(F.collect_set(rule).alias("rules"), F.collect_list(result).alias("results"))
    run = F.struct(F.struct(F.struct(F.upper("tool").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    lines = runs.select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("value"))
    return readers.read_sarif_lines(spark, _text(lines, shared_folder(spark, "sarif")))


@query(f"WITH {FLAGS_SQL} SELECT DISTINCT 'infer' AS tool, file, line, vuln FROM flags")
def json_findings(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct(F.concat(F.lit("a/b/"), "file").alias("file"), "line", F.col("vuln").alias("bug_type"))
    document = A.flags(spark, d).agg(F.to_json(F.collect_set(item)).alias("value"))
    return readers.read_json_findings(spark, "infer", _text(document, shared_folder(spark, "json")))


@query(f"WITH {FLAGS_SQL} SELECT DISTINCT tool, file, line, '-' AS vuln FROM flags")
def pass_findings(spark: SparkSession, d: str) -> DataFrame:
    lines = A.flags(spark, d).select(F.concat_ws(",", "tool", "file", F.lit("x"), "line").alias("value"))
    return readers.read_pass_findings(spark, _text(lines, shared_folder(spark, "pass")))


@query(
    f"""WITH {BLOCKS_SQL} SELECT b.file, 'f' || CAST(b.func_ord AS VARCHAR) AS name, f.s AS start, f.e AS "end", b.loc, p_type <> 'PROMO' AS reachable, b.func_ord * 100 + (bs - f.s) // 8 AS block_id, bs AS block_start, be AS block_end, bloc AS block_loc
FROM blocks b JOIN functions f USING (func_ord) JOIN part ON p_partkey = b.func_ord"""
)
def inspection_json(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "inspection")
    writers.write_inspection(A.functions(spark, d), A.blocks(spark, d), folder)
    return readers.blocks_of(readers.functions_of(readers.read_inspection(spark, folder))).select("file", "name", "start", "end", "loc", "reachable", "block_id", "block_start", "block_end", "block_loc")


_CELLS = "SELECT CAST(l_suppkey AS INTEGER) AS row, CAST(l_partkey % 40 AS INTEGER) AS col, min(CAST(l_linenumber AS INTEGER)) AS dist FROM lineitem GROUP BY 1, 2"


@query(f"WITH cells AS ({_CELLS}), r AS (SELECT CAST(unnest(range(0, (SELECT max(row) + 1 FROM cells))) AS INTEGER) AS row), c AS (SELECT CAST(unnest(range(40)) AS INTEGER) AS col) SELECT r.row, c.col, coalesce(dist, -1) AS dist FROM r CROSS JOIN c LEFT JOIN cells ON cells.row = r.row AND cells.col = c.col")
def distance_matrix_file(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "matrix")
    cells = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col")).agg(F.min(F.col("l_linenumber").cast("int")).alias("dist"))
    writers.write_matrix(cells, cells.agg(F.max("row")).first()[0] + 1, 40, folder)
    return readers.read_distance_matrix(spark, folder)


_PLAIN = "len(list_filter(t, lambda f: f.file IN (':', '=', ',', chr(10), chr(13)))) = 0"


@query(
    f"""WITH {CRASHES_SQL}, k AS (SELECT *, list_transform(t[1:2], lambda f: {{'id': f.id, 'function': f.function}}) AS key FROM crashes WHERE {_PLAIN})
SELECT CAST(dense_rank() OVER (ORDER BY sanitizer, vuln_type, key) - 1 AS INTEGER) AS bug_id, 2 AS n_dedup_frames, FALSE AS consider_filepaths, FALSE AS consider_lines, input_file, sanitizer, vuln_type, CAST(len(t) AS INTEGER) AS n FROM k"""
)
def crash_summary(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "summary")
    rows = A.crashes(spark, d).filter(~F.exists("stack_trace", lambda f: f["file"].isin(":", "=", ",", "\n", "\r")))
    writers.write_summary(crashes.dedup(rows, 2), folder, 2)
    return readers.read_summary(spark, folder).withColumn("n", F.size("stack_trace")).drop("stack_trace")


@query(
    f"""WITH {CRASHES_SQL} SELECT input_file, sanitizer, vuln_type, array_to_string(list_transform(t, lambda f: '#' || CAST(f.id AS VARCHAR) || ':s.c:' || f.function || ':' || CAST(f.line AS VARCHAR)), '=') AS code FROM crashes"""
)
def sanitizer_reports(spark: SparkSession, d: str) -> DataFrame:
    frames = F.array_join(F.transform("stack_trace", lambda f: F.concat(F.lit("    #"), f["id"].cast("string"), F.lit(" 0x4c in "), f["function"], F.lit(" /src/s.c:"), f["line"].cast("string"), F.lit(":7"))), "\n")
    text = F.concat(F.lit("INPUT_FILE: "), "input_file", F.lit("\n==1==ERROR: "), F.upper("sanitizer"), F.lit(": "), "vuln_type", F.lit(" on address\n"), frames, F.lit("\n\nend\n"))
    return crashes.parse_reports(A.crashes(spark, d).select(text.alias("value"))).select("input_file", "sanitizer", "vuln_type", encode_trace(F.col("stack_trace")).alias("code"))


@query(
    """SELECT CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS cnd_id, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_partkey AS INTEGER) END AS cbb_id,
  CASE l_suppkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 0 END + CASE WHEN l_partkey % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS flags,
  CASE WHEN l_partkey % 4 = 0 THEN l_suppkey END AS constant1, CASE WHEN l_partkey % 5 = 0 THEN -l_suppkey END AS constant2 FROM lineitem"""
)
def condition_records(spark: SparkSession, d: str) -> DataFrame:
    folder, p, s = shared_folder(spark, "conditions"), F.col("l_partkey"), F.col("l_suppkey")
    rows = A.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("cnd_id"), F.when(p % 3 > 0, p).alias("cbb_id"), F.lit("int32").alias("type1"),
        F.when(s % 3 == 0, "int32").when(s % 3 == 1, "int64").otherwise("ptr").alias("type2"), F.when(p % 4 == 0, s.cast("string")).otherwise("var").alias("value1"), F.when(p % 5 == 0, (-s).cast("string")).otherwise("var").alias("value2"),
    )
    writers.record_lines(rows, ["cnd_id", "cbb_id", "type1", "type2", "value1", "value2"], None).write.text(folder)
    return readers.read_conditions(spark, folder).select("cnd_id", "cbb_id", "flags", "constant1", "constant2")


@query("SELECT CAST(p_partkey AS INTEGER) AS target_id, CAST(p_size % 8 AS FLOAT) / 8 AS score, p_brand || ':' || CAST(p_size AS VARCHAR) AS loc FROM part")
def target_scores(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "targets")
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("target_id"), ((F.col("p_size") % 8) / 8).alias("score"), F.concat("p_brand", F.lit(":"), F.col("p_size").cast("string")).alias("loc"))
    writers.write_records(rows, ["target_id", "score"], folder)
    return readers.read_target_scores(spark, folder)


@query("SELECT CAST(p_partkey AS INTEGER) AS bb_id, CAST(p_size AS INTEGER) AS cbb_id, CAST(p_partkey % 16 AS DOUBLE) / 4 - 1 AS dist, p_brand AS loc FROM part")
def block_distance_records(spark: SparkSession, d: str) -> DataFrame:
    folder = shared_folder(spark, "distances")
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("bb_id"), F.col("p_size").alias("cbb_id"), ((F.col("p_partkey") % 16) / 4 - 1).alias("dist"), F.col("p_brand").alias("loc"))
    writers.write_records(rows, ["bb_id", "cbb_id", "dist"], folder)
    return readers.read_block_distances(spark, folder)


@query(
    f"""WITH {SERIES_SQL}, b AS (SELECT *, lag(paths) OVER w AS p, lag(crashes) OVER w AS c FROM series WINDOW w AS (PARTITION BY campaign ORDER BY ts, event_id))
SELECT event_id AS unix_time, campaign AS cycles_done, CAST(0 AS BIGINT) AS cur_path, paths AS paths_total, paths // 2 AS pending_total, paths // 3 AS pending_favs, paths % 100 + CAST(0.25 AS DOUBLE) AS map_size, crashes AS unique_crashes, CAST(0 AS BIGINT) AS unique_hangs, CAST(1 AS BIGINT) AS max_depth, execs % 7 + CAST(0.5 AS DOUBLE) AS execs_per_sec
FROM b WHERE p IS NULL OR p <> paths OR c <> crashes"""
)
def plot_file(spark: SparkSession, d: str) -> DataFrame:
    folder, zero = shared_folder(spark, "plot"), F.lit(0).cast("long")
    s = campaign.change_only(A.series(spark, d), "campaign", ["ts", "event_id"], ["paths", "crashes"])
    rows = s.select(
        F.col("event_id").alias("unix_time"), F.col("campaign").alias("cycles_done"), zero.alias("cur_path"), F.col("paths").alias("paths_total"), F.expr("paths div 2").alias("pending_total"), F.expr("paths div 3").alias("pending_favs"),
        (F.col("paths") % 100 + 0.25).alias("map_size"), F.col("crashes").alias("unique_crashes"), zero.alias("unique_hangs"), F.lit(1).cast("long").alias("max_depth"), (F.col("execs") % 7 + 0.5).alias("execs_per_sec"),
    )
    writers.write_plot(rows, folder)
    return readers.read_plot(spark, folder)


@query(f"WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY campaign, event_id // 900 ORDER BY event_id) AS k FROM series) SELECT event_id AS fuzzing_dur, campaign AS cycle_count, 'cov' AS fuzzing_mode, execs AS n_target_bbs, crashes AS n_unique_crashes FROM r WHERE k = 1")
def campaign_stats_file(spark: SparkSession, d: str) -> DataFrame:
    folder, zero = shared_folder(spark, "stats"), F.lit(0).cast("long")
    s = campaign.every(A.series(spark, d), "campaign", "event_id")
    rows = s.select(
        F.col("event_id").alias("fuzzing_dur"), F.col("campaign").alias("cycle_count"), F.lit("cov").alias("fuzzing_mode"), zero.alias("init_cycle_length"), zero.alias("cycle_interval"),
        F.col("execs").alias("n_target_bbs"), zero.alias("n_target_bbs_hit"), zero.alias("n_target_bbs_finished"), F.col("crashes").alias("n_unique_crashes"),
    )
    writers.write_campaign_stats(rows, folder)
    return readers.read_campaign_stats(spark, folder).select("fuzzing_dur", "cycle_count", "fuzzing_mode", "n_target_bbs", "n_unique_crashes")


@query(
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 AND event_id % 11 <> 0 THEN [user_id, event_id % 7] ELSE [user_id] END AS src, CASE WHEN event_id % 11 <> 0 THEN event_type END AS op,
  CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN event_id % 50 END AS pos, CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 AND event_id % 4 = 0 THEN (CASE WHEN event_id % 8 = 0 THEN 'be:' ELSE '' END) || printf('%+d', event_id % 9 - 4) END AS val,
  CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 1 THEN event_id % 64 END AS rep, CASE WHEN event_id % 11 = 0 THEN 'peer' END AS sync, event_id % 5 = 0 AS new_coverage FROM events"""
)
def seed_lineage(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    change = writers.change_name(
        F.col("user_id"), F.when(e % 3 == 0, e % 7).otherwise(-1), F.col("event_type"), F.when(e % 2 == 0, e % 50).otherwise(-1), F.when(e % 4 == 0, e % 9 - 4), e % 8 == 0, e % 64, F.when(e % 11 == 0, "peer"), e % 5 == 0
    )
    return readers.lineage(A.table(spark, d, "events").select(writers.seed_name(e, change).alias("name"))).drop("name")


__all__ = ["QUERIES", "SQL"]

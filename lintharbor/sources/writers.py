"""Sinks. Each has a ``*_lines`` projection, which tests and other sinks can use, and a writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import encode_trace


def number_text(x: Column) -> Column:
    """A double as its shortest decimal, as ``0.2`` or ``1.0``."""
    return x.cast("double").cast("string")


def flag_lines(flags: DataFrame) -> DataFrame:
    """Plain or grouped findings as headerless CSV lines, sorted."""
    cells = [number_text(F.col(c)) if c == "score" else F.col(c).cast("string") for c in flags.columns]
    return flags.select(F.concat_ws(",", *cells).alias("value")).orderBy("value")


def write_flags(flags: DataFrame, path: str) -> None:
    flag_lines(flags).write.mode("overwrite").text(path)


def summary_lines(crashes: DataFrame, n_frames: int | None, filepaths: bool, lines: bool) -> DataFrame:
    """A line per crash of a deduplicated table (bug_id and the columns of a crash)."""
    flag = lambda b: F.lit("True" if b else "False")
    cells = [F.col("bug_id").cast("string"), F.lit("-" if n_frames is None else str(n_frames)), flag(filepaths), flag(lines), F.translate("input_file", ",", "-"), F.col("sanitizer"), F.col("vuln_type"), encode_trace(F.col("stack_trace")), F.size("stack_trace").cast("string")]
    return crashes.orderBy("bug_id", "input_file").select(F.concat_ws(",", *cells).alias("value"))


def write_summary(crashes: DataFrame, path: str, n_frames: int | None = None, filepaths: bool = False, lines: bool = False) -> None:
    """One summary file, with its header."""
    body = summary_lines(crashes, n_frames, filepaths, lines)
    header = crashes.sparkSession.createDataFrame([(",".join(schema.SUMMARY_COLUMNS),)], "value string")
    header.coalesce(1).unionByName(body).coalesce(1).write.mode("overwrite").text(path)


def write_summaries(crashes: DataFrame, path: str, depths: list[int | None], filepaths: bool = False, lines: bool = False) -> None:
    """One summary for each distinct frame depth: ``<path>/summary`` and ``<path>/summary_nf<n>``."""
    from ..operators.crashes import dedup

    for n in dict.fromkeys(depths):
        write_summary(dedup(crashes, n, filepaths, lines), f"{path}/summary" + ("" if n is None else f"_nf{n}"), n, filepaths, lines)


def inspection_document(functions: DataFrame, blocks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The nested document of flat tables (one row): functions with their blocks, and the block graph where given."""
    place = lambda a, b: F.struct(F.struct(F.col(a).alias("start"), F.col(b).alias("end")).alias("line"))
    block = F.struct(F.col("block_ord"), F.struct(F.col("block_id").alias("id"), place("block_start", "block_end").alias("location"), F.col("block_loc").alias("LoC")).alias("b"))
    of = blocks.groupBy("func_ord").agg(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["b"]).alias("basic_blocks"))
    where = F.struct(F.col("file").alias("filename"), F.struct(F.col("start"), F.col("end")).alias("line"), F.col("reachable").alias("reachable_from_main"))
    empty = F.from_json(F.lit("[]"), "array<struct<id:bigint,location:struct<line:struct<start:bigint,`end`:bigint>>,LoC:bigint>>")
    rows = functions.join(of, "func_ord", "left").select(F.struct("func_ord", F.struct("name", where.alias("location"), F.col("loc").alias("LoC"), F.coalesce("basic_blocks", empty).alias("basic_blocks")).alias("f")).alias("x"))
    out = rows.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["f"]).alias("functions"))
    if edges is None:
        return out
    graph = edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dst")).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("iCFG"))
    return out.crossJoin(graph)  # one row each


def write_inspection(functions: DataFrame, blocks: DataFrame, path: str, edges: DataFrame | None = None) -> None:
    inspection_document(functions, blocks, edges).coalesce(1).write.mode("overwrite").json(path)


def matrix_lines(distances: DataFrame, rows: int, cols: int) -> DataFrame:
    """``rows:cols``, then a comma-separated line per row; what is missing is -1. (at, value), to be written by ascending at."""
    spark = distances.sparkSession
    cells = distances.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "dist"))).alias("m"))
    full = spark.range(rows).select(F.col("id").cast("int").alias("row")).join(cells, "row", "left")
    value = F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(-1)).cast("string"))
    body = full.select((F.col("row") + 1).alias("at"), F.array_join(value, ",").alias("value"))
    return spark.createDataFrame([(0, f"{rows}:{cols}")], "at int, value string").unionByName(body)


def write_matrix(distances: DataFrame, rows: int, cols: int, path: str) -> None:
    matrix_lines(distances, rows, cols).repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def record_lines(rows: DataFrame, cells: list[str], loc: str | None = "loc") -> DataFrame:
    """Blank-separated records of side tables, the location in braces; null cells are ``none``."""
    out = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in cells]
    return rows.orderBy(cells[0]).select(F.concat_ws(" ", *out, *([F.concat(F.lit("{"), F.col(loc), F.lit("}"))] if loc else [])).alias("value"))


def write_records(rows: DataFrame, cells: list[str], path: str, loc: str | None = "loc") -> None:
    record_lines(rows, cells, loc).coalesce(1).write.mode("overwrite").text(path)


def snapshot_lines(snapshot: DataFrame) -> DataFrame:
    """``key : value`` lines of each instance's row."""
    cells = [F.format_string(f"{c:<18}: %s", F.col(c).cast("string")) for c in snapshot.columns if c != "path"]
    return snapshot.select(F.explode(F.array(*cells)).alias("value"))


def trace_lines(trace: DataFrame, minimiser: bool = False) -> DataFrame:
    """``edge:class`` with six digits; for the minimiser class and edge without a separator."""
    text = F.concat(F.col("cls").cast("string"), F.col("edge").cast("string")) if minimiser else F.format_string("%06d:%d", F.col("edge"), F.col("cls"))
    return trace.orderBy("edge").select(text.alias("value"))


def change_name(src: Column, spliced: Column, op: Column, pos: Column, val: Column, big_endian: Column, rep: Column, peer: Column, new_coverage: Column) -> Column:
    """How a file came about: ``src:000001+000002,op:arith8,pos:3,val:be:+7`` or ``...,rep:4``, or ``sync:peer,src:000001``; ``,+cov`` where coverage is new. Nulls leave their part out."""
    own = F.concat(
        F.format_string("src:%06d", src), F.when(spliced >= 0, F.format_string("+%06d", spliced)).otherwise(""), F.lit(",op:"), op,
        F.when(pos >= 0, F.concat(F.format_string(",pos:%d", pos), F.when(val.isNotNull(), F.concat(F.lit(",val:"), F.when(big_endian, "be:").otherwise(""), F.format_string("%+d", val))).otherwise(""))).otherwise(F.format_string(",rep:%d", rep)),
    )
    said = F.when(peer.isNotNull(), F.concat(F.lit("sync:"), peer, F.format_string(",src:%06d", src))).otherwise(own)
    return F.concat(said, F.when(new_coverage, ",+cov").otherwise(""))


def seed_name(id_: Column, change: Column) -> Column:
    """``id:000001,`` and how the seed came about."""
    return F.concat(F.format_string("id:%06d,", id_), change)


def crash_name(id_: Column, ms: Column, signal: Column, change: Column) -> Column:
    """``id:000001,1234,sig:11,`` and how the crash came about; ms: since the start."""
    return F.concat(F.format_string("id:%06d,%d,sig:%02d,", id_, ms, signal), change)


def plot_lines(series: DataFrame) -> DataFrame:
    """Lines of the plotted series from change-only rows with the columns of PLOT (map_size a number) and ``execs`` as text."""
    names = [x.split()[0] for x in schema.PLOT.split(", ")]
    cells = [F.format_string("%.2f%%" if c == "map_size" else "%.2f" if c == "execs_per_sec" else "%d", F.col(c)) for c in names]
    return series.orderBy("unix_time").select(F.concat_ws(", ", *cells, *([F.col("execs")] if "execs" in series.columns else [])).alias("value"))


def write_plot(series: DataFrame, path: str) -> None:
    plot_lines(series).coalesce(1).write.mode("overwrite").text(path)


def write_campaign_stats(series: DataFrame, path: str) -> None:
    """The quarter-hourly statistics, with a header."""
    names = [x.split()[0] for x in schema.CAMPAIGN_STATS.split(", ")]
    series.select(*names).orderBy("fuzzing_dur").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_traces(trace: DataFrame, path: str, minimiser: bool = False) -> None:
    """A folder of trace dumps for each execution (exec_id, edge, cls)."""
    text = F.concat(F.col("cls").cast("string"), F.col("edge").cast("string")) if minimiser else F.format_string("%06d:%d", F.col("edge"), F.col("cls"))
    rows = trace.select("exec_id", "edge", text.alias("value")).repartition("exec_id").sortWithinPartitions("exec_id", "edge")
    rows.select("exec_id", "value").write.mode("overwrite").partitionBy("exec_id").text(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """One instance's snapshot (one row)."""
    snapshot_lines(snapshot).coalesce(1).write.mode("overwrite").text(path)

"""Crash reports: parsing without a UDF, deduplication by stack prefix, merging of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import ERROR_LINE, INPUT_FILE, frame_of, trace_key
from .graph import dense_index


def _lines(text: Column) -> Column:
    """The stripped lines; what follows the last line break is no line if it is empty."""
    parts = F.split(text, "\r\n|\n|\r")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def parse_reports(reports: DataFrame, column: str = "value") -> DataFrame:
    """Reports as text -> crashes; invalid reports are left out.

    After the line that names the error, frames are read from the first one up to a blank line; any other line, or the end of
    the report, makes it invalid. A blank line before any frame ends a report without a trace, but for leak reports."""
    rows = reports.select(_lines(F.col(column)).alias("l")).select("*", F.transform("l", lambda x: frame_of(x)).alias("f"), F.transform("l", lambda x: x.rlike(ERROR_LINE)).alias("e"))
    rows = rows.withColumn("i", F.array_position("e", F.lit(True)).cast("int")).filter("i > 0")
    error = F.element_at("l", F.col("i"))
    head = F.slice("l", 1, F.col("i") - 1)
    named = F.filter(head, lambda x: x.rlike(INPUT_FILE))
    rows = rows.select(
        F.when(F.size(named) > 0, F.regexp_extract(F.element_at(named, -1), INPUT_FILE, 1)).otherwise("").alias("input_file"),
        F.lower(F.regexp_extract(error, ERROR_LINE, 1)).alias("sanitizer"),
        F.lower(F.regexp_extract(error, ERROR_LINE, 2)).alias("vuln_type"),
        F.slice("l", F.col("i") + 1, F.greatest(F.size("l") - F.col("i"), F.lit(0))).alias("l"),
        F.slice("f", F.col("i") + 1, F.greatest(F.size("l") - F.col("i"), F.lit(0))).alias("f"),
    )
    first = F.array_position(F.transform("f", lambda x: x.isNotNull()), F.lit(True)).cast("int")
    blank = F.array_position("l", F.lit("")).cast("int")
    rows = rows.select("*", first.alias("at"), blank.alias("b"))
    empty = (F.col("sanitizer") != "leaksanitizer") & (F.col("b") > 0) & ((F.col("at") == 0) | (F.col("b") < F.col("at")))
    rest = F.slice("f", F.col("at"), F.size("f") - F.col("at") + 1)
    stop = F.array_position(F.transform(rest, lambda x: x.isNull()), F.lit(True)).cast("int")
    rows = rows.select("*", empty.alias("empty"), F.when(F.col("at") > 0, rest).alias("rest"), F.when(F.col("at") > 0, stop).otherwise(0).alias("stop"))
    ends = F.when((F.col("at") > 0) & (F.col("stop") > 0), F.try_element_at("l", F.col("at") + F.col("stop") - 1) == "").otherwise(False)
    none = F.array().cast(f"array<{schema.FRAME}>")
    return rows.filter(F.col("empty") | ends).select("input_file", "sanitizer", "vuln_type", F.when(F.col("empty"), none).otherwise(F.slice("rest", 1, F.greatest(F.col("stop") - 1, F.lit(0)))).alias("stack_trace"))


def dedup(crashes: DataFrame, n_frames: int | None = None, filepaths: bool = False, lines: bool = False) -> DataFrame:
    """Crashes with bug_id: equal sanitizer, type and reduced stack prefix are one bug; ids count from 0 in key order.

    Only the distinct keys are ranked, not the crashes, and their number is joined back by key."""
    keyed = crashes.withColumn("_key", trace_key(F.col("stack_trace"), n_frames, filepaths, lines))
    keys = keyed.select("sanitizer", "vuln_type", "_key").distinct()
    ranked = dense_index(keys, ["sanitizer", "vuln_type", "_key"], "bug_id").withColumn("bug_id", F.col("bug_id").cast("int"))
    return keyed.join(ranked, ["sanitizer", "vuln_type", "_key"]).select("bug_id", *crashes.columns)


def merge(summaries: DataFrame, n_frames: int | None = None, filepaths: bool = False, lines: bool = False) -> DataFrame:
    """Crashes of several summaries, grouped anew."""
    columns = [c for c in summaries.columns if c not in ("bug_id", "n_dedup_frames", "consider_filepaths", "consider_lines")]
    return dedup(summaries.select(*columns), n_frames, filepaths, lines)


def groups(deduped: DataFrame) -> DataFrame:
    """Per bug the number of crashes and their sorted inputs."""
    return deduped.groupBy("bug_id").agg(F.count("*").alias("n_crashes"), F.array_sort(F.collect_list("input_file")).alias("inputs"))

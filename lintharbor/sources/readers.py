"""Scans of all input formats. Readers never infer a schema."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import decode_trace, operand_constant, operand_flags
from ..operators.crashes import parse_reports

MOST_INPUT_BYTES = 1 << 20
#: Up to so many files a row for each is broadcast.
MOST_BROADCAST_FILES = 10_000


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.split(F.trim("value"), ",").alias("f"))


def _flag(f: Column) -> list[Column]:
    return [f[0].alias("tool"), f[1].alias("file"), f[2].cast("int").alias("line"), f[3].alias("vuln")]


def read_flags(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless findings with four fields; lines of another arity aren't findings. A set."""
    return _fields(spark.read.text(list(paths))).filter(F.size("f") == 4).select(*_flag(F.col("f"))).dropDuplicates()


def read_grouped_flags(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless grouped findings with nine fields. A set."""
    f = F.col("f")
    numbers = [f[i].cast("int").alias(c) for i, c in enumerate(("n_flg_lines", "n_all_lines", "n_run_tools", "n_all_tools"), 4)]
    return _fields(spark.read.text(list(paths))).filter(F.size("f") == 9).select(*_flag(f), *numbers, f[8].cast("double").alias("score")).dropDuplicates()


def read_targets(spark: SparkSession, *paths: str) -> DataFrame:
    """Targets (file, line, score) of grouped findings."""
    return read_grouped_flags(spark, *paths).select("file", "line", F.col("score").cast("float").alias("score"))


def read_inspection(spark: SparkSession, *paths: str) -> DataFrame:
    """The documents, each with its path as ``document``."""
    return spark.read.schema(schema.INSPECTION).option("multiLine", True).json(list(paths)).select("*", F.col("_metadata.file_path").alias("document"))


def functions_of(inspection: DataFrame) -> DataFrame:
    """One row per function; func_ord counts in document order, through all documents by path. Of functions of a document with the same file and name the last one's values count, in the first one's place."""
    if "document" not in inspection.columns:
        inspection = inspection.withColumn("document", F.lit(""))
    every = inspection.select("document").distinct()
    numbers = every.withColumn("nth", F.row_number().over(Window.orderBy("document")) - 1)  # a row per file
    rows = inspection.select("document", F.posexplode("functions").alias("at", "f")).join(numbers, "document")
    rows = rows.select("document", F.when(F.col("nth") == 0, F.col("at").cast("long")).otherwise(F.col("nth") * F.lit(1 << 32) + F.col("at")).alias("func_ord"), F.col("f.location.filename").alias("file"), F.col("f.name").alias("name"), F.col("f.location.line.start").alias("start"), F.col("f.location.line.end").alias("end"), F.col("f.LoC").alias("loc"), F.col("f.location.reachable_from_main").alias("reachable"), F.col("f.basic_blocks").alias("basic_blocks"))
    last = [F.max_by(c, "func_ord").alias(c) for c in ("start", "end", "loc", "reachable", "basic_blocks")]
    return rows.groupBy("document", "file", "name").agg(F.min("func_ord").alias("func_ord"), *last).select("func_ord", "file", "name", "start", "end", "loc", "reachable", "basic_blocks")


def blocks_of(functions: DataFrame) -> DataFrame:
    """One row per basic block of ``functions_of``, in document order."""
    rows = functions.select("*", F.posexplode("basic_blocks").alias("block_ord", "b")).drop("basic_blocks")
    return rows.select("*", F.col("b.id").alias("block_id"), F.col("b.location.line.start").alias("block_start"), F.col("b.location.line.end").alias("block_end"), F.col("b.LoC").alias("block_loc")).drop("b")


def read_sarif(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """Findings of SARIF 2.1.0 files. A result whose rule is unknown fails the read if ``strict``, else it is left out."""
    return sarif_findings(spark.read.schema(schema.SARIF).option("multiLine", True).json(list(paths)), strict)


def read_sarif_lines(spark: SparkSession, *paths: str, strict: bool = False) -> DataFrame:
    """The same for files that hold one document a line."""
    return sarif_findings(spark.read.schema(schema.SARIF).json(list(paths)), strict)


def sarif_findings(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Runs, results and locations, unnested; the rule's name is looked up within its run, the last of equal ids counting."""
    runs = documents.filter(F.col("version") == "2.1.0").select(F.explode("runs").alias("r"))
    rules = F.map_from_entries(F.transform(F.array_distinct(F.transform(F.col("r.tool.driver.rules"), lambda x: x["id"])), lambda i: F.struct(i, F.element_at(F.filter(F.col("r.tool.driver.rules"), lambda x: x["id"] == i), -1)["name"])))

    def name(known: Column, rule: Column) -> Column:
        out = F.try_element_at(known, rule)
        return F.coalesce(out, F.raise_error(F.concat(F.lit("unknown rule "), F.coalesce(rule, F.lit("null"))))) if strict else out

    def of(x: Column, vuln: Column) -> Column:
        return F.transform(F.coalesce(x["locations"]["physicalLocation"], F.array()), lambda p: F.struct(p["artifactLocation"]["uri"].alias("uri"), p["region"]["startLine"].alias("line"), vuln.alias("vuln")))

    # An array of one is for what is in it to be found once: the rules of a run, and the name of a result, even one without locations.
    def places(known: Column) -> Column:
        return F.flatten(F.flatten(F.transform(F.col("r.results"), lambda x: F.transform(F.array(name(known, x["ruleId"])), lambda vuln: of(x, vuln)))))

    # Unnesting copies the columns beside it to each row, and holds the rows of an array together: these are narrow.
    rows = runs.select(F.lower("r.tool.driver.name").alias("tool"), F.flatten(F.transform(F.array(rules), places)).alias("places")).select("tool", F.explode("places").alias("p"))
    file = F.element_at(F.split(F.regexp_replace(F.col("p.uri"), "/+$", ""), "/"), -1)
    return rows.select("tool", file.alias("file"), F.col("p.line").cast("int").alias("line"), F.col("p.vuln").alias("vuln")).filter("vuln is not null").dropDuplicates()


def read_json_findings(spark: SparkSession, tool: str, *paths: str) -> DataFrame:
    """An array of {file, line, bug_type}."""
    rows = spark.read.schema("file string, line int, bug_type string").option("multiLine", True).json(list(paths))
    return rows.select(F.lit(tool).alias("tool"), F.element_at(F.split(F.regexp_replace("file", "/+$", ""), "/"), -1).alias("file"), "line", F.col("bug_type").alias("vuln")).dropDuplicates()


def read_pass_findings(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV of a sanitizer pass: tool, file, ignored, line; there is no type."""
    f = F.col("f")
    rows = _fields(spark.read.text(list(paths)).filter(F.trim("value") != ""))
    return rows.select(f[0].alias("tool"), f[1].alias("file"), f[3].cast("int").alias("line"), F.lit("-").alias("vuln")).dropDuplicates()


#: Findings readers by the name of their source; more can be added.
FINDINGS_READERS: dict[str, Callable[..., DataFrame]] = {"flags": read_flags, "sarif": read_sarif, "sarif-lines": read_sarif_lines, "json": read_json_findings, "pass": read_pass_findings}


def user_code_measured(spark: SparkSession, *paths: str) -> DataFrame:
    """Of analysis metrics in SARIF, whether the last run reports any user lines of code: (path, ok)."""
    ddl = "runs array<struct<properties:struct<metricResults:array<struct<rule:struct<id:string>,ruleId:string,value:bigint>>>>>"
    rows = spark.read.schema(ddl).option("multiLine", True).json(list(paths))
    last = F.element_at("runs", -1)["properties"]["metricResults"]
    return rows.select(F.col("_metadata.file_path").alias("path"), F.exists(last, lambda m: m["ruleId"].contains("user-code") & (m["value"] > 0)).alias("ok"))


def read_reports(spark: SparkSession, *paths: str) -> DataFrame:
    """Sanitizer reports, one a file; those that don't parse are left out."""
    return parse_reports(spark.read.text(list(paths), wholetext=True))


def read_summary(spark: SparkSession, *paths: str) -> DataFrame:
    """Crash summaries: one row per crash. The options of a file are those of its first row. Files are read by line, so that they can be of any size."""
    names = schema.SUMMARY_COLUMNS
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    few = len(lines.inputFiles()) <= MOST_BROADCAST_FILES
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())  # the order within a file: splits, and lines within a split
    data = lines.select(F.col("_metadata.file_path").alias("path"), place.alias("at"), F.split(F.regexp_replace("value", "\r$", ""), ",").alias("f")).filter((F.size("f") == len(names)) & (F.col("f")[0] != "bug_id"))
    first = data.groupBy("path").agg(F.min_by(F.slice("f", 1, 4), "at").alias("o"))
    rows = data.select("path", "f").join(F.broadcast(first) if few else first, "path")
    f, o = F.col("f"), F.col("o")
    frames = F.when(o[1] != "-", o[1]).try_cast("int")
    flag = lambda i: F.lower(F.trim(o[i])) == "true"
    return rows.select(
        f[0].cast("int").alias("bug_id"), frames.alias("n_dedup_frames"), flag(2).alias("consider_filepaths"), flag(3).alias("consider_lines"),
        f[4].alias("input_file"), f[5].alias("sanitizer"), f[6].alias("vuln_type"), decode_trace(f[7]).alias("stack_trace"),
    )


def read_distance_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``rows:cols`` and then a line per row, separated by commas or white space; -1 is unreachable."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
    cells = lines.filter("at > 0").select((F.col("at") - 1).alias("row"), F.posexplode(F.filter(F.split(F.trim("line"), r"[,\s]+"), lambda x: x != "")).alias("col", "v"))
    return cells.select("row", "col", F.col("v").cast("int").alias("dist"))


def read_block_distances(spark: SparkSession, path: str) -> DataFrame:
    """``bb_id cbb_id dist {loc}`` after a line with the count."""
    p = r"^\s*(-?\d+)\s+(-?\d+)\s+(-?[\d.]+)\s+\{?(.*?)\}?\s*$"
    rows = spark.read.text(path).filter(F.col("value").rlike(p))
    return rows.select(*[F.regexp_extract("value", p, i + 1).cast(t).alias(c) for i, (c, t) in enumerate((("bb_id", "int"), ("cbb_id", "int"), ("dist", "double"), ("loc", "string")))])


def read_target_scores(spark: SparkSession, path: str) -> DataFrame:
    """``id score {loc}`` after a line with the count."""
    p = r"^\s*(\d+)\s+(-?[\d.]+)\s+\{?(.*?)\}?\s*$"
    rows = spark.read.text(path).filter(F.col("value").rlike(p))
    return rows.select(*[F.regexp_extract("value", p, i + 1).cast(t).alias(c) for i, (c, t) in enumerate((("target_id", "int"), ("score", "float"), ("loc", "string")))])


def read_conditions(spark: SparkSession, path: str) -> DataFrame:
    """Six tokens a line; ``none`` is null. flags: see ``operand_flags``; constant1, constant2: see ``operand_constant``."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") == 6)
    f = F.col("f")
    rows = rows.select(f[0].cast("int").alias("cnd_id"), F.when(f[1] != "none", f[1]).try_cast("int").alias("cbb_id"), f[2].alias("type1"), f[3].alias("type2"), f[4].alias("value1"), f[5].alias("value2"))
    constants = [operand_constant(F.col(f"value{i}")).alias(f"constant{i}") for i in (1, 2)]
    return rows.select("*", operand_flags(F.col("type2"), F.col("value1"), F.col("value2")).alias("flags"), *constants)


def read_seed_files(spark: SparkSession, root: str, most: int = MOST_INPUT_BYTES) -> DataFrame:
    """Seed files (path, len): empty ones and a README are skipped, one over ``most`` bytes fails the read."""
    rows = spark.read.format("binaryFile").load(root).select("path", F.col("length").alias("len"))
    rows = rows.filter((F.col("len") > 0) & ~F.col("path").endswith("/README.txt"))
    return rows.withColumn("len", F.when(F.col("len") <= most, F.col("len")).otherwise(F.raise_error(F.concat(F.lit("too large: "), "path")).cast("long"))).orderBy("path")


def read_traces(spark: SparkSession, *paths: str) -> DataFrame:
    """Trace dumps ``edge:class``, one file per execution: (file, edge, cls)."""
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), ":").alias("f")).filter(F.size("f") == 2)
    return rows.select("file", F.col("f")[0].cast("int").alias("edge"), F.col("f")[1].cast("int").alias("cls"))


def read_minimiser_traces(spark: SparkSession, *paths: str) -> DataFrame:
    """The minimiser's trace dumps, one file per execution, a line per pair of class and edge, which aren't separated: (file, tuple)."""
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("tuple"))
    return rows.filter("tuple <> ''").distinct()


def read_bitmap(spark: SparkSession, *paths: str) -> DataFrame:
    """Binary bitmaps as sparse rows (path, edge, value); zero bytes are left out."""
    rows = spark.read.format("binaryFile").load(list(paths)).select("path", F.hex("content").alias("h"))
    cells = rows.select("path", F.posexplode(F.regexp_extract_all("h", F.lit(".."), F.lit(0))).alias("edge", "b"))
    return cells.select("path", "edge", F.conv("b", 16, 10).cast("int").alias("value")).filter("value <> 0")


def find_files(spark: SparkSession, root: str, extensions: list[str] | None = None, recursive: bool = True, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """(path, len) of the files below ``root`` by extension, without those whose name is on the blacklist."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(e if e.startswith(".") else f".{e}" for e in extensions) + "}")
    rows = reader.load(root).select("path", F.col("length").alias("len"))
    return rows.filter(~F.element_at(F.split("path", "/"), -1).isin(*blacklist)) if blacklist else rows


def read_snapshots(spark: SparkSession, *paths: str) -> DataFrame:
    """``key : value`` files, one campaign instance each, as one typed row."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", "\r?\n"), lambda x: x.contains(":")).alias("lines"))
    entry = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, "^[^:]*:", "")))
    kv = rows.select("path", F.map_from_entries(F.transform("lines", entry)).alias("m"))
    value = lambda c: F.try_element_at("m", F.lit(c))
    numbers = [value(c).try_cast("long").alias(c) for c in schema.SNAPSHOT_NUMBERS]
    rates = [F.regexp_replace(value(c), "%$", "").try_cast("double").alias(c) for c in schema.SNAPSHOT_RATES]
    return kv.select("path", *numbers, *rates, *[value(c).alias(c) for c in ("target_mode", "command_line")])


def read_plot(spark: SparkSession, *paths: str) -> DataFrame:
    """The plotted series: a ``#`` header, fields separated by comma and blank, a percent sign after the map's share."""
    rows = spark.read.schema(schema.PLOT).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(list(paths))
    return rows.withColumn("map_size", F.regexp_replace("map_size", "%$", "").try_cast("double"))


def read_campaign_stats(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(schema.CAMPAIGN_STATS).option("header", True).csv(list(paths))


def resume_position(snapshot: DataFrame, queue_size: int) -> DataFrame:
    """Where a campaign goes on: cur_path, and 0 where that is beyond the queue."""
    return snapshot.select("path", F.when(F.col("cur_path") < queue_size, F.col("cur_path")).otherwise(0).alias("position"))


def lineage(names: DataFrame, column: str = "name") -> DataFrame:
    """File names of seeds and crashes (``id:000001,src:...,op:...,+cov``) as typed columns."""
    parts = F.split(F.element_at(F.split(column, "/"), -1), ",")
    entries = F.transform(F.filter(parts, lambda x: x.contains(":")), lambda x: F.struct(F.substring_index(x, ":", 1), F.regexp_replace(x, "^[^:]*:", "")))
    m = names.select(column, F.map_from_entries(entries).alias("m"), F.array_contains(parts, "+cov").alias("new_coverage"))
    number = lambda k: F.try_element_at("m", F.lit(k)).try_cast("long")
    sources = F.transform(F.split(F.try_element_at("m", F.lit("src")), r"\+"), lambda x: x.try_cast("long"))
    return m.select(column, number("id").alias("id"), sources.alias("src"), F.try_element_at("m", F.lit("op")).alias("op"), number("pos").alias("pos"), F.try_element_at("m", F.lit("val")).alias("val"), number("rep").alias("rep"), F.try_element_at("m", F.lit("sync")).alias("sync"), "new_coverage")


def load_config(path: str) -> dict:
    """A driver-side configuration: JSON, or YAML where that library is installed."""
    text = open(path, encoding="utf-8").read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)

"""Findings: set operations, the reachability filter, and scoring per block or function.

Interval joins are equi-joins: ranges are spread to the bins of lines that they touch, small bins for short ranges and large ones for long ranges, so
that a plan hashes on (file, bin) instead of comparing all pairs of a file, and a range of a million lines is a few hundred rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import joined_set, label, raw_score, round3

FLAG = ["tool", "file", "line", "vuln"]
GROUPED = [*FLAG, "n_flg_lines", "n_all_lines", "n_run_tools", "n_all_tools", "score"]


@dataclass(frozen=True)
class Weights:
    flags: float = 0.5
    tools: float = 0.5


def union(*flags: DataFrame) -> DataFrame:
    """The set union."""
    out = flags[0]
    for f in flags[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates()


def remove(flags: DataFrame, gone: DataFrame) -> DataFrame:
    """The findings that aren't in ``gone``; null fields compare as equal."""
    return flags.exceptAll(flags.intersect(gone)) if set(flags.columns) != set(gone.columns) else flags.subtract(gone.select(*flags.columns))


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets are equal."""
    b = b.select(*a.columns)
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


#: Lines of a bin; ranges of so many lines as a large bin go to large bins.
BINS = (64, 4096)


def within(points: DataFrame, ranges: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Each of ``points`` (keys, line, ...) with every range of ``ranges`` (keys, start, end, ...) that holds its line; a range's own columns follow."""
    place = lambda x, size: F.floor(x / F.lit(size)).cast("long")
    level = [F.struct(F.lit(i).alias("level"), place(F.col("line"), size).alias("bin")) for i, size in enumerate(BINS)]
    left = points.select("*", F.explode(F.array(*level)).alias("_p")).select(*points.columns, F.col("_p.level").alias("_level"), F.col("_p.bin").alias("_bin"))
    long = F.col(end).cast("long") - F.col(start).cast("long") >= BINS[1]
    bins = F.when(long, F.sequence(place(F.col(start), BINS[1]), place(F.col(end), BINS[1]))).otherwise(F.sequence(place(F.col(start), BINS[0]), place(F.col(end), BINS[0])))
    right = ranges.filter(F.col(end) >= F.col(start)).select("*", long.cast("int").alias("_level"), F.explode(bins).alias("_bin"))
    met = left.join(right, [*keys, "_level", "_bin"]).filter((F.col("line") >= F.col(start)) & (F.col("line") <= F.col(end)))
    return met.select(*points.columns, *[c for c in ranges.columns if c not in points.columns])


def reachable(flags: DataFrame, functions: DataFrame) -> DataFrame:
    """The findings on a line of a function that is reachable from the entry."""
    lines = within(flags.select("file", "line").distinct(), functions.filter("reachable").select("file", "start", "end"), "start", "end", ["file"])
    return flags.join(lines.select("file", "line"), ["file", "line"], "left_semi").select(*flags.columns)


def _first_match(flags: DataFrame, ranges: DataFrame, start: str, end: str, order: list[str], keep: list[str]) -> DataFrame:
    """Each distinct (file, line) of the findings with the first range, by ``order``, that holds it, joined back to the findings."""
    names = list(dict.fromkeys([*order, *keep]))
    met = within(flags.select("file", "line").distinct(), ranges.select("file", *dict.fromkeys([start, end, *names])), start, end, ["file"])
    first = met.groupBy("file", "line").agg(F.min(F.struct(*names)).alias("_m"))
    return flags.join(first, ["file", "line"]).select(*flags.columns, *[F.col(f"_m.{c}").alias(c) for c in names])


def _with_total(rows: DataFrame, flags: DataFrame) -> DataFrame:
    """n_all_tools: over all findings, the unmatched ones too. One row, so a cross join."""
    return rows.crossJoin(F.broadcast(flags.agg(F.countDistinct("tool").cast("int").alias("n_all_tools"))))


def _score(rows: DataFrame, weights: Weights, rounded: bool) -> DataFrame:
    x = raw_score(F.col("n_flg_lines"), F.col("n_all_lines"), F.col("n_run_tools"), F.col("n_all_tools"), weights.flags, weights.tools)
    return rows.withColumn("score", round3(x) if rounded else x).select(*GROUPED).dropDuplicates()


def _counts(line: str = "line") -> list[Column]:
    return [F.countDistinct(line).cast("int").alias("n_flg_lines"), F.countDistinct("tool").cast("int").alias("n_run_tools")]


def _names() -> list[Column]:
    return [joined_set(F.col("tool")).alias("tool_set"), joined_set(label(F.col("vuln"), F.col("line"))).alias("vuln_set")]


def _named(rows: DataFrame, line: Column, lines: str) -> DataFrame:
    return rows.select(F.col("tool_set").alias("tool"), "file", line.cast("int").alias("line"), F.col("vuln_set").alias("vuln"), "n_flg_lines", F.col(lines).cast("int").alias("n_all_lines"), "n_run_tools", "n_all_tools")


def group_by_block(flags: DataFrame, blocks: DataFrame, weights: Weights = Weights(), rounded: bool = True) -> DataFrame:
    """Findings per basic block: each belongs to the first block, in document order, that holds its line."""
    met = _first_match(flags.dropDuplicates(), blocks, "block_start", "block_end", ["func_ord", "block_ord"], ["block_start", "block_end", "block_loc"])
    rows = met.groupBy("file", "func_ord", "block_ord", "block_start", "block_loc").agg(*_names(), *_counts())
    return _score(_named(_with_total(rows, flags), F.col("block_start"), "block_loc"), weights, rounded)


def group_by_function(flags: DataFrame, functions: DataFrame, weights: Weights = Weights(), rounded: bool = True) -> DataFrame:
    """Findings per function, the first that holds the line; the reported line is the one after the function's start."""
    met = _first_match(flags.dropDuplicates(), functions, "start", "end", ["func_ord"], ["start", "loc"])
    rows = met.groupBy("file", "func_ord", "start", "loc").agg(*_names(), *_counts())
    return _score(_named(_with_total(rows, flags), F.col("start") + 1, "loc"), weights, rounded)


def group_by_function_blocks(flags: DataFrame, functions: DataFrame, blocks: DataFrame, weights: Weights = Weights(), rounded: bool = True) -> DataFrame:
    """A row per flagged block, with the counts and the score of its function; names are the block's own. Blocks of the same range are one."""
    met = _first_match(flags.dropDuplicates(), functions, "start", "end", ["func_ord"], ["loc"])
    counts = met.groupBy("func_ord", "loc").agg(*_counts())
    ranges = blocks.select("func_ord", F.col("block_start").cast("long").alias("block_start"), F.col("block_end").cast("long").alias("block_end"), "block_loc").distinct()
    rows = within(met.drop("loc"), ranges, "block_start", "block_end", ["func_ord"]).groupBy("file", "func_ord", "block_start", "block_end", "block_loc").agg(*_names())
    rows = rows.join(counts, "func_ord")
    return _score(_named(_with_total(rows, flags), F.col("block_start"), "loc"), weights, rounded)


#: Filters and groupings by name: functions of (flags, functions, blocks, ...).
FILTERS: dict[str, Callable[..., DataFrame]] = {"reachability": lambda flags, functions, blocks: reachable(flags, functions)}
GROUPINGS: dict[str, Callable[..., DataFrame]] = {
    "basic_block": lambda flags, functions, blocks, *a, **k: group_by_block(flags, blocks, *a, **k),
    "basic_block_v2": group_by_function_blocks,
    "function": lambda flags, functions, blocks, *a, **k: group_by_function(flags, functions, *a, **k),
}


def findings_pipeline(flags: DataFrame, functions: DataFrame, blocks: DataFrame, filters: tuple[str, ...] = ("reachability",), grouping: str | None = "basic_block", **options) -> DataFrame:
    """Filters in their order, then a grouping."""
    for name in filters:
        flags = FILTERS[name](flags, functions, blocks)
    return GROUPINGS[grouping](flags, functions, blocks, **options) if grouping else flags


def match_targets(instructions: DataFrame, targets: DataFrame) -> DataFrame:
    """Instructions (block_id, path, line, ordinal) on a target's line, where the target's file stands in the path at its start or after a slash; the first target of a block counts."""
    keyed = targets.select(F.element_at(F.split("file", "/"), -1).alias("_base"), "line", F.col("file").alias("target"), "score")
    base = F.element_at(F.split("path", "/"), -1)
    met = instructions.withColumn("_base", base).join(keyed, ["_base", "line"])
    at = F.instr(F.col("path"), F.col("target"))
    met = met.filter((at == 1) | ((at > 1) & (F.substr("path", at - 1, F.lit(1)) == "/")))
    return met.groupBy("block_id").agg(F.min(F.struct("ordinal", "target", "line", "score")).alias("m")).select("block_id", F.col("m.target").alias("file"), "m.line", "m.score")


def line_statistics(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(file, function, block_id, line) and the functions (file, function, first), with the line at which each is declared -> first and last line and number of distinct lines per block.

    Lines before the function's first are out of scope, and a block of which nothing is left has no row, nor has one of a function that is only declared (without a first line)."""
    scoped = lines.filter("line > 0").join(functions.select("file", "function", "first"), ["file", "function"]).filter("line >= first")
    return scoped.groupBy("file", "function", "block_id").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.countDistinct("line").alias("loc"))


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """The rows with a ``rank`` from 1 in an order that the seed determines, ties by key: the same wherever the rows lie."""
    from .graph import dense_index

    marked = rows.withColumn("_draw", F.xxhash64(F.lit(seed), key))
    return dense_index(marked, ["_draw", key], "rank").withColumn("rank", F.col("rank") + 1).drop("_draw")

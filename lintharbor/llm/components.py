"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, join_unique, materialize, work_dir

#: Rounds grow with the logarithm of the largest component; this only guards against an endless loop.
MAX_ROUNDS = 60


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _star(pairs: DataFrame, path: str) -> DataFrame:
    """Each row (u, v) with the least neighbour of u, or u itself, as m; a hub's rows don't meet in one task."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return join_unique(pairs, materialize(least, path), "u", "n", F.col("v"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of one task's edges (u, v), by union and find."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    names, kind = None, None
    for batch in batches:
        kind = batch.schema.field("u").type
        names = [f.name for f in kind] if pa.types.is_struct(kind) else None
        plain = (lambda column: list(zip(*(column.field(n).to_pylist() for n in names), strict=True))) if names else (lambda column: column.to_pylist())
        for u, v in zip(plain(batch.column("u")), plain(batch.column("v")), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    if parent:
        value = (lambda x: dict(zip(names, x, strict=True))) if names else (lambda x: x)
        yield pa.RecordBatch.from_arrays([pa.array([value(x) for x in parent], kind), pa.array([value(root(x)) for x in list(parent)], kind)], names=["node", "component"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", in_one_task: int = 0) -> DataFrame:
    """``edges`` (src, dst) -> (node, component), component being the least node reachable.

    Up to ``in_one_task`` counted edges are settled by a single task, which saves the rounds of a small graph; the result is the same.
    Nulls and self-loops give no edge: a node that has only these isn't listed. Repeated edges count once. No edges: no rows."""
    spark = edges.sparkSession
    root = work_dir(spark, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
    now = materialize(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{root}/e0")
    seen = _fingerprint(now)
    if 0 < seen[0] <= in_one_task:
        bounded_batches(spark)
        kind = now.schema["u"].dataType.simpleString()
        return now.coalesce(1).mapInArrow(_forest, f"node {kind}, component {kind}")
    for i in range(MAX_ROUNDS if seen[0] else 0):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, f"{root}/l{i}").filter("v > u and m is not null").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), f"{root}/s{i}")
        starred = _star(large, f"{root}/t{i}")
        small = starred.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(starred.select(F.col("u").alias("a"), F.col("m").alias("b")))
        small = small.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        following = materialize(small, f"{root}/e{i + 1}")
        for x in ("e", "l", "s", "t"):
            discard(spark, f"{root}/{x}{i}")
        now, before, seen = following, seen, _fingerprint(following)
        if seen == before:
            break
    else:
        if seen[0]:
            raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

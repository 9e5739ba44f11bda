"""Graphs: reachability, distances, taint and critical blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import shared_folder
from . import searches


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iteration by a checkpoint in the shared folder; in a local session without one, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def block_edges(instruction_edges: DataFrame, block_of: DataFrame) -> DataFrame:
    """Edges between instructions -> (src, dst) between blocks, self-loops kept. block_of: (node, block_id)."""
    a, b = block_of.toDF("src_node", "src"), block_of.toDF("dst_node", "dst")
    return instruction_edges.toDF("src_node", "dst_node").join(a, "src_node").join(b, "dst_node").select("src", "dst").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("dst"))


def distances(edges: DataFrame, sources: DataFrame, backward: bool = False, start: int = 0, most_rounds: int = 10_000) -> DataFrame:
    """Least number of hops from any source to a node, plus ``start``: (source, node, dist). sources: (source, node).

    Breadth first: a round joins the last frontier with the edges and keeps what wasn't reached before."""
    step = (edges.select(F.col("dst").alias("node"), F.col("src").alias("to")) if backward else edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))).distinct()
    seen = _cut(sources.select("source", "node", F.lit(start).alias("dist")).dropDuplicates(["source", "node"]))
    frontier = seen
    for d in range(start + 1, start + most_rounds + 1):
        reached = frontier.join(step, "node").select("source", F.col("to").alias("node")).distinct()
        frontier = _cut(reached.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("dist", F.lit(d)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if (d - start) % 8 == 0:
            seen = _cut(seen)
    raise RuntimeError("the search did not end")


def reachable_nodes(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes reachable from the entries (node), these among them."""
    return distances(edges, entries.select(F.lit(0).alias("source"), "node")).select("node").distinct()


def function_distances(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """Call-graph distance of each function to each target's function, which itself is at 1; the cost is ten times that. targets: (source, node)."""
    return distances(calls, targets, backward=True, start=1).withColumn("cost", F.col("dist") * 10)


def harmonic(rows: DataFrame, by: list[str], dist: str = "dist") -> DataFrame:
    """1 / sum(1 / d) over positive distances."""
    return rows.filter(F.col(dist) > 0).groupBy(*by).agg((1 / F.sum(1.0 / F.col(dist))).alias("distance"))


def tainted(edges: DataFrame, targets: DataFrame, back_edges: DataFrame | None = None) -> DataFrame:
    """Blocks (node) that can reach a target (node); loop back edges (src, dst) don't count."""
    if back_edges is not None:
        edges = edges.join(back_edges, ["src", "dst"], "left_anti")
    return distances(edges, targets.select(F.lit(0).alias("source"), "node"), backward=True).select("node").distinct()


def critical_blocks(edges: DataFrame, taint: DataFrame) -> DataFrame:
    """Tainted blocks with several successors, some of them untainted: (src, dst, value), value 1 for a diverged edge and 2 for a solved one."""
    edges = edges.select("src", "dst").distinct()
    marked = edges.join(taint.select(F.col("node").alias("src")), "src", "left_semi").join(taint.select(F.col("node").alias("dst"), F.lit(2).alias("value")), "dst", "left")
    marked = marked.select("src", "dst", F.coalesce("value", F.lit(1)).alias("value"))
    per = marked.groupBy("src").agg(F.count("*").alias("n"), F.min("value").alias("least"))
    return marked.join(per.filter("n > 1 and least = 1").select("src"), "src", "left_semi")


def nearest_callees(calls: DataFrame, function_distance: DataFrame) -> DataFrame:
    """Of each block that calls (node, callee, and ordinal where calls are ordered), the callee of least distance, of equal ones the first: (node, callee, distance), ten times the function's (node, distance)."""
    known = function_distance.select(F.col("node").alias("callee"), (F.col("distance") * 10).alias("distance"))
    order = ["distance", "ordinal", "callee"] if "ordinal" in calls.columns else ["distance", "callee"]
    return calls.join(known, "callee").groupBy("node").agg(F.min(F.struct(*order)).alias("m")).select("node", "m.callee", "m.distance")


def block_distances(edges: DataFrame, targets: DataFrame, nearest: DataFrame) -> DataFrame:
    """Harmonic distance of blocks within their function's graph: (node, distance).

    A target (node) is at 0 and a call block at its nearest callee's distance (see ``nearest_callees``); another block that reaches some of these is at 1 / sum(1 / (hops + distance)).
    The pairs of block and given block, whose number is the product of both, are summed up as they are found; only a graph that doesn't fit in a task has them written."""
    given = nearest.join(targets.select("node"), "node", "left_anti").select("node", F.col("distance").cast("double").alias("distance")).unionByName(targets.select("node", F.lit(0.0).alias("distance")).distinct())
    edges = edges.dropna(subset=["src", "dst"])
    search = searches.backward(edges, given)
    if search:
        far = search.sums(given.filter("distance is not null").select(F.array("node").alias("nodes"), F.col("distance").alias("base"))).groupBy("node").agg((1 / F.sum("part")).alias("distance"))
        return given.unionByName(far)
    hops = distances(edges, given.select(F.col("node").alias("source"), "node"), backward=True).join(given.select("node"), "node", "left_anti")
    far = hops.join(given.toDF("source", "base"), "source").groupBy("node").agg((1 / F.sum(1 / (F.col("dist") + F.col("base")))).alias("distance"))
    return given.unionByName(far)


def block_target_distances(edges: DataFrame, targets: DataFrame, calls: DataFrame, function_cost: DataFrame, mode: str = "parity", function_distance: DataFrame | None = None) -> DataFrame:
    """Distance of blocks to targets within their function's graph, and over call blocks: (node, target, dist).

    targets: (target, node). calls: (node, callee); function_cost: (source, node, cost), the distances of the callees to targets. With ``parity`` a call block has
    the distances of its nearest callee, by function_distance (node, distance) or else by the harmonic mean of the costs, a target without calls has itself at 0, and any other block that
    reaches one of these has it as a column, a call block under ``call:`` and its number. With ``composed`` the callee's cost is added and the target kept."""
    costs = function_cost.select(F.col("node").alias("callee"), F.col("source").alias("target"), "cost")
    if mode == "composed":
        own = distances(edges, targets.select(F.col("target").alias("source"), "node"), backward=True).select("node", F.col("source").alias("target"), "dist")
        through = calls.join(costs, "callee").groupBy("node", "target").agg(F.min("cost").alias("cost"))
        hops = distances(edges, through.select(F.col("node").alias("source"), "node").distinct(), backward=True)
        far = hops.join(through.withColumnRenamed("node", "source"), "source").select("node", "target", (F.col("dist") + F.col("cost")).alias("dist"))
        rows = own.unionByName(far)
    elif mode == "parity":
        if function_distance is None:
            function_distance = harmonic(function_cost, ["node"], "cost")
        nearest = nearest_callees(calls, function_distance)
        plain = targets.select(F.col("target").cast("string").alias("target"), "node").join(nearest.select("node"), "node", "left_anti")
        called = nearest.join(costs, "callee").select("node", F.col("target").cast("string").alias("target"), F.col("cost").cast("double").alias("dist"))
        names = plain.select("node", "target").unionByName(nearest.select("node", F.concat(F.lit("call:"), F.col("node").cast("string")).alias("target")))
        edges = edges.dropna(subset=["src", "dst"])
        search = searches.backward(edges, names)
        if search:  # a row for each pair of block and target, found once and written by no step
            far = search.pairs(names.groupBy("target").agg(F.collect_set("node").alias("nodes")))
        else:
            hops = distances(edges, names.select(F.col("node").alias("source"), "node").distinct(), backward=True).join(names.select("node").distinct(), "node", "left_anti")
            far = hops.join(names.select(F.col("node").alias("source"), "target"), "source").groupBy("node", "target").agg(F.min("dist").cast("double").alias("dist"))
        near = called.unionByName(plain.select("node", "target", F.lit(0.0).alias("dist")))  # of other blocks than far
        return far.unionByName(near.groupBy("node", "target").agg(F.min("dist").alias("dist")))
    else:
        raise ValueError(f"no mode {mode!r}")
    return rows.groupBy("node", "target").agg(F.min("dist").alias("dist"))


def dense_index(nodes: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Stable dense numbers from 0 in the order of a key. The numbers of a range partition start at the sum of those before it."""
    ranged = nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = _cut(ranged)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row per partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_k", within).join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_k") - 1).drop("_part", "_k", "_base")


def distance_matrix(dist: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(row, col, dist) from (node, target, dist) and the numberings rows (node, index) and cols (target, index)."""
    r, c = rows.select("node", F.col("index").alias("row")), cols.select("target", F.col("index").alias("col"))
    return dist.join(r, "node").join(c, "target").groupBy("row", "col").agg(F.min("dist").alias("dist"))

"""Streaming variants: novelty by edge, the targets' states by campaign, and the import of peers' seeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import hit_bucket
from ..operators.directed import TargetStates
from ..shipping import ship

TRACE = "exec_id long, edge int, cnt int"


def read_trace_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def novelty_stream(traces: DataFrame) -> DataFrame:
    """(exec_id, edge, novelty) for every row that shows a new edge (2) or a new bucket of a known one (1), by a mask of seen buckets per edge.

    Rows of a micro-batch are taken in order of exec_id; between batches the order is that of arrival."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mask, rows = (state.get[0] if state.exists else 0), []
        for exec_id, bucket in pd.concat(list(batches)).sort_values("exec_id")[["exec_id", "bucket"]].itertuples(index=False):
            if not mask & int(bucket):
                rows.append((exec_id, key[0], 1 if mask else 2))
                mask |= int(bucket)
        state.update((mask,))
        yield pd.DataFrame(rows, columns=["exec_id", "edge", "novelty"])

    ship(traces.sparkSession)
    rows = traces.filter("cnt > 0").select("exec_id", "edge", hit_bucket(F.col("cnt")).alias("bucket"))
    return rows.groupBy("edge").applyInPandasWithState(update, "exec_id long, edge int, novelty int", "mask int", "append", GroupStateTimeout.NoTimeout)


def discovered(traces: DataFrame) -> DataFrame:
    """Each (edge, bucket) once, where only discovery matters: no state but the keys."""
    return traces.filter("cnt > 0").select("edge", hit_bucket(F.col("cnt")).alias("bucket")).dropDuplicates(["edge", "bucket"])


def target_state_stream(cycles: DataFrame, scores: dict[int, float], threshold: float = 0.5) -> DataFrame:
    """The targets' states after every cycle of a stream (campaign, cycle, inputs, solved, exhausted, hits map<bigint,bigint>)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = TargetStates(scores, threshold)
        if state.exists:
            for t, values in zip(states.targets, zip(*state.get, strict=True), strict=True):
                states.targets[t].update(zip(("state", "execs", "skips", "previous"), values, strict=True))
        rows = []
        for r in pd.concat(list(batches)).sort_values("cycle").to_dict("records"):
            mode = states.step(int(r["inputs"]), dict(r["hits"] or {}), bool(r["solved"]), bool(r["exhausted"]))
            rows += [(key[0], *x) for x in states.rows(int(r["cycle"]), mode)]
        now = list(states.targets.values())
        state.update(tuple([x[c] for x in now] for c in ("state", "execs", "skips", "previous")))
        yield pd.DataFrame(rows, columns=["campaign", "cycle", "mode", "target_id", "state", "execs", "skips", "previous"])

    ship(cycles.sparkSession)
    kind = dict(cycles.dtypes)["campaign"]
    out = f"campaign {kind}, cycle int, mode string, target_id long, state string, execs long, skips long, previous long"
    held = "state array<string>, execs array<long>, skips array<long>, previous array<long>"
    return cycles.groupBy("campaign").applyInPandasWithState(update, out, held, "append", GroupStateTimeout.NoTimeout)


def peer_seeds(spark: SparkSession, root: str) -> DataFrame:
    """New seed files of all peers below ``root/<peer>/queue/id:NNNNNN...``: (peer, id, path, len). The checkpoint is the high-water mark."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "id:*").option("recursiveFileLookup", True).load(root)
    part = F.split("path", "/")
    return files.select(F.element_at(part, -3).alias("peer"), F.regexp_extract(F.element_at(part, -1), r"id(?::|%3A)(\d+)", 1).cast("long").alias("id"), "path", F.col("length").alias("len"))


def new_peer_seeds(found: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batch form: seeds (peer, id, ...) at or above each peer's mark (peer, next_id), and the marks after them."""
    rows = found.join(marks, "peer", "left").filter(F.col("id") >= F.coalesce("next_id", F.lit(0))).drop("next_id")
    top = rows.groupBy("peer").agg((F.max("id") + 1).alias("_next"))
    following = marks.join(top, "peer", "full").select("peer", F.coalesce("_next", "next_id").alias("next_id"))
    return rows, following

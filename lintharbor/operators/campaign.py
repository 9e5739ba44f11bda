"""Campaign telemetry: roll-ups over instances and series over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

SMOOTHING, JUMP = 16, 5


def instances(snapshots: DataFrame, now: int) -> DataFrame:
    """Per instance: run time, whole executions per second, the share of paths done in percent, days and hours. ``alive`` is a column."""
    rows = snapshots.withColumn("run_time", F.lit(now).cast("long") - F.col("start_time"))
    whole = lambda a, b: F.expr(f"try_divide({a}, {b})").cast("long")
    return rows.select(
        "*", F.coalesce(whole("execs_done", "run_time"), F.lit(0).cast("long")).alias("execs_per_sec_whole"), F.coalesce(whole("cur_path * 100", "paths_total"), F.lit(0).cast("long")).alias("path_percent"),
        F.expr("run_time div 86400").alias("days"), F.expr("(run_time div 3600) % 24").alias("hours"),
    )


def rollup(snapshots: DataFrame, now: int, by: list[str] | None = None) -> DataFrame:
    """Totals over living instances; dead ones are only counted. One row, or one for each group."""
    rows = instances(snapshots, now)
    live = lambda c: F.coalesce(F.sum(F.when(F.col("alive"), F.col(c))), F.lit(0)).cast("long")
    out = rows.groupBy(*(by or [])).agg(
        F.count_if("alive").alias("n_alive"), F.count_if(~F.col("alive")).alias("n_dead"), live("run_time").alias("total_time"), live("execs_done").alias("total_execs"),
        live("execs_per_sec_whole").alias("total_rate"), live("pending_favs").alias("pending_favs"), live("pending_total").alias("pending_total"), live("unique_crashes").alias("crashes"),
    )
    mean = lambda c: F.when(F.col("n_alive") > 0, F.expr(f"{c} div greatest(n_alive, 1)"))
    return out.select("*", F.expr("total_time div 86400").alias("days"), F.expr("(total_time div 3600) % 24").alias("hours"), mean("pending_favs").alias("mean_pending_favs"), mean("pending_total").alias("mean_pending_total"))


def change_only(series: DataFrame, key: str, order: list[str], tracked: list[str]) -> DataFrame:
    """The rows at which any tracked column differs from the row before; the first row of a key is one."""
    before = F.lag(F.struct(*tracked)).over(Window.partitionBy(key).orderBy(*order))
    return series.withColumn("_before", before).filter(~F.col("_before").eqNullSafe(F.struct(*tracked)) | F.col("_before").isNull()).drop("_before")


def every(series: DataFrame, key: str, at: str, seconds: int = 900) -> DataFrame:
    """The first row of each bucket of ``seconds``."""
    w = Window.partitionBy(key, F.floor(F.col(at) / seconds)).orderBy(at)
    return series.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def latest(series: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key: its snapshot."""
    return series.groupBy(key).agg(F.max_by(F.struct(*series.columns), at).alias("r")).select("r.*")


def execution_rate(series: DataFrame, key: str, at_ms: str, execs: str, start_ms: str) -> DataFrame:
    """The smoothed rate at every row: an exponential mean by a sixteenth that is set anew when the rate is five times off.

    The recurrence is a fold over a key's rows: a campaign instance has one row per few seconds."""

    def fold(pdf):
        rate, last_at, last_n, out = 0.0, None, 0, []
        pdf = pdf.sort_values([at_ms, execs])
        for at, n, start in pdf[[at_ms, execs, start_ms]].itertuples(index=False):
            if not last_n:
                rate = n * 1000 / (at - start) if at > start else 0.0
            elif at > last_at:
                now = (n - last_n) * 1000 / (at - last_at)
                if now * JUMP < rate or now / JUMP > rate:
                    rate = now
                rate = rate * (1 - 1 / SMOOTHING) + now / SMOOTHING
            out.append(rate)
            last_at, last_n = at, n
        return pdf[[key, at_ms, execs]].assign(rate=out)

    ship(series.sparkSession)
    kinds = dict(series.dtypes)
    return series.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {at_ms} {kinds[at_ms]}, {execs} {kinds[execs]}, rate double")


def stage_yield(finds: DataFrame) -> DataFrame:
    """Finds per kind of change: (op) -> n and those with new coverage."""
    return finds.groupBy("op").agg(F.count("*").alias("n"), F.count_if("new_coverage").alias("n_new_coverage"))

"""Shared plumbing of the training-data operators: shared work folders, written stages and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: A key is hot from this share of the rows on, so that at most ``HOT_SHARE`` keys are: the proven bound of what is broadcast.
HOT_SHARE = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder in local mode and the warehouse folder on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if (spark.sparkContext.master or "").startswith("local[") or spark.sparkContext.master == "local":
            base = "file://" + tempfile.mkdtemp(prefix="lintharbor-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{base.rstrip('/')}/lintharbor/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def sweep(spark: SparkSession, folder: str) -> None:
    """Delete what this application's operators have written under ``folder`` (``spark.checkpoint.dir``), once no result of theirs is read any more.

    Results are lazy and read written tables, so an operator can't delete these itself."""
    discard(spark, f"{folder.rstrip('/')}/lintharbor/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str, *names: str) -> None:
    """Delete a table of the work folder, or those of the given names in it, that no later step reads."""
    for each in [f"{path}/{n}" for n in names] or [path]:
        target = spark._jvm.org.apache.hadoop.fs.Path(each)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Before Python runs on executors: ship the package to them, and hold Arrow batches to about ``size`` bytes (or one row), so that long texts don't fill a worker.

    The setting stays, because the operators' results are evaluated later; a smaller one of the caller's is left alone. The number of rows isn't touched."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under column names that can't clash with an operator's own, and the new name of each column."""
    inner = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*inner.values()), inner


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, salt: Column) -> DataFrame:
    """Left join to ``right``, which has one row for each ``key``, without sending a hot key's rows to one task.

    ``weight``: right's column with the number of left rows of the key; it is dropped. Keys with at least a thousandth of
    the summed weight (there are a thousand of them at most) are broadcast, and their rows dealt out by ``salt``; the
    others are joined by a shuffle. ``right`` should be a written table: it is read three times."""
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    if not total:
        gone = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in (key, weight)]
        return left.select("*", *gone)
    values = [c for c in right.columns if c not in (key, weight)]
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    hot = right.filter(is_hot).select(key, F.struct(*values).alias("_hot"))
    cold = right.filter(~is_hot).select(key, F.lit(0).alias("_salt"), F.struct(*values).alias("_cold"))
    marked = left.join(F.broadcast(hot), key, "left")
    dealt = F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(salt), F.lit(65521)).cast("int")).otherwise(0)
    joined = marked.withColumn("_salt", dealt).join(cold, [key, "_salt"], "left")
    picked = F.coalesce("_hot", "_cold")
    return joined.select(*left.columns, *[picked[c].alias(c) for c in values])

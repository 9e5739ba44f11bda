"""The shared plumbing: joins on hot keys, byte-bounded batches, work folders."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from lintharbor.llm import _common


def test_join_on_hot_keys_against_plain_lookup(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, 7, 7, 7, r.randrange(300)])) for i in range(3000)]
    left = spark.createDataFrame(rows, "i long, k long").repartition(5)
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 = 1").withColumn("v", F.concat(F.lit("v"), F.col("k").cast("string")))
    out = _common.join_unique(left, right, "k", "n", F.col("i"))
    assert out.columns == ["i", "k", "v"]
    assert sorted(map(tuple, out.collect())) == sorted((i, k, f"v{k}" if k is not None and k % 2 else None) for i, k in rows)
    none = _common.join_unique(left, right.limit(0), "k", "n", F.col("i"))
    assert none.columns == ["i", "k", "v"] and none.filter("v is not null").count() == 0 and none.count() == 3000


def test_batches_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    _common.bounded_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1_000_000).alias("t"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 6_000_000
    kept = spark.conf.get(key)
    spark.conf.set(key, "1000")
    _common.bounded_batches(spark)
    assert spark.conf.get(key) == "1000"  # a smaller one of the caller's
    spark.conf.set(key, kept)


def test_work_folders_can_be_dropped(spark, tmp_path):
    name = spark.sparkContext.applicationId
    path = f"{tmp_path}/lintharbor/{name}/x"
    _common.materialize(spark.range(3), f"{path}/a")
    _common.materialize(spark.range(3), f"{path}/b")
    _common.discard(spark, path, "a", "missing")
    assert os.listdir(path) == ["b"]
    _common.sweep(spark, str(tmp_path))
    assert os.listdir(f"{tmp_path}/lintharbor") == []
    assert f"/lintharbor/{name}/y-" in _common.work_dir(spark, "y")

"""Streams against their batch twins."""

from pyspark.sql import functions as F

from lintharbor import streaming
from lintharbor.operators import coverage, directed


def drain(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_novelty(spark, tmp_path):
    rows = [(1, 5, 1), (1, 6, 1), (2, 5, 1), (3, 5, 9), (4, 7, 1)]
    batch = spark.createDataFrame(rows, streaming.TRACE)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = drain(streaming.novelty_stream(streaming.read_trace_stream(spark, str(tmp_path / "in"))), "novelty", tmp_path)
    best = {r.exec_id: r.n for r in out.groupBy("exec_id").agg(F.max("novelty").alias("n")).collect()}
    assert best == {r.exec_id: r.novelty for r in coverage.novelty(batch).collect() if r.novelty}


def test_target_states(spark, tmp_path):
    ddl = "campaign string, cycle int, inputs long, solved boolean, exhausted boolean, hits map<bigint,bigint>"
    rows = [("a", i, 100, False, False, {1: i} if i % 3 == 0 else {}) for i in range(1, 6)]
    batch = spark.createDataFrame(rows, ddl)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.25)], "campaign string, target_id long, score double")
    out = drain(streaming.target_state_stream(stream, {1: 0.5, 2: 0.25}), "states", tmp_path)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, directed.target_state_machine(batch, targets).collect()))


def test_peer_marks(spark):
    found = spark.createDataFrame([("p", 1), ("p", 2), ("q", 0)], "peer string, id long")
    rows, marks = streaming.new_peer_seeds(found, spark.createDataFrame([("p", 2), ("r", 4)], "peer string, next_id long"))
    assert {tuple(r) for r in rows.select("peer", "id").collect()} == {("p", 2), ("q", 0)}
    assert {tuple(r) for r in marks.collect()} == {("p", 3), ("q", 1), ("r", 4)}

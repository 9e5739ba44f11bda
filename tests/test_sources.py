"""Readers and writers of the smaller formats on hand-written files."""

import json

import pytest
from pyspark.sql import functions as F

from lintharbor import schema
from lintharbor.sources import readers, writers
from lintharbor.streaming import new_peer_seeds


def test_seed_files(spark, tmp_path):
    for name, data in (("a", b"xy"), ("b", b""), ("README.txt", b"no"), ("c", b"z")):
        (tmp_path / name).write_bytes(data)
    assert [(r.path.rsplit("/")[-1], r.len) for r in readers.read_seed_files(spark, str(tmp_path)).collect()] == [("a", 2), ("c", 1)]
    with pytest.raises(Exception, match="too large"):
        readers.read_seed_files(spark, str(tmp_path), most=1).collect()


def test_find_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.c", "b.h", "d/c.c", "d/skip.c"):
        (tmp_path / name).write_text("x")
    names = lambda *a: {r.path.rsplit("/")[-1] for r in readers.find_files(spark, str(tmp_path), *a).collect()}
    assert names(["c"]) == {"a.c", "c.c", "skip.c"} and names(["c", ".h"], False) == {"a.c", "b.h"} and names(["c"], True, ("skip.c",)) == {"a.c", "c.c"}


def test_bitmap(spark, tmp_path):
    (tmp_path / "map").write_bytes(bytes([0, 255, 0, 7, 128]))
    assert {(r.edge, r.value) for r in readers.read_bitmap(spark, str(tmp_path / "map")).collect()} == {(1, 255), (3, 7), (4, 128)}


@pytest.mark.parametrize("minimiser", [False, True])
def test_traces(spark, tmp_path, minimiser):
    trace = spark.createDataFrame([(1, 5, 1), (1, 123456, 128), (2, 5, 2)], "exec_id long, edge int, cls int")
    writers.write_traces(trace, str(tmp_path / "out"), minimiser)
    folder = str(tmp_path / "out" / "exec_id=1")
    if minimiser:
        assert {r.tuple for r in readers.read_minimiser_traces(spark, folder).collect()} == {"15", "128123456"}
    else:
        assert {(r.edge, r.cls) for r in readers.read_traces(spark, folder).collect()} == {(5, 1), (123456, 128)}
        assert [r.value for r in writers.trace_lines(trace.filter("exec_id = 1")).collect()] == ["000005:1", "123456:128"]


def test_snapshot_and_resume(spark, tmp_path):
    row = spark.createDataFrame([(100, 7, 99.5, "./x -a : b")], "start_time long, cur_path long, stability double, command_line string")
    writers.write_snapshot(row, str(tmp_path / "out"))
    back = readers.read_snapshots(spark, str(next((tmp_path / "out").glob("part*"))))
    r = back.first()
    assert (r.start_time, r.cur_path, r.stability, r.command_line) == (100, 7, 99.5, "./x -a : b")
    assert [readers.resume_position(back, n).first().position for n in (8, 7)] == [7, 0]


def test_plot_lines(spark, tmp_path):
    ddl = "unix_time long, cycles_done long, cur_path long, paths_total long, pending_total long, pending_favs long, map_size double, unique_crashes long, unique_hangs long, max_depth long, execs_per_sec double"
    rows = spark.createDataFrame([(5, 0, 1, 2, 3, 4, 1.5, 6, 7, 8, 12.345)], ddl)
    assert [r.value for r in writers.plot_lines(rows.withColumn("execs", F.lit("12.3k"))).collect()] == ["5, 0, 1, 2, 3, 4, 1.50%, 6, 7, 8, 12.35, 12.3k"]
    writers.write_plot(rows, str(tmp_path / "plot"))
    (tmp_path / "plot" / "head").write_text("# unix_time, cycles_done\n")
    assert tuple(readers.read_plot(spark, str(tmp_path / "plot")).first()) == (5, 0, 1, 2, 3, 4, 1.5, 6, 7, 8, 12.35)


def test_names(spark):
    lit = F.lit
    none = lambda t: lit(None).cast(t)
    change = lambda **k: writers.change_name(**{"src": lit(3), "spliced": lit(-1), "op": lit("flip1"), "pos": lit(-1), "val": none("int"), "big_endian": lit(False), "rep": lit(4), "peer": none("string"), "new_coverage": lit(False)} | k)
    of = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert of(change()) == "src:000003,op:flip1,rep:4"
    assert of(change(spliced=lit(12), pos=lit(0), new_coverage=lit(True))) == "src:000003+000012,op:flip1,pos:0,+cov"
    assert of(change(pos=lit(9), val=lit(-7), big_endian=lit(True))) == "src:000003,op:flip1,pos:9,val:be:-7"
    assert of(change(peer=lit("p1"))) == "sync:p1,src:000003"
    assert of(writers.seed_name(lit(12), change())) == "id:000012,src:000003,op:flip1,rep:4"
    assert of(writers.crash_name(lit(1), lit(2500), lit(6), change())) == "id:000001,2500,sig:06,src:000003,op:flip1,rep:4"


def test_metrics_and_config(spark, tmp_path):
    metric = lambda v: {"runs": [{"properties": {"metricResults": []}}, {"properties": {"metricResults": [{"rule": {"id": "a"}, "ruleId": "x/user-code-lines", "value": v}]}}]}
    for name, v in (("a", 5), ("b", 0)):
        (tmp_path / f"{name}.sarif").write_text(json.dumps(metric(v)))
    assert {r.path[-7:]: r.ok for r in readers.user_code_measured(spark, str(tmp_path / "*.sarif")).collect()} == {"a.sarif": True, "b.sarif": False}
    (tmp_path / "c.json").write_text('{"threads": 8}')
    assert readers.load_config(str(tmp_path / "c.json")) == {"threads": 8}


def test_summary_options_are_those_of_the_first_row(spark, tmp_path):
    head = "bug_id,n_dedup_frames,consider_filepaths,consider_lines,input_file,sanitizer,vuln_type,stack_trace,n_total_frames\n"
    (tmp_path / "s").write_text(head + "0,3,True,False,a,asan,segv,#0:f.c:f:1,1\n1,-,False,True,b,asan,segv,,0\n")
    assert {(r.bug_id, r.n_dedup_frames, r.consider_filepaths, r.consider_lines, len(r.stack_trace)) for r in readers.read_summary(spark, str(tmp_path / "s")).collect()} == {(0, 3, True, False, 1), (1, 3, True, False, 0)}


def test_reports_folder(spark, tmp_path):
    (tmp_path / "r1").write_text("INPUT_FILE: x\n==1==ERROR: AddressSanitizer: SEGV on\n    #0 0x4c in f /src/io.c:27\n\n")
    (tmp_path / "r2").write_text("nothing\n")
    assert [(r.input_file, r.stack_trace[0].file) for r in readers.read_reports(spark, str(tmp_path)).collect()] == [("x", "io.c")]


def test_peers_of_an_empty_round(spark):
    rows, marks = new_peer_seeds(spark.createDataFrame([], "peer string, id long"), spark.createDataFrame([("r", 4)], "peer string, next_id long"))
    assert rows.count() == 0 and {tuple(r) for r in marks.collect()} == {("r", 4)}


@pytest.mark.parametrize("most", [0, 10_000])
def test_summaries_are_read_by_line(spark, tmp_path, monkeypatch, most):
    """Files of many splits, some with header, carriage returns, other lines first or no last line break; the options of each file stay its own."""
    monkeypatch.setattr(readers, "MOST_BROADCAST_FILES", most)
    head = ",".join(schema.SUMMARY_COLUMNS)
    rows = lambda k, n: [f"{i},{k if i == 0 else '-'},{k % 2 == 0 if i == 0 else k % 2 == 1},True,in{k}-{i},asan,segv,{'#0:f.c:f:1=#1:g.c:g:2' if i % 2 else ''},{i % 2 * 2}" for i in range(n)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a").write_bytes("\r\n".join([head, "not,a,row", *rows(4, 3000)]).encode() + b"\r\n")
    (tmp_path / "s/b").write_text("\n".join([*["x" * 100] * 200, *rows(5, 900), head]))
    (tmp_path / "s/c").write_text(head + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.read_summary(spark, str(tmp_path / "s"))
        out = sorted((r.input_file, r.bug_id, r.n_dedup_frames, r.consider_filepaths, r.consider_lines, len(r.stack_trace)) for r in got.collect())
        assert got.rdd.getNumPartitions() > 1
        assert max(r.n for r in readers.read_summary(spark, str(tmp_path / "s/a")).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert out == sorted((f"in{k}-{i}", i, k, k % 2 == 0, True, i % 2 * 2) for k, n in ((4, 3000), (5, 900)) for i in range(n))

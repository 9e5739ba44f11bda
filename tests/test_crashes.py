"""Report parsing and deduplication, on hand-written reports."""

from lintharbor.functions import decode_trace, encode_trace
from lintharbor.operators import crashes
from lintharbor.sources import readers, writers
from pyspark.sql import functions as F

PLAIN = """INPUT_FILE: /path/to/file01
noise
==1==ERROR: AddressSanitizer: SEGV on unknown address 0x0
    #0 0x4c in readIt /src/io.c:277
    #1 0x4d in std::vector<int>::push /src/v.h:10:3
    #2 0x7f (/lib/libc.so+0x2)

allocated by thread T0 here:
    #0 0x11 in malloc (/bin/x+0x1)
"""
LEAK = "INPUT_FILE: f2\n==2==ERROR: LeakSanitizer: detected memory leaks\n\n    #0 0x1 in main /a/b.c:3\n    #1 0x2 in _start\n\n"
EMPTY = "INPUT_FILE: f3\n==3==ERROR: AddressSanitizer: SEGV on\ntext\n\n    #0 0x1 in main /a/b.c:3\n\n"
BROKEN = "INPUT_FILE: f4\n==4==ERROR: AddressSanitizer: SEGV on\n    #0 0x1 in main /a/b.c:3\nrubbish\n\n"
CUT = "INPUT_FILE: f5\n==5==ERROR: AddressSanitizer: SEGV on\n    #0 0x1 in main /a/b.c:3\n"


def parsed(spark, *texts):
    rows = crashes.parse_reports(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    return {r.input_file: (r.sanitizer, r.vuln_type, [tuple(f) for f in r.stack_trace]) for r in rows}


def test_parse(spark):
    out = parsed(spark, PLAIN, LEAK, EMPTY, BROKEN, CUT, "no report", "")
    assert out == {
        "/path/to/file01": ("addresssanitizer", "segv", [(0, "io.c", "readIt", 277), (1, "-", "std", -1), (2, "-", "-", -1)]),
        "f2": ("leaksanitizer", "detected", [(0, "b.c", "main", 3), (1, "-", "_start", -1)]),
        "f3": ("addresssanitizer", "segv", []),
    }


def frames(*names):
    return [(i, f"{n}.c", n, len(n)) for i, n in enumerate(names)]


def table(spark, rows):
    return spark.createDataFrame(rows, "input_file string, sanitizer string, vuln_type string, stack_trace array<struct<id:int,file:string,function:string,line:int>>")


def test_dedup_refines_with_depth_and_options(spark):
    rows = table(spark, [("a", "s", "segv", frames("f", "g")), ("b", "s", "segv", frames("f", "h")), ("c", "s", "uaf", frames("f", "g")), ("d", "s", "segv", []), ("e", "s", "segv", [(0, "x.c", "f", 9), (1, "g.c", "g", 1)])])
    of = lambda *a: {r.input_file: r.bug_id for r in crashes.dedup(rows, *a).collect()}
    assert of(1) == {"d": 0, "a": 1, "b": 1, "e": 1, "c": 2}
    assert of() == {"d": 0, "a": 1, "e": 1, "b": 2, "c": 3}
    assert of(1, True) == {"d": 0, "a": 1, "b": 1, "e": 2, "c": 3}
    assert of(None, False, True)["a"] != of(None, False, True)["e"]


def test_codec_and_summary(spark, tmp_path):
    rows = table(spark, [("a,1", "s", "segv", frames("f", "g")), ("b", "s", "segv", []), ("c", "s", "segv", frames("f"))])
    again = rows.select(decode_trace(encode_trace(F.col("stack_trace"))).alias("t"), "stack_trace").collect()
    assert all(r.t == r.stack_trace for r in again)
    deduped = crashes.dedup(rows, 1)
    writers.write_summary(deduped, str(tmp_path / "s"), 1)
    back = readers.read_summary(spark, str(tmp_path / "s"))
    assert {(r.bug_id, r.input_file, r.n_dedup_frames, r.consider_lines) for r in back.collect()} == {(0, "b", 1, False), (1, "a-1", 1, False), (1, "c", 1, False)}
    merged = crashes.merge(back.unionByName(back))
    assert {(r.bug_id, r.n_crashes) for r in crashes.groups(merged).collect()} == {(0, 2), (1, 2), (2, 2)}

"""The groupings and the filter on a small program of six functions, with hand-computed scores."""

import json
import re
import random

import pytest

from lintharbor import schema
from lintharbor.operators import findings
from lintharbor.sources import readers, writers

FILE = "quicksort.c"
#: name, first and last line, reachable, lines of code, blocks (id, first, last, lines of code)
PROGRAM = [
    ("main", 65, 77, True, 8, [(16, 65, 77, 8)]),
    ("printArray", 56, 61, True, 6, [(11, 56, 57, 2), (12, 57, 57, 1), (13, 58, 59, 2), (14, 57, 57, 1), (15, 60, 61, 2)]),
    ("quickSort", 40, 53, True, 7, [(8, 40, 41, 2), (9, 45, 52, 4), (10, 53, 53, 1)]),
    ("partition", 13, 37, True, 11, [(1, 13, 22, 4), (2, 22, 22, 1), (3, 23, 23, 1), (4, 26, 30, 3), (5, 31, 31, 1), (6, 22, 22, 1), (7, 34, 37, 2)]),
    ("swap", 6, 10, True, 5, [(0, 6, 10, 5)]),
    ("dead_func", 79, 83, False, 2, []),
]


@pytest.fixture(scope="module")
def program(spark, tmp_path_factory):
    place = lambda a, b: {"line": {"start": a, "end": b}}
    document = {"functions": [{"name": n, "location": {"filename": FILE, "reachable_from_main": r, **place(a, b)}, "LoC": k, "basic_blocks": [{"id": i, "location": place(c, d), "LoC": m} for i, c, d, m in blocks]} for n, a, b, r, k, blocks in PROGRAM]}
    path = tmp_path_factory.mktemp("inspection") / "program.json"
    path.write_text(json.dumps(document, indent=1))
    functions = readers.functions_of(readers.read_inspection(spark, str(path)))
    return functions, readers.blocks_of(functions)


def flags(spark, *rows):
    return spark.createDataFrame([(t, f if isinstance(f, str) else FILE, x, v) for t, f, x, v in [(r[0], None, r[1], r[2] if len(r) > 2 else "v") if len(r) < 4 else r for r in rows]], schema.FLAG)


def result(df):
    return sorted((r.tool, r.line, r.n_flg_lines, r.n_all_lines, r.n_run_tools, r.n_all_tools, r.score) for r in df.collect())


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        ([("t1", 67), ("t2", 70), ("t3", 73)], [("t1-t2-t3", 65, 3, 8, 3, 3, 0.688)]),
        ([("t1", 67), ("t2", 19), ("t3", 73)], [("t1-t3", 65, 2, 8, 2, 3, 0.458), ("t2", 13, 1, 4, 1, 3, 0.292)]),
        ([("t1", 47), ("t2", 19), ("t3", 73)], [("t1", 45, 1, 4, 1, 3, 0.292), ("t2", 13, 1, 4, 1, 3, 0.292), ("t3", 65, 1, 8, 1, 3, 0.229)]),
        ([("t1", 54), ("t2", 19), ("t3", 73)], [("t2", 13, 1, 4, 1, 3, 0.292), ("t3", 65, 1, 8, 1, 3, 0.229)]),
        ([("t1", 57)], [("t1", 56, 1, 2, 1, 1, 0.75)]),
    ],
)
def test_group_by_block(spark, program, lines, expected):
    assert result(findings.group_by_block(flags(spark, *lines), program[1])) == expected


def test_same_line_counts_once(spark, program):
    out = findings.group_by_block(flags(spark, ("t1", 67, "v1"), ("t2", 19, "v2"), ("t3", 67, "v1")), program[1])
    assert result(out) == [("t1-t3", 65, 1, 8, 2, 3, 0.396), ("t2", 13, 1, 4, 1, 3, 0.292)]
    assert {r.vuln for r in out.collect()} == {"v1:67", "v2:19"}


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        ([("t1", 58), ("t2", 59), ("t3", 60)], [("t1-t2", 58, 3, 6, 3, 3, 0.75), ("t3", 60, 3, 6, 3, 3, 0.75)]),
        ([("t1", 48), ("t2", 67), ("t1", 50)], [("t1", 45, 2, 7, 1, 2, 0.393), ("t2", 65, 1, 8, 1, 2, 0.312)]),
    ],
)
def test_group_by_function_blocks(spark, program, lines, expected):
    assert result(findings.group_by_function_blocks(flags(spark, *lines), *program)) == expected


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        ([("t1", 58), ("t2", 59), ("t3", 60)], [("t1-t2-t3", 57, 3, 6, 3, 3, 0.75)]),
        ([("t1", 68), ("t2", 57), ("t3", 33)], [("t1", 66, 1, 8, 1, 3, 0.229), ("t2", 57, 1, 6, 1, 3, 0.25), ("t3", 14, 1, 11, 1, 3, 0.212)]),
    ],
)
def test_group_by_function(spark, program, lines, expected):
    assert result(findings.group_by_function(flags(spark, *lines), program[0])) == expected


@pytest.mark.parametrize(("lines", "kept"), [((29, 48, 60, 76), {29, 48, 60, 76}), ((11, 39, 54), set()), ((80, 82), set()), ((39, 60, 80), {60})])
def test_reachability(spark, program, lines, kept):
    rows = flags(spark, *[("t", x) for x in lines], ("t", "main.c", 29, "v"))
    assert {r.line for r in findings.reachable(rows, program[0]).collect()} == kept


def test_grouping_ignores_input_order(spark, program):
    rows = [("t1", 58), ("t2", 59), ("t3", 60), ("t1", 20), ("t2", 47)]
    for group in (lambda f: findings.group_by_block(f, program[1]), lambda f: findings.group_by_function(f, program[0])):
        assert result(group(flags(spark, *rows))) == result(group(flags(spark, *reversed(rows), *rows)))


def test_set_operations_and_csv(spark, tmp_path):
    path = tmp_path / "flags.csv"
    path.write_text('tool1,file1,10,vuln1\ntool1,file1,10,vuln1\ntool2,"f,20,vuln2\ntool1,file1,10,vuln1,1,3,1,5,0.267\nbroken,line\n')
    plain, grouped = readers.read_flags(spark, str(path)), readers.read_grouped_flags(spark, str(path))
    assert {tuple(r) for r in plain.collect()} == {("tool1", "file1", 10, "vuln1"), ("tool2", '"f', 20, "vuln2")}
    assert [tuple(r) for r in grouped.collect()] == [("tool1", "file1", 10, "vuln1", 1, 3, 1, 5, 0.267)]
    assert [r.value for r in writers.flag_lines(grouped).collect()] == ["tool1,file1,10,vuln1,1,3,1,5,0.267"]
    assert [round(r.score, 3) for r in readers.read_targets(spark, str(path)).collect()] == [0.267]
    assert findings.equal(findings.union(plain, plain), plain) and not findings.equal(findings.remove(plain, plain.filter("line = 10")), plain)
    writers.write_flags(plain, str(tmp_path / "out"))
    assert findings.equal(readers.read_flags(spark, str(tmp_path / "out")), plain)


def test_sarif(spark, tmp_path):
    def run(rule, uri, line):
        return {"ruleId": rule, "locations": [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}]}

    rules = [{"id": "r1", "name": "Old"}, {"id": "r1", "name": "Rule-1"}, {"id": "r2", "name": "Rule-2"}]
    document = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "SAST-Tool", "rules": rules}}, "results": [run("r1", "/path/to/file1", 10), run("r2", "file2", 20), run("r9", "file3", 30)]}]}
    path = tmp_path / "x.sarif"
    path.write_text(json.dumps(document, indent=1))
    assert {tuple(r) for r in readers.read_sarif(spark, str(path)).collect()} == {("sast-tool", "file1", 10, "Rule-1"), ("sast-tool", "file2", 20, "Rule-2")}
    with pytest.raises(Exception, match="unknown rule"):
        readers.read_sarif(spark, str(path), strict=True).collect()
    path.write_text("\n".join([json.dumps(document)] * 2))
    assert readers.read_sarif_lines(spark, str(path)).count() == 2


@pytest.mark.parametrize("strict", [False, True])
def test_unnesting_sarif_copies_no_run_to_its_results(spark, tmp_path, strict):
    place = lambda uri, line: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}
    results = [{"ruleId": "a", "locations": [place("d/x.c/", 1), place("y.c", 2), {}]}, {"ruleId": "a", "locations": []}, {"ruleId": "zz"}, {"ruleId": "zz", "locations": []}, {"ruleId": "b", "locations": [place("y.c", 2), place("y.c", 2)]}]
    runs = [{"tool": {"driver": {"name": "T", "rules": [{"id": "a", "name": "A"}, {"id": "b", "name": "B"}]}}, "results": results}, {"tool": {"driver": {"name": "U", "rules": [{"id": "a", "name": "Other"}]}}, "results": results[:4]}, {"tool": {"driver": {"name": "V"}}}]
    path = tmp_path / "lines"
    write = lambda: path.write_text("\n".join(json.dumps({"version": v, "runs": runs}) for v in ("2.1.0", "2.0.0")))
    write()
    if strict:  # an unknown rule counts without locations too
        with pytest.raises(Exception, match="unknown rule zz"):
            readers.read_sarif_lines(spark, str(path), strict=True).collect()
        for run in runs[:2]:
            run["results"] = [x for x in run["results"] if x["ruleId"] != "zz"]
        write()
    found = readers.read_sarif_lines(spark, str(path), strict=strict)
    a = lambda tool, name: {(tool, "x.c", 1, name), (tool, "y.c", 2, name), (tool, None, None, name)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 7 and set(rows) == a("t", "A") | a("u", "Other") | {("t", "y.c", 2, "B")}
    # rows of an unnested array are held together, each with its copy of the columns beside it
    beside = re.findall(r"Generate explode\(.*\), \[(.*?)\], (?:true|false), \[", found._jdf.queryExecution().sparkPlan().toString())
    assert beside and all(re.fullmatch(r"(_gen_alias_\d+#\d+|tool#\d+)?", x) for x in beside), beside


def test_other_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"file": "d/a.c", "line": 3, "bug_type": "LEAK"}]))
    (tmp_path / "b.csv").write_text("asan,b.c,x,7\n\n")
    assert [tuple(r) for r in readers.read_json_findings(spark, "infer", str(tmp_path / "a.json")).collect()] == [("infer", "a.c", 3, "LEAK")]
    assert [tuple(r) for r in readers.read_pass_findings(spark, str(tmp_path / "b.csv")).collect()] == [("asan", "b.c", 7, "-")]


def test_long_and_short_ranges(spark):
    """Against all pairs, with ranges in both kinds of bins."""
    r = random.Random(1)
    points = [(f"f{r.randrange(2)}", r.randrange(0, 40_000)) for _ in range(300)]
    ranges = [(f"f{r.randrange(2)}", a, a + r.choice((-1, 0, 5, 63, 64, 4095, 4096, 20_000)), i) for i in range(80) for a in [r.randrange(0, 30_000)]]
    out = findings.within(spark.createDataFrame(points, "file string, line int"), spark.createDataFrame(ranges, "file string, s long, e long, n int"), "s", "e", ["file"])
    expected = sorted((f, x, n) for f, x in points for g, a, b, n in ranges if f == g and a <= x <= b)
    assert sorted((x.file, x.line, x.n) for x in out.collect()) == expected


def test_functions_of_several_documents(spark, tmp_path):
    place = lambda a, b: {"line": {"start": a, "end": b}}
    for name, at in (("a", 10), ("b", 200)):
        f = {"name": "f", "location": {"filename": f"{name}.c", "reachable_from_main": True, **place(at, at + 9)}, "LoC": 10, "basic_blocks": [{"id": 1, "location": place(at, at + 9), "LoC": 10}]}
        (tmp_path / f"{name}.json").write_text(json.dumps({"functions": [f]}))
    functions = readers.functions_of(readers.read_inspection(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")))
    blocks = readers.blocks_of(functions)
    assert functions.select("func_ord").distinct().count() == 2
    rows = spark.createDataFrame([("t", "a.c", 12, "v"), ("t", "b.c", 205, "v"), ("u", "b.c", 206, "v")], schema.FLAG)
    assert sorted((x.file, x.line, x.n_flg_lines, x.n_run_tools) for x in findings.group_by_function_blocks(rows, functions, blocks).collect()) == [("a.c", 10, 1, 1), ("b.c", 200, 2, 2)]


def test_lines_before_a_function_are_out_of_scope(spark):
    lines = spark.createDataFrame([("f", "g", 1, 5), ("f", "g", 1, 12), ("f", "g", 1, 14), ("f", "g", 1, 14), ("f", "g", 2, 3), ("f", "g", 3, 0), ("f", "declared", 4, 7)], "file string, function string, block_id long, line int")
    functions = spark.createDataFrame([("f", "g", 10), ("f", "declared", None)], "file string, function string, first int")
    assert [tuple(x) for x in findings.line_statistics(lines, functions).collect()] == [("f", "g", 1, 12, 14, 2)]


def test_shuffle_is_a_permutation_by_seed(spark):
    rows = spark.range(50).withColumnRenamed("id", "k")
    a, b, c = ([r.k for r in findings.shuffled(x, seed, "k").orderBy("rank").collect()] for x, seed in ((rows, 1), (rows.repartition(7), 1), (rows, 2)))
    assert a == b != c and sorted(a) == list(range(50)) != a


def test_target_match(spark):
    ins = spark.createDataFrame([(1, "/src/lib/a.c", 5, 0), (1, "/src/lib/a.c", 6, 1), (2, "/src/xlib/a.c", 5, 2), (3, "lib/a.c", 5, 3)], "block_id long, path string, line int, ordinal int")
    t = spark.createDataFrame([("lib/a.c", 5, 0.5), ("lib/a.c", 6, 0.9)], schema.TARGETS)
    assert {(r.block_id, r.line) for r in findings.match_targets(ins, t).collect()} == {(1, 5), (3, 5)}

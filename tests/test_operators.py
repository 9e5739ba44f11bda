"""Functions, graphs, traces, directed campaigns and series on small hand-computed cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintharbor import functions as fn
from lintharbor.operators import campaign, coverage, directed, graph, searches
from lintharbor.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, fn.div(lit(1), lit(0))) == 0 and one(spark, fn.round3(lit(0.3125))) == 0.312
    assert one(spark, fn.scale(lit(5.0), 0, 10, 1, 5)) == 3 and one(spark, fn.scale(lit(5.0), 1, 1, 1, 5)) is None
    assert [one(spark, fn.hit_bucket(lit(n))) for n in (0, 1, 2, 3, 4, 8, 16, 32, 127, 128, 255)] == [0, 1, 2, 4, 8, 16, 32, 64, 64, 128, 128]
    assert [one(spark, fn.next_p2(lit(n))) for n in (0, 1, 2, 3, 8, 9)] == [1, 1, 2, 4, 8, 16]
    assert one(spark, fn.num_equal_bits(lit(5), lit(7))) == 63
    assert one(spark, fn.log_cycle_interval(lit(100), lit(120))) == 107
    assert one(spark, fn.basename(lit("/a/b.c/"))) == "b.c" and one(spark, fn.difficulty_factor(lit(3))) == 1
    assert [one(spark, fn.raw_distance(lit(d))) for d in (0.0, 0.001, 2.0)] == [0, 1, 200]
    assert [one(spark, fn.human_count(lit(n))) for n in (9999, 12345, 4_560_000)] == ["9999", "12.3k", "4.56M"]
    assert [one(spark, fn.human_count(lit(n))) for n in (99_949, 99_950, 123_999, 9_994_999, 9_995_000, 999_999_999, 10**14)] == ["99.9k", "99k", "123k", "9.99M", "10.0M", "999M", "infty"]
    assert [one(spark, fn.human_size(lit(n))) for n in (7, 10_240, 200 * 1024, 3 << 20, 5 << 40)] == ["7 B", "10.0 kB", "200 kB", "3.00 MB", "5.00 TB"]
    assert [one(spark, fn.human_number(lit(x))) for x in (1.234, 123.4, 12345.6)] == ["1.23", "123.4", "12.3k"]
    assert [one(spark, fn.human_time(lit(n), lit(e))) for n, e in ((90_061_000, 1000), (5, 0))] == ["1 days, 1 hrs, 1 min, 0 sec", "none seen yet"]
    r = spark.sql("select array(1,2,3,4) a, array(1,9,3,8) b").select(fn.first_and_last_difference(F.col("a"), F.col("b")).alias("x")).first().x
    assert (r.first, r.last) == (1, 3)


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5), (5, 3), (4, 4)], "src long, dst long")
    entry = spark.createDataFrame([(0, 1)], "source int, node long")
    assert {(r.node, r.dist) for r in graph.distances(edges, entry).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 2)}
    taint = graph.tainted(edges, spark.createDataFrame([(4,)], "node long"))
    assert {r.node for r in taint.collect()} == {1, 2, 4}
    assert {tuple(r) for r in graph.critical_blocks(edges, taint).select("src", "dst", "value").collect()} == {(1, 2, 2), (1, 3, 1)}
    assert graph.harmonic(spark.createDataFrame([(1, 2), (1, 2), (1, -1)], "k int, dist int"), ["k"]).first().distance == 1.0
    numbered = graph.dense_index(spark.createDataFrame([(x,) for x in "dbca"], "k string"), ["k"]).collect()
    assert {(r.k, r["index"]) for r in numbered} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_block_target_distances(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    targets = spark.createDataFrame([("T", 3)], "target string, node long")
    calls, cost = spark.createDataFrame([(2, 50)], "node long, callee long"), spark.createDataFrame([("U", 50, 10)], "source string, node long, cost int")
    get = lambda mode: {(r.node, r.target): r.dist for r in graph.block_target_distances(edges, targets, calls, cost, mode).collect()}
    assert get("composed") == {(3, "T"): 0, (2, "T"): 1, (1, "T"): 2, (2, "U"): 10, (1, "U"): 11}
    # a call block has its callee's distances, not its own column
    assert get("parity") == {(3, "T"): 0, (2, "U"): 10, (1, "T"): 2, (1, "call:2"): 1}


def test_call_blocks_take_their_nearest_callee(spark):
    calls = spark.createDataFrame([(1, 7, 0), (1, 8, 1), (1, 9, 2), (2, 9, 0), (3, 99, 0)], "node long, callee long, ordinal int")
    nearest = graph.nearest_callees(calls, spark.createDataFrame([(7, 2.0), (8, 1.5), (9, 1.5)], "node long, distance double"))
    assert {tuple(r) for r in nearest.collect()} == {(1, 8, 15.0), (2, 9, 15.0)}
    # 4 -> 1 -> 5 and 4 -> 5, 4 -> 6; 5 is a target
    edges = spark.createDataFrame([(4, 1), (1, 5), (4, 5), (4, 6)], "src long, dst long")
    out = {r.node: r.distance for r in graph.block_distances(edges, spark.createDataFrame([(5,)], "node long"), nearest).collect()}
    assert out == {1: 15.0, 2: 15.0, 5: 0.0, 4: 1 / (1 / 16 + 1 / 1)}


def test_tainted_ignores_back_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 3)], "src long, dst long")
    target = spark.createDataFrame([(2,)], "node long")
    assert {r.node for r in graph.tainted(edges, target).collect()} == {1, 2, 3, 4}
    assert {r.node for r in graph.tainted(edges, target, spark.createDataFrame([(3, 2)], "src long, dst long")).collect()} == {1, 2}


def test_graphs_of_blocks_and_functions(spark):
    of = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 30)], "node long, block_id long")
    instructions = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 4), (1, 3)], "src long, dst long")
    blocks = graph.block_edges(instructions, of)
    assert {tuple(r) for r in blocks.collect()} == {(10, 10), (10, 20), (20, 30), (30, 30)}
    assert {r.src: r.dst for r in graph.adjacency(blocks).collect()} == {10: [10, 20], 20: [30], 30: [30]}
    calls = spark.createDataFrame([("main", "f"), ("f", "g"), ("main", "g"), ("g", "f")], "src string, dst string")
    out = graph.function_distances(calls, spark.createDataFrame([(0, "g")], "source int, node string"))
    assert {(r.node, r.dist, r.cost) for r in out.collect()} == {("g", 1, 10), ("f", 2, 20), ("main", 2, 20)}
    assert {r.node for r in graph.reachable_nodes(calls, spark.createDataFrame([("f",)], "node string")).collect()} == {"f", "g"}
    numbered = graph.dense_index(spark.createDataFrame([("a",), ("b",)], "node string"), ["node"])
    cols = spark.createDataFrame([("t", 0)], "target string, index int")
    cells = graph.distance_matrix(spark.createDataFrame([("a", "t", 3), ("a", "t", 2), ("b", "t", 5)], "node string, target string, dist int"), numbered, cols)
    assert {tuple(r) for r in cells.collect()} == {(0, 0, 2), (1, 0, 5)}


def test_queue(spark):
    rows = [(1, False, 2.0), (2, True, -1.0), (3, True, 5.0), (4, True, 1.0), (5, False, -1.0), (6, True, 1.0)]
    seeds = spark.createDataFrame(rows, "seed_id long, favored boolean, distance double")
    assert [r.seed_id for r in directed.queue_order(seeds).orderBy("rank").collect()] == [4, 6, 3, 2, 1, 5]
    queue = spark.createDataFrame([(0, 1, 5, 1, False, True), (1, 3, 9, 2, True, False)], "seed_id long, depth int, len long, n_fuzz long, is_target boolean, was_fuzzed boolean")
    found = spark.createDataFrame([(1, 7, True, 20), (0, 8, False, 10), (9, 6, False, 30)], "src long, len long, is_target boolean, at int")
    grown = directed.append_to_queue(queue, found)
    assert sorted((r.seed_id, r.depth, r.len, r.n_fuzz, r.is_target) for r in grown.collect()) == [(0, 1, 5, 1, False), (1, 3, 9, 2, True), (2, 2, 8, 1, False), (3, 4, 7, 1, True), (4, 1, 6, 1, False)]
    assert tuple(directed.queue_counters(grown).first()) == (5, 4, 4)
    targets = spark.createDataFrame([(1, "active"), (2, "paused")], "target_id long, state string")
    hits = spark.createDataFrame([(5, 1), (5, 2), (6, 2), (7, 1)], "seed_id long, target_id long")
    assert {r.seed_id for r in directed.rare_target_seeds(hits, targets).collect()} == {5, 7}
    conditions = spark.createDataFrame([(10, 1, 0), (10, 2, 1), (None, 3, 2)], "cbb_id long, cnd_id int, ordinal int")
    assert dict(map(tuple, directed.conditions_of(spark.createDataFrame([(10,), (11,)], "block long"), conditions).collect())) == {10: 2, 11: 0}


def test_mask_positions_against_the_rule(spark):
    r = random.Random(2)
    masks = {i: [r.choice((0, 1, 1, 3, 5, 7)) for _ in range(30)] for i in range(5)}
    df = spark.createDataFrame([(i, at, x) for i, m in masks.items() for at, x in enumerate(m)], "input_id int, at int, flags int")
    for kind, size in ((1, 1), (1, 4), (2, 2), (4, 1)):
        expected = {(i, at) for i, m in masks.items() for at in range(30) if at + size <= 30 and all(x & kind for x in m[at : at + size])}
        assert {tuple(x) for x in directed.mask_positions(df, kind, size).collect()} == expected


def test_bounds_tallies_and_levels(spark):
    d = spark.createDataFrame([(1, 0.0), (1, 3.0), (1, 2.0), (2, -1.0), (2, 4.0)], "cycle int, distance double")
    assert sorted(map(tuple, directed.distance_bounds(d).collect())) == [(1, 2.0, 3.0), (2, 4.0, 4.0)]
    states = spark.createDataFrame([("a", 1, "active", 0), ("a", 1, "paused", 2), ("a", 1, "finished", 9), ("a", 2, "active", 1)], "campaign string, cycle int, state string, execs long")
    assert sorted(map(tuple, directed.state_tallies(states).collect())) == [("a", 1, 1, 1, 1, 2), ("a", 2, 1, 0, 0, 1)]
    rows = [(1, 100, 10, 0, 0, -1.0, True, 3, 2), (2, 100, 10, 0, 0, -1.0, True, 17, 5), (3, 100, 10, 0, 0, -1.0, False, 17, 5), (4, 100, 10, 0, 0, -1.0, True, 20, 0)]
    seeds = spark.createDataFrame(rows, "seed_id long, exec_us long, bitmap_size long, handicap int, depth int, distance double, is_target boolean, fuzz_level int, n_fuzz long")
    out = {r.seed_id: r.perf_score for r in directed.power_schedule(seeds, 1.0, 2.0, 0.5, directed=False, fast=True).collect()}
    assert out == {1: 400, 2: 400, 3: 100, 4: 1600}  # 8 / 2; 32 / 8; none; 32 / 1 and the cap


def test_maps_and_workers(spark):
    rows = [(1, 0, 1), (1, 65, 3), (1, 63, 0), (2, 5, 255)]
    trace = spark.createDataFrame(rows, "exec_id long, edge int, cnt int")
    assert {tuple(r) for r in coverage.presence_bitmap(trace).collect()} == {(1, 0, 1), (1, 1, 2), (2, 0, 32)}
    variable = spark.createDataFrame([(1, 65)], "input_id long, edge int")
    row = coverage.stability(trace, variable, 100).first()
    assert (row.covered, row.variable, row.coverage, round(row.stability, 3)) == (3, 1, 3.0, 66.667)
    sums = spark.createDataFrame([(i,) for i in range(-9, 12)], "checksum long")
    parts = [{r.checksum for r in coverage.share_of_worker(sums, w, 3).collect()} for w in (1, 2, 3)]
    assert set.union(*parts) == set(range(-9, 12)) and sum(map(len, parts)) == 21
    assert [r.checksum for r in coverage.first_kept(sums, 3, "checksum").collect()] == [-9, -8, -7]
    inputs = spark.createDataFrame([(bytearray(b"aab"),), (bytearray(b""),), (bytearray(b"b\x00"),)], "content binary")
    assert dict(map(tuple, coverage.symbol_histogram(inputs).collect())) == {"61": 2, "62": 2, "00": 1}
    novel, records = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "exec_id long, novelty int"), spark.createDataFrame([(1, 4)], "cnd_id int, exec_id long")
    assert {r.exec_id for r in coverage.kept(novel, records).collect()} == {2, 3, 4}
    assert one(spark, fn.edge_only(F.lit(7))) == 1 and one(spark, fn.simplified(F.lit(0))) == 1 and one(spark, fn.simplified(F.lit(3))) == 128 and one(spark, fn.linear_cycle_interval(F.lit(5), F.lit(2))) == 7


def test_period_hits(spark):
    rows = [("x", i, i // 3) for i in range(9)] + [("y", 20 + i, 1) for i in range(2)]
    out = coverage.period_hit_counts(spark.createDataFrame(rows, "block string, exec_id long, period int"), "block", "period", 4)
    assert dict(map(tuple, out.collect())) == {0: 3, 1: 3}


def test_directed_favourites(spark):
    winners = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40)], "block int, seed_id long")
    hits, solved = spark.createDataFrame([(2, 500), (3, 3)], "block int, hits long"), spark.createDataFrame([(1,)], "block int")
    holders = spark.createDataFrame([(1, 50), (2, 60)], "cnd_id int, exec_id long")
    of = lambda *a: {r.seed_id for r in coverage.directed_favourites(winners, hits, solved, holders, 200, *a).collect()}
    assert of() == {30, 40, 50, 60}
    outcomes, rare = spark.createDataFrame([(1, 3), (2, 1)], "cnd_id int, outcomes int"), spark.createDataFrame([(99,)], "seed_id long")
    assert of(outcomes, rare) == {30, 40, 60, 99}


def test_unique_crashes_are_gated_and_capped(spark):
    rows = traces(8)
    trace = spark.createDataFrame(rows, "exec_id long, edge int, cnt int")
    gate = {x for x, _, _ in rows if x % 2}
    present, absent, expected = set(), set(), []
    universe = {e for x, e, _ in rows if x in gate}
    for x in sorted(gate):
        hit = {e for y, e, _ in rows if y == x}
        if not expected or hit - present or (universe - hit) - absent:
            expected.append(x)
        present |= hit
        absent |= universe - hit
    on_target = spark.createDataFrame([(x,) for x in gate], "exec_id long")
    assert sorted(r.exec_id for r in coverage.unique_crashes(trace, on_target).collect()) == expected
    assert sorted(r.exec_id for r in coverage.unique_crashes(trace, on_target, 2).collect()) == expected[:2]


def traces(seed=3, execs=40, edges=12):
    r = random.Random(seed)
    return [(x, e, r.choice((1, 2, 3, 9, 40, 200))) for x in range(execs) for e in range(edges) if r.random() < 0.3]


def test_novelty_against_a_running_map(spark):
    rows = traces()
    bucket = lambda n: next(b for m, b in ((1, 1), (2, 2), (3, 4), (7, 8), (15, 16), (31, 32), (127, 64), (255, 128)) if n <= m)
    seen, expected = {}, {}
    for x in sorted({r[0] for r in rows}):
        best = 0
        for _, e, n in (r for r in rows if r[0] == x):
            best = max(best, 0 if bucket(n) in seen.get(e, ()) else 1 if e in seen else 2)
        for _, e, n in (r for r in rows if r[0] == x):
            seen.setdefault(e, set()).add(bucket(n))
        expected[x] = best
    df = spark.createDataFrame(rows, "exec_id long, edge int, cnt int")
    assert {r.exec_id: r.novelty for r in coverage.novelty(df).collect()} == expected
    present, absent, unique = set(), set(), {}
    for i, x in enumerate(sorted({r[0] for r in rows})):
        hit = {e for y, e, _ in rows if y == x}
        miss = {e for _, e, _ in rows} - hit
        unique[x] = int(i == 0 or bool(hit - present or miss - absent))
        present |= hit
        absent |= miss
    assert {r.exec_id: r.unique for r in coverage.crash_novelty(df).collect()} == unique


def test_covers_cover_everything(spark):
    rows = traces(5)
    df = spark.createDataFrame(rows, "exec_id long, edge int, cnt int")
    seeds = spark.createDataFrame([(x, x % 7 + 1, 10 + x % 3) for x in range(40)], "seed_id long, len long, exec_us long")
    picked = {r.seed_id for r in coverage.greedy_edge_cover(df, seeds).collect()}
    assert {e for x, e, _ in rows if x in picked} == {e for _, e, _ in rows}
    # against the plain loops
    cost = {x: (10 + x % 3) * (x % 7 + 1) for x in range(40)}
    covered, favoured = set(), []
    for e in sorted({e for _, e, _ in rows}):
        if e not in covered:
            best = min({x for x, f, _ in rows if f == e}, key=lambda x: (cost[x], -x))
            favoured += [best] if best not in favoured else []
            covered |= {f for x, f, _ in rows if x == best}
    assert [r.seed_id for r in coverage.greedy_edge_cover(df, seeds).orderBy("pick").collect()] == favoured
    bucket = lambda n: next(b for m, b in ((1, 1), (2, 2), (3, 4), (7, 8), (15, 16), (31, 32), (127, 64), (255, 128)) if n <= m)
    has = {x: {(bucket(n), e) for y, e, n in rows if y == x} for x in range(40)}
    every = set().union(*has.values())
    covered, kept = set(), []
    for t in sorted(every, key=lambda t: (sum(t in has[x] for x in has), f"{t[0].bit_length()}{t[1]}")):
        if t not in covered:
            best = min((x for x in has if t in has[x]), key=lambda x: (x % 7 + 1, x))
            kept += [best] if best not in kept else []
            covered |= has[best]
    assert [r.seed_id for r in coverage.greedy_file_cover(df, seeds).orderBy("pick").collect()] == kept
    picked = {r.seed_id for r in coverage.greedy_file_cover(df, seeds).collect()}
    assert len(picked) < 40 and {(e, n) for x, e, n in rows if x in picked} == {(e, n) for _, e, n in rows}


def test_target_states():
    s = directed.TargetStates({1: 1.0, 2: 1.0})
    modes, states = [], []
    for hits in ({}, {}, {}, {}, {}, {1: 1}, {1: 100, 2: 100}):
        modes.append(s.step(100, hits, True))
        states.append(s.targets[1]["state"])
    assert states == ["paused", "active", "paused", "paused", "active", "active", "active"] and modes[-1] == "restart" and modes[0] == "coverage"


def test_target_states_against_plain_lists(spark):
    """Random campaigns, each rule of the cycle written out on lists."""
    r = random.Random(13)
    cycles, targets, expected = [], [], []
    for name in ("a", "b", "c"):
        n = r.randrange(2, 6)
        scores = [r.choice((0.25, 0.5, 0.75, 1.0)) for _ in range(n)]
        targets += [(name, i, s) for i, s in enumerate(scores)]
        state, execs, skips, last = ["active"] * n, [0] * n, [0] * n, [1] * n
        for cycle in range(1, 30):
            inputs, solved, exhausted = r.randrange(1, 60), r.random() < 0.5, r.random() < 0.2
            hits = {i: r.randrange(1, 25) for i in range(n) if r.random() < 0.25}
            cycles.append((name, cycle, inputs, solved, exhausted, hits))
            unfinished = [i for i in range(n) if state[i] != "finished"]
            weight = sum(scores[i] for i in unfinished)
            for i in unfinished:
                execs[i] += hits.get(i, 0)
                share = inputs * scores[i] / weight
                needed = max(1, int(share + 0.5))
                if execs[i] >= needed:
                    state[i] = "finished"
                elif i in hits:
                    state[i], skips[i], last[i] = "active", 0, 1
                elif skips[i] > 1:
                    skips[i] -= 1
                elif skips[i] == 1:
                    state[i], skips[i] = "active", 0
                else:
                    state[i], skips[i], last[i] = "paused", last[i], last[i] + 1
            if solved and set(state) == {"finished"}:
                mode = "restart"
                for i in range(n):
                    if scores[i] >= 0.5:
                        state[i], execs[i], skips[i], last[i] = "active", 0, 0, 1
            elif exhausted and not solved or "active" not in state:
                mode = "coverage"
            else:
                mode = "directed"
            expected += [(name, cycle, mode, i, state[i], execs[i], skips[i], last[i]) for i in range(n)]
    out = directed.target_state_machine(
        spark.createDataFrame(cycles, "campaign string, cycle int, inputs long, solved boolean, exhausted boolean, hits map<bigint,bigint>").repartition(5), spark.createDataFrame(targets, "campaign string, target_id long, score double")
    )
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert {x[2] for x in expected} >= {"coverage", "directed"}


def test_power_schedule(spark):
    rows = [(1, 10, 100, 0, 0, 5.0), (2, 1000, 100, 5, 9, 1.0), (3, 100, 10, 1, 30, -1.0)]
    df = spark.createDataFrame(rows, "seed_id long, exec_us long, bitmap_size long, handicap int, depth int, distance double")
    out = {r.seed_id: r.perf_score for r in directed.power_schedule(df, 1.0, 5.0, 0.5, directed=False).collect()}
    # means 370 and 70: 300 * 1.5; 50 * 1.5 * 4 * 3; 200 * 0.25 * 2 * 5
    assert out == {1: 450, 2: 900, 3: 500}
    assert all(0 <= v <= 1600 for v in directed.power_schedule(df, 1.0, 5.0, 0.5).toPandas().perf_score)


def test_series(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, 5), ("a", 1000, 6)], "k string, t int, v int")
    assert {(r.k, r.t) for r in campaign.change_only(df, "k", ["t"], ["v"]).collect()} == {("a", 1), ("a", 3), ("b", 1)}
    assert {(r.k, r.t) for r in campaign.every(df, "k", "t").collect()} == {("a", 1), ("b", 1), ("a", 1000)}
    assert {(r.k, r.t) for r in campaign.latest(df, "k", "t").collect()} == {("a", 1000), ("b", 1)}
    rate = spark.createDataFrame([("a", 1000, 100, 0), ("a", 2000, 200, 0), ("a", 3000, 2000, 0)], "k string, t long, n long, s long")
    assert [round(r.rate, 3) for r in campaign.execution_rate(rate, "k", "t", "n", "s").orderBy("t").collect()] == [100.0, 100.0, 1800.0]


def test_side_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("3:3\n1 2 3\n4,5,6\n7 8 9\n")
    cells = readers.read_distance_matrix(spark, str(tmp_path / "m.txt"))
    assert {tuple(r) for r in cells.collect()} == {(i, j, 3 * i + j + 1) for i in range(3) for j in range(3)}
    writers.write_matrix(cells.filter("dist <> 5"), 3, 3, str(tmp_path / "out"))
    assert {tuple(r) for r in readers.read_distance_matrix(spark, str(next((tmp_path / "out").glob("part*")))).collect()} == {(i, j, -1 if i == j == 1 else 3 * i + j + 1) for i in range(3) for j in range(3)}
    (tmp_path / "c.txt").write_text("1 none int32 int32 var 5 \n2 none int64 int32 var var \n3 7 int32 int64 12x -4 \n4 8 int32 str null var \n")
    assert {(r.cnd_id, r.cbb_id, r.flags, r.constant1, r.constant2) for r in readers.read_conditions(spark, str(tmp_path / "c.txt")).collect()} == {(1, None, 5, None, 5), (2, None, 4, None, None), (3, 7, 11, 12, -4), (4, 8, 2, 0, None)}
    (tmp_path / "snap").write_text("start_time        : 100\nexecs_done        : 50\nstability         : 99.50%\ncommand_line      : ./x -a : b\n")
    snap = readers.read_snapshots(spark, str(tmp_path / "snap")).first()
    assert (snap.start_time, snap.execs_done, snap.stability, snap.command_line) == (100, 50, 99.5, "./x -a : b")
    names = spark.createDataFrame([("q/id:000007,src:000001+000002,op:flip1,pos:3,+cov",)], "name string")
    r = readers.lineage(names).first()
    assert (r.id, r.src, r.op, r.pos, r.new_coverage) == (7, [1, 2], "flip1", 3, True)


def test_response_runs(spark):
    rows = [(1, i, "fixed", x, x, x, x, v) for i, (x, v) in enumerate([(1, 4), (1, 0), (2, 9)])]
    df = spark.createDataFrame(rows, "input_id int, at int, cls string, xff int, x01 int, s10 int, a10 int, value int")
    assert {(r.start, r.length, r.cls) for r in coverage.response_runs(df).collect()} == {(0, 2, "fixed"), (2, 1, "fixed")}


def test_calibration(spark):
    times = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 4, 7)], "input_id long, exec_id long, us long")
    runs = spark.createDataFrame([(1, 1, 5, 1), (1, 3, 5, 2), (1, 3, 6, 1), (1, 3, 7, 0)], "input_id long, exec_id long, edge int, cnt int")
    out = coverage.calibration(times, runs)
    assert sorted(map(tuple, out.collect())) == [(1, 3, 11, 2), (2, 1, 7, 0)]
    assert tuple(coverage.calibration_means(out).first()) == (10, 1)


def test_probes(spark):
    seeds = spark.createDataFrame([(1, 10, False), (2, 10, True), (3, 10, False), (4, 2000, True)], "seed_id long, len long, is_rare_target boolean")
    waiting = spark.createDataFrame([(1,), (1,), (4,)], "seed_id long")
    assert dict(map(tuple, directed.needs_sniffing(seeds, waiting).collect())) == {1: True, 2: True, 3: False, 4: False}
    values = spark.createDataFrame([(1, 1, 2, 1, 2), (1, 1, 2, 1, 3), (2, 4, 4, 4, 5), (3, None, 1, None, 1)], "seed_id long, own_a long, own_b long, now_a long, now_b long")
    assert dict(map(tuple, directed.critical_flags(seeds, values).collect())) == {1: 1, 2: 1, 3: 0, 4: 0}
    assert dict(map(tuple, directed.critical_flags(seeds, values, rare_now=True, explore=True).collect())) == {1: 2, 2: 3, 3: 0, 4: 3}


def test_skip_probability(spark):
    rows = [("a", 1, True, False), ("a", 2, False, False), ("b", 3, True, True), ("b", 4, False, True), ("b", 5, False, False), ("c", 6, False, True)]
    rows += [("b", 100 + i, True, True) for i in range(8)]
    seeds = spark.createDataFrame(rows, "campaign string, seed_id long, favored boolean, was_fuzzed boolean")
    of = lambda df: {r.seed_id: r.skip_percent for r in df.collect() if r.seed_id < 100}
    assert of(directed.skip_probability(seeds)) == {1: 0, 2: 99, 3: 0, 4: 95, 5: 75, 6: 0}  # c has too short a queue
    assert of(directed.skip_probability(seeds, cycle_count=1)) == {1: 0, 2: 99, 3: 0, 4: 95, 5: 95, 6: 0}
    assert set(of(directed.skip_probability(seeds, explore=False)).values()) == {0}
    assert of(directed.skip_probability(seeds.withColumn("is_dead", F.col("seed_id") == 3)))[3] == 100


def _odd_graph(spark):
    """Two hundred blocks with cycles, self-loops, repeated edges, a hub, a null end and parts that don't touch."""
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(420)] + [(i, 7) for i in range(0, 200, 3)] + [(5, 5), (5, 5), (300, 301), (301, 302), (None, 3), (3, None)]
    return spark.createDataFrame(pairs, "src long, dst long"), [(a, b) for a, b in pairs if a is not None and b is not None]


def _hops_to(pairs, nodes):
    """Least hops from every node that reaches one of the nodes."""
    out, front, d = {n: 0 for n in nodes}, set(nodes), 0
    while front:
        d += 1
        front = {a for a, b in pairs if b in front} - set(out)
        out |= {n: d for n in front}
    return out


def test_block_distances_sum_pairs_without_rounds(spark, monkeypatch):
    edges, pairs = _odd_graph(spark)
    targets, nearest = [302, 999, *range(0, 200, 2)], [(n, 0, 10.0 + n % 7 / 2) for n in range(0, 200, 3)] + [(301, 0, 2.5)]
    given = {n: x for n, _, x in nearest} | dict.fromkeys(targets, 0.0)
    hops = {s: _hops_to(pairs, [s]) for s in given}
    want = given | {n: 1 / sum(1 / (hops[s][n] + given[s]) for s in given if n in hops[s]) for n in {n for h in hops.values() for n in h} - set(given)}
    get = lambda: {r.node: r.distance for r in graph.block_distances(edges, spark.createDataFrame([(n,) for n in targets], "node int"), spark.createDataFrame(nearest, "node long, callee long, distance double")).collect()}
    same = lambda out: out.keys() == want.keys() and all(abs(out[n] - want[n]) < 1e-9 for n in want)
    monkeypatch.setattr(searches, "MOST_EDGES", 0)
    assert same(get())
    monkeypatch.undo()
    monkeypatch.setattr(graph, "distances", lambda *a, **b: pytest.fail("rounds of written pairs"))
    assert same(get())


def test_block_target_distances_without_rounds(spark, monkeypatch):
    edges, pairs = _odd_graph(spark)
    targets = [(f"t{n % 40}", n) for n in range(0, 200, 3)] + [("lone", 999), ("302", 302)]  # several blocks for a target
    calls, costs = [(n, 1000 + n % 3) for n in range(0, 200, 12)] + [(301, 1001)], [("u", 1000, 20), ("v", 1000, 30), ("u", 1001, 10), ("w", 1002, 40)]
    called, names = {n for n, _ in calls}, {}
    for t, n in targets:
        if n not in called:
            names.setdefault(t, []).append(n)
    want = {(n, t): 0.0 for t, x in names.items() for n in x} | {(n, t): float(c) for n, f in calls for t, g, c in costs if f == g}
    given = called | {n for x in names.values() for n in x}
    want |= {(n, t): float(d) for t, x in (names | {f"call:{n}": [n] for n in called}).items() for n, d in _hops_to(pairs, x).items() if n not in given}
    tables = [spark.createDataFrame(targets, "target string, node long"), spark.createDataFrame(calls, "node long, callee long"), spark.createDataFrame(costs, "source string, node long, cost int")]
    get = lambda: sorted(tuple(r) for r in graph.block_target_distances(edges, *tables).collect())
    want = sorted((*k, d) for k, d in want.items())
    monkeypatch.setattr(searches, "MOST_EDGES", 0)
    assert get() == want
    monkeypatch.undo()
    monkeypatch.setattr(graph, "distances", lambda *a, **b: pytest.fail("rounds of written pairs"))
    assert get() == want


def test_searches_in_blocks_and_steps_of_any_size(monkeypatch):
    rng = np.random.default_rng(5)
    ends = sorted({tuple(x) for x in rng.integers(0, 90, (260, 2)).tolist()} | {(4, x) for x in range(60)})
    heads, tails = (np.array(x, np.int32) for x in zip(*ends, strict=True))
    seeds = [np.unique(rng.integers(0, 90, i % 3)).astype(np.int32) for i in range(150)]
    weights = rng.random(150)
    weights[:70] = 0.25
    want = [_hops_to(ends, s.tolist()) for s in seeds]
    for step in (1, 200, 1 << 20):
        monkeypatch.setattr(searches, "STEP_BYTES", step)
        found = {}
        for hops, nodes, bits in searches.levels(heads, tails, 90, seeds):
            assert bits.any(axis=1).all()
            bit = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, :150]
            assert np.allclose(searches.weighed(bits, weights), bit @ weights)
            for r, s in zip(*np.nonzero(bit), strict=True):
                assert (s, nodes[r]) not in found
                found[s, nodes[r]] = hops
        assert found == {(s, n): d for s, w in enumerate(want) for n, d in w.items() if d}

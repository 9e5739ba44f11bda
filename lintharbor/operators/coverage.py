"""Coverage traces in sparse long form: bucketing, novelty, winners, covers, variance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import CRITICAL_HITS, HIT_CAP, MAP_SIZE, hit_bucket, num_equal_bits
from ..shipping import ship
from .graph import dense_index


def classified(trace: DataFrame) -> DataFrame:
    """(exec_id, edge, cnt) -> with bucket; absent edges are left out."""
    return trace.filter("cnt > 0").withColumn("bucket", hit_bucket(F.col("cnt")))


def novelty(trace: DataFrame) -> DataFrame:
    """Per execution, in order of exec_id: 2 for a new edge, 1 for a new bucket of a known edge, 0 for nothing new: (exec_id, novelty)."""
    rows = classified(trace).select("exec_id", "edge", "bucket")
    first_edge = rows.groupBy("edge").agg(F.min("exec_id").alias("e0"))
    first_bucket = rows.groupBy("edge", "bucket").agg(F.min("exec_id").alias("exec_id"))
    fresh = first_bucket.join(first_edge, "edge").select("exec_id", F.when(F.col("exec_id") == F.col("e0"), 2).otherwise(1).alias("new"))
    best = fresh.groupBy("exec_id").agg(F.max("new").alias("new"))
    return trace.select("exec_id").distinct().join(best, "exec_id", "left").select("exec_id", F.coalesce("new", F.lit(0)).alias("novelty"))


def crash_novelty(trace: DataFrame) -> DataFrame:
    """The same on simplified traces: an edge that was hit, or one that was absent, is new if no earlier execution had that.

    Absence isn't spread over all edges: edge e is first absent in the first execution that doesn't hit it, which is found from the
    rank of the executions that do. The first execution is always new."""
    rows = trace.filter("cnt > 0").select("exec_id", "edge").distinct()
    execs = trace.select("exec_id").distinct()
    ranked = dense_index(execs, ["exec_id"], "_i").select("exec_id", (F.col("_i") + 1).alias("at"))
    hits = rows.join(ranked, "exec_id").select("edge", "at").withColumn("k", F.row_number().over(Window.partitionBy("edge").orderBy("at")))
    hit_first = hits.groupBy("edge").agg(F.min("at").alias("at"))
    run = hits.groupBy("edge").agg(F.coalesce(F.max(F.when(F.col("at") == F.col("k"), F.col("at"))), F.lit(0)).alias("prefix"))
    absent_first = run.select((F.col("prefix") + 1).alias("at"))
    new = hit_first.select("at").unionByName(absent_first).distinct().withColumn("new", F.lit(1))
    return ranked.join(new, "at", "left").select("exec_id", F.when(F.col("at") == 1, 1).otherwise(F.coalesce("new", F.lit(0))).alias("unique"))


def edge_statistics(trace: DataFrame) -> DataFrame:
    """Per execution: edges hit, edges whose counter isn't full, and set bits of the counters: (exec_id, n_edges, n_not_full, n_bits)."""
    v = F.least(F.col("cnt"), F.lit(255))
    return trace.groupBy("exec_id").agg(F.count_if(v != 0).alias("n_edges"), F.count_if(v != 255).alias("n_not_full"), F.sum(F.bit_count(v)).cast("long").alias("n_bits"))


def checksums(trace: DataFrame) -> DataFrame:
    """A checksum per execution over its sorted (edge, bucket) pairs."""
    pairs = F.array_sort(F.collect_list(F.struct("edge", "bucket")))
    return classified(trace).groupBy("exec_id").agg(F.xxhash64(pairs).alias("checksum"))


def path_frequency(trace: DataFrame) -> DataFrame:
    """How many executions share each execution's trace: (exec_id, checksum, n_fuzz)."""
    sums = checksums(trace)
    return sums.join(sums.groupBy("checksum").agg(F.count("*").alias("n_fuzz")), "checksum").select("exec_id", "checksum", "n_fuzz")


def edge_winners(trace: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seed of least exec_us * len for each edge, of equal ones the newest: (edge, seed_id, cost)."""
    cost = seeds.select(F.col("seed_id").alias("exec_id"), (F.col("exec_us") * F.col("len")).alias("cost"))
    rows = trace.filter("cnt > 0").select("exec_id", "edge").join(cost, "exec_id")
    best = rows.groupBy("edge").agg(F.min(F.struct("cost", (-F.col("exec_id")).alias("newest"))).alias("m"))
    return best.select("edge", (-F.col("m.newest")).alias("seed_id"), F.col("m.cost").alias("cost"))


def block_winners(hits: DataFrame, seeds: DataFrame) -> DataFrame:
    """The seed for each critical block (exec_id, block): least distance, an unknown one (-1) before any other, then least exec_us * len, then newest."""
    known = seeds.select(F.col("seed_id").alias("exec_id"), "distance", (F.col("exec_us") * F.col("len")).alias("cost"))
    best = hits.select("exec_id", "block").distinct().join(known, "exec_id").groupBy("block").agg(F.min(F.struct("distance", "cost", (-F.col("exec_id")).alias("newest"))).alias("m"))
    return best.select("block", (-F.col("m.newest")).alias("seed_id"), F.col("m.distance").alias("distance"), F.col("m.cost").alias("cost"))


def tuple_frequency(trace: DataFrame) -> DataFrame:
    """In how many traces each (edge, class) occurs: (edge, bucket, n)."""
    return classified(trace).select("exec_id", "edge", "bucket").distinct().groupBy("edge", "bucket").agg(F.count("*").alias("n"))


def best_file_per_tuple(trace: DataFrame, seeds: DataFrame) -> DataFrame:
    """The smallest seed that has each (edge, class), of equal ones the first: (edge, bucket, seed_id)."""
    rows = classified(trace).select("exec_id", "edge", "bucket").join(seeds.select(F.col("seed_id").alias("exec_id"), "len"), "exec_id")
    return rows.groupBy("edge", "bucket").agg(F.min(F.struct("len", "exec_id")).alias("m")).select("edge", "bucket", F.col("m.exec_id").alias("seed_id"))


def _cover(winners: DataFrame, sets: DataFrame) -> DataFrame:
    """winners (seed_id, at, text, own) and sets (seed_id, tuples): a fold over the winners in order of ``at`` and ``text``: a tuple ``own`` that isn't covered yet takes its seed, whose whole trace is covered then.

    The fold is sequential by nature. It gets a row per winning seed, with its set once, and there is at most a winner for each edge of the map, or for each tuple."""
    rows = winners.groupBy("seed_id").agg(F.collect_list(F.struct("at", "text", "own")).alias("wins")).join(sets, "seed_id").select("seed_id", "wins", "tuples")

    def fold(pdf):
        import pandas as pd

        order = sorted((win["at"], win["text"], win["own"], i) for i, wins in enumerate(pdf["wins"]) for win in wins)
        seeds, sets_, covered, picked = pdf["seed_id"].tolist(), pdf["tuples"].tolist(), set(), {}
        for _, _, own, i in order:
            if own not in covered:
                picked.setdefault(seeds[i], len(picked))
                covered.update(sets_[i].tolist())
        return pd.DataFrame({"seed_id": list(picked), "pick": list(picked.values())}, dtype="int64")

    ship(winners.sparkSession)
    return rows.groupBy(F.lit(0).alias("g")).applyInPandas(lambda pdf: fold(pdf), "seed_id long, pick int")


def greedy_edge_cover(trace: DataFrame, seeds: DataFrame) -> DataFrame:
    """The favoured seeds: edges ascending, each uncovered edge takes its winner with all its edges: (seed_id, pick)."""
    winners = edge_winners(trace, seeds).select("seed_id", F.col("edge").cast("long").alias("at"), F.lit("").alias("text"), F.col("edge").cast("long").alias("own"))
    edges = trace.filter("cnt > 0").select(F.col("exec_id").alias("seed_id"), F.col("edge").cast("long").alias("edge")).join(winners.select("seed_id").distinct(), "seed_id", "left_semi")
    return _cover(winners, edges.groupBy("seed_id").agg(F.collect_set("edge").alias("tuples")))


def greedy_file_cover(trace: DataFrame, seeds: DataFrame) -> DataFrame:
    """A small corpus that keeps all (edge, class): the rarest first, of equal ones by the text of class (1 to 8) and edge, each uncovered one takes its smallest file: (seed_id, pick)."""
    code = lambda: F.col("bucket").cast("long") * (1 << 32) + F.col("edge")
    rare = tuple_frequency(trace).join(best_file_per_tuple(trace, seeds), ["edge", "bucket"])
    winners = rare.select("seed_id", F.col("n").alias("at"), F.concat((F.log2("bucket") + 1).cast("int").cast("string"), F.col("edge").cast("string")).alias("text"), code().alias("own"))
    mine = classified(trace).select(F.col("exec_id").alias("seed_id"), code().alias("t")).join(winners.select("seed_id").distinct(), "seed_id", "left_semi")
    return _cover(winners, mine.groupBy("seed_id").agg(F.collect_set("t").alias("tuples")))


def presence_bitmap(trace: DataFrame) -> DataFrame:
    """Per execution the edges hit, as a sparse bitmap of longs: (exec_id, word, bits), 64 edges a word."""
    rows = trace.filter("cnt > 0").select("exec_id", F.floor(F.col("edge") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(pmod(edge, 64) as int))").alias("bit"))
    return rows.groupBy("exec_id", "word").agg(F.bit_or("bit").alias("bits"))


def variable_edges(runs: DataFrame) -> DataFrame:
    """Of repeated runs (input_id, exec_id, edge, cnt) of the same input, the edges whose class differs from the first run's: (input_id, edge)."""
    rows = runs.filter("cnt > 0").select("input_id", "exec_id", "edge", hit_bucket(F.col("cnt")).alias("bucket"))
    of = runs.groupBy("input_id").agg(F.min("exec_id").alias("first"), F.countDistinct("exec_id").alias("n"))
    per = rows.groupBy("input_id", "edge").agg(F.count("*").alias("k"), F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    return per.join(of, "input_id").filter("k < n or a <> b").select("input_id", "edge")


def calibration(times: DataFrame, runs: DataFrame) -> DataFrame:
    """Of the runs of each input, times (input_id, exec_id, us) and runs (input_id, exec_id, edge, cnt): input_id, n_runs, exec_us (the whole mean) and bitmap_size, the edges of the last run."""
    per = times.groupBy("input_id").agg(F.count("*").alias("n_runs"), F.sum("us").alias("us"), F.max("exec_id").alias("exec_id"))
    sizes = runs.filter("cnt > 0").groupBy("input_id", "exec_id").agg(F.count("*").alias("bitmap_size"))
    return per.join(sizes, ["input_id", "exec_id"], "left").select("input_id", "n_runs", F.expr("us div n_runs").alias("exec_us"), F.coalesce("bitmap_size", F.lit(0).cast("long")).alias("bitmap_size"))


def calibration_means(calibrated: DataFrame) -> DataFrame:
    """The means over all calibrated inputs that the power schedule compares with, one row."""
    return calibrated.agg(F.expr("sum(exec_us * n_runs) div sum(n_runs)").alias("mean_us"), F.expr("sum(bitmap_size) div count(*)").alias("mean_bitmap"))


def stability(trace: DataFrame, variable: DataFrame, map_size: int = MAP_SIZE) -> DataFrame:
    """Coverage of the map and stability in percent, one row."""
    covered = trace.filter("cnt > 0").agg(F.countDistinct("edge").alias("covered"))
    moving = variable.agg(F.countDistinct("edge").alias("variable"))
    row = covered.crossJoin(moving)
    return row.select("covered", "variable", (F.col("covered") * 100.0 / map_size).alias("coverage"), F.coalesce(100 - F.try_divide(F.col("variable") * 100.0, F.col("covered")), F.lit(100.0)).alias("stability"))


def conformance_records(values: DataFrame) -> DataFrame:
    """(cnd_id, exec_id, a, b): executions at which a condition's operands have more equal bits than ever before: (cnd_id, exec_id, bits)."""
    rows = values.withColumn("bits", num_equal_bits(F.col("a"), F.col("b")))
    before = Window.partitionBy("cnd_id").orderBy("exec_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_best", F.max("bits").over(before)).filter("_best is null or bits > _best").select("cnd_id", "exec_id", "bits")


def conformance_holders(values: DataFrame) -> DataFrame:
    """The execution that holds each condition's record now: (cnd_id, exec_id, bits)."""
    rows = values.withColumn("bits", num_equal_bits(F.col("a"), F.col("b")))
    best = rows.groupBy("cnd_id").agg(F.max(F.struct("bits", (-F.col("exec_id")).alias("o"))).alias("m"))
    return best.select("cnd_id", (-F.col("m.o")).alias("exec_id"), F.col("m.bits").alias("bits"))


def condition_outcomes(rows: DataFrame) -> DataFrame:
    """(cnd_id, outcome boolean) -> 1 false, 2 true, 3 both."""
    return rows.groupBy("cnd_id").agg(F.bit_or(F.when(F.col("outcome"), 2).otherwise(1)).alias("outcomes"))


def hit_counts(rows: DataFrame, key: str, rare_below: int) -> DataFrame:
    """Hits per key, capped, and whether they are rare."""
    n = F.least(F.count("*"), F.lit(HIT_CAP))
    return rows.groupBy(key).agg(n.alias("hits")).withColumn("rare", F.col("hits") < rare_below)


def period_hit_counts(rows: DataFrame, key: str, period: str, most: int = CRITICAL_HITS) -> DataFrame:
    """Of (key, exec_id, period) the hits of each period that come among a key's first ``most``, over all keys: (period, n); a period without any has no row."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("exec_id"))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= most).groupBy(period).agg(F.count("*").alias("n"))


def directed_favourites(winners: DataFrame, block_hits: DataFrame, solved: DataFrame, holders: DataFrame, most_hits: int, outcomes: DataFrame | None = None, rare: DataFrame | None = None) -> DataFrame:
    """(seed_id): the seeds that reach a rare target (rare: seed_id), winners of critical blocks that are neither solved nor hit too often, and the holders (cnd_id, exec_id)
    of the records of conditions that haven't had both outcomes yet (outcomes: cnd_id, outcomes, 3 for both)."""
    open_ = winners.join(solved.select("block").distinct(), "block", "left_anti").join(block_hits, "block", "left").filter(F.coalesce("hits", F.lit(0)) < most_hits)
    if outcomes is not None:
        holders = holders.join(outcomes.filter("outcomes >= 3").select("cnd_id"), "cnd_id", "left_anti")
    out = open_.select("seed_id").unionByName(holders.select(F.col("exec_id").alias("seed_id")))
    return (out if rare is None else out.unionByName(rare.select("seed_id"))).distinct()


#: How many unique crashes and hangs a campaign keeps.
MOST_CRASHES, MOST_HANGS = 5000, 500


def unique_crashes(trace: DataFrame, on_target: DataFrame, most: int = MOST_CRASHES) -> DataFrame:
    """The crashes that a campaign keeps: of those that hit a target (exec_id) the first ``most`` whose simplified trace is new among them: (exec_id)."""
    gated = trace.join(on_target.select("exec_id").distinct(), "exec_id", "left_semi")
    return first_kept(crash_novelty(gated).filter(F.col("unique") == 1).select("exec_id"), most)


def kept(novelties: DataFrame, records: DataFrame) -> DataFrame:
    """Executions worth keeping: with novelty, or with a new conformance record."""
    return novelties.filter("novelty > 0").select("exec_id").unionByName(records.select("exec_id")).distinct()


def first_kept(rows: DataFrame, most: int, order: str = "exec_id") -> DataFrame:
    """The first ``most`` rows in order of arrival."""
    return rows.orderBy(order).limit(most)


def share_of_worker(rows: DataFrame, worker: int, workers: int, key: str = "checksum") -> DataFrame:
    """The rows that fall to one of several workers (from 1) by checksum."""
    return rows.filter(F.pmod(F.col(key), F.lit(workers)) == worker - 1)


def symbol_histogram(inputs: DataFrame, column: str = "content") -> DataFrame:
    """(symbol, n) over the bytes of all inputs."""
    return inputs.select(F.explode(F.regexp_extract_all(F.hex(column), F.lit(".."), F.lit(0))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def response_runs(rows: DataFrame) -> DataFrame:
    """Runs of bytes that move together: (input_id, at, cls, xff, x01, s10, a10) -> (input_id, start, length, cls), cls being the strongest of the run.

    A run ends where all four checksums change. A fixed run of 32 bytes and more is suspect."""
    w = Window.partitionBy("input_id").orderBy("at")
    sums = ["xff", "x01", "s10", "a10"]
    changed = F.lit(True)
    for c in sums:
        changed = changed & F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(True))
    rank = F.create_map(*[x for i, k in enumerate(("none", "minor", "variable", "fixed")) for x in (F.lit(k), F.lit(i))])
    marked = rows.withColumn("_new", changed.cast("int")).withColumn("_run", F.sum("_new").over(w)).withColumn("_rank", rank[F.col("cls")])
    valued = "value" in rows.columns
    extra = [F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("long").alias("v")))), lambda x: x["v"]).alias("b")] if valued else []
    size = rows.groupBy("input_id").agg(F.count("*").alias("_len"))
    out = marked.groupBy("input_id", "_run").agg(F.min("at").alias("start"), F.count("*").alias("length"), F.max("_rank").alias("r"), *extra).join(size, "input_id")
    name = F.element_at(F.array(*[F.lit(x) for x in ("none", "minor", "variable", "fixed")]), F.col("r") + 1)
    cls, fixed = F.when((F.col("r") == 3) & (F.col("length") >= 32), "suspect"), F.col("r") == 3
    if valued:  # short fixed runs: small integers may be lengths, uniform ones checksums
        b = lambda i: F.get("b", F.lit(i))
        for n in (2, 4):
            little, big = sum(b(i) * (1 << 8 * i) for i in range(n)), sum(b(n - 1 - i) * (1 << 8 * i) for i in range(n))
            uneven = F.abs(b(0) - b(1)) > 32 if n == 2 else (b(0) >= 128) != (b(1) >= 128)
            for i in range(2, n):
                uneven = uneven | ((b(0) >= 128) != (b(i) >= 128))
            here = fixed & (F.col("length") == n) & (little != 0)
            cls = cls.when(here & ((little <= F.col("_len")) | (big <= F.col("_len"))), "length").when(here & uneven, "checksum")
    return out.select("input_id", "start", "length", cls.otherwise(name).alias("cls"))

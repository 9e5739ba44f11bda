"""Directed campaigns: distances to active targets, vulnerability factors, the targets' states, the power schedule."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import MOST_FACTOR, MOST_SCORE, cooling, dist_factor, next_p2, scale
from ..shipping import ship
from .graph import dense_index

ACTIVE, PAUSED, FINISHED = "active", "paused", "finished"


def critical_distances(matrix: DataFrame, active: DataFrame) -> DataFrame:
    """(row, col, dist) and the active targets (col): per critical block the harmonic mean of its positive distances, -1 without any: (row, distance)."""
    own = matrix.join(active.select("col").distinct(), "col", "left_semi").filter("dist > 0")
    mean = own.groupBy("row").agg((F.count("*") / F.sum(1.0 / F.col("dist"))).alias("distance"))
    return matrix.select("row").distinct().join(mean, "row", "left").select("row", F.coalesce("distance", F.lit(-1.0)).alias("distance"))


def vulnerability_factors(hits: DataFrame, targets: DataFrame, most: float = 5.0) -> DataFrame:
    """(exec_id, target_id) and active targets (target_id, score): 1 for an execution that hits them all, ``most`` for one that hits none; null if none is active."""
    total = targets.agg(F.sum("score").alias("total"))
    met = hits.select("exec_id", "target_id").distinct().join(targets, "target_id", "left").groupBy("exec_id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("met"))
    x = scale(F.col("met"), 0.0, F.col("total"), 1.0, most)
    return met.crossJoin(F.broadcast(total)).select("exec_id", (F.lit(most) - x + 1).alias("factor"))  # total is one row


def seed_distances(diverged: DataFrame, distances: DataFrame, factors: DataFrame, default: float = 1.0) -> DataFrame:
    """Mean of distance * factor over the critical blocks (exec_id, row) at which an execution diverged and whose distance is known; -1 without any."""
    per = diverged.select("exec_id", "row").distinct().join(distances.filter("distance >= 0"), "row").groupBy("exec_id").agg(F.avg("distance").alias("mean"))
    rows = diverged.select("exec_id").distinct().join(per, "exec_id", "left").join(factors, "exec_id", "left")
    return rows.select("exec_id", F.coalesce(F.col("mean") * dist_factor(F.lit(default), F.col("factor")), F.lit(-1.0)).alias("distance"))


def distance_bounds(distances: DataFrame, cycle: str = "cycle") -> DataFrame:
    """Least and largest positive distance of each cycle."""
    return distances.filter("distance > 0").groupBy(cycle).agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


def queue_order(seeds: DataFrame) -> DataFrame:
    """The queue as a total order, the seeds' ``rank`` from 1: favoured first, known distances before unknown ones, nearer first, then by arrival."""
    keyed = seeds.withColumns({"_plain": ~F.col("favored"), "_unknown": F.col("distance") == -1})
    return dense_index(keyed, ["_plain", "_unknown", "distance", "seed_id"], "rank").withColumn("rank", F.col("rank") + 1).drop("_plain", "_unknown")


def rare_target_seeds(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """The seeds (seed_id) of hits (seed_id, target_id) that reach a target (target_id, state) which is active."""
    return hits.join(targets.filter(F.col("state") == ACTIVE).select("target_id"), "target_id", "left_semi").select("seed_id").distinct()


def conditions_of(blocks: DataFrame, conditions: DataFrame) -> DataFrame:
    """Each critical block (block) with its condition (cnd_id), 0 for none; of a block's records (cbb_id, cnd_id, ordinal) the last one counts."""
    last = conditions.filter("cbb_id is not null").groupBy("cbb_id").agg(F.max_by("cnd_id", "ordinal").alias("cnd_id"))
    return blocks.select("block").join(last.withColumnRenamed("cbb_id", "block"), "block", "left").select("block", F.coalesce("cnd_id", F.lit(0)).alias("cnd_id"))


def append_to_queue(queue: DataFrame, found: DataFrame) -> DataFrame:
    """``queue`` (seed_id, depth, len, n_fuzz, is_target, ...) and what was found (src, len, is_target, at, ...), numbered on in order of ``at``, one deeper than the seeds they come from.

    A source that isn't in the queue is at depth 0. Columns that only the queue has are null in new seeds."""
    top = queue.agg(F.coalesce(F.max("seed_id"), F.lit(-1)).alias("_top"))  # one row
    new = dense_index(found, ["at", "src"], "_nth").join(queue.select(F.col("seed_id").alias("src"), F.col("depth").alias("_depth")), "src", "left").crossJoin(F.broadcast(top))
    new = new.select((F.col("_top") + 1 + F.col("_nth")).alias("seed_id"), (F.coalesce("_depth", F.lit(0)) + 1).cast("int").alias("depth"), "len", F.lit(1).cast("long").alias("n_fuzz"), "is_target")
    return queue.unionByName(new, allowMissingColumns=True)


def queue_counters(queue: DataFrame) -> DataFrame:
    """One row: queued_paths, pending_not_fuzzed and max_depth of a queue (depth, was_fuzzed)."""
    return queue.agg(F.count("*").alias("queued_paths"), F.count_if(~F.coalesce("was_fuzzed", F.lit(False))).alias("pending_not_fuzzed"), F.max("depth").alias("max_depth"))


def power_schedule(seeds: DataFrame, min_distance: float, max_distance: float, progress: float, schedule: str = "exp", directed: bool = True, fast: bool = False) -> DataFrame:
    """seed_id and perf_score. Every product is cut to an integer before the next one.

    seeds: seed_id, exec_us, bitmap_size, handicap, depth, distance, and for ``fast`` is_target, fuzz_level, n_fuzz."""
    mean = seeds.agg(F.floor(F.avg("exec_us")).alias("avg_us"), F.floor(F.avg("bitmap_size")).alias("avg_map"))
    rows = seeds.crossJoin(F.broadcast(mean))  # one row
    us, size, depth = F.col("exec_us"), F.col("bitmap_size"), F.col("depth")
    by_speed = F.when(us * 0.1 > F.col("avg_us"), 10).when(us * 0.25 > F.col("avg_us"), 25).when(us * 0.5 > F.col("avg_us"), 50).when(us * 0.75 > F.col("avg_us"), 75)
    score = by_speed.when(us * 4 < F.col("avg_us"), 300).when(us * 3 < F.col("avg_us"), 200).when(us * 2 < F.col("avg_us"), 150).otherwise(100)
    by_map = F.when(size * 0.3 > F.col("avg_map"), 3.0).when(size * 0.5 > F.col("avg_map"), 2.0).when(size * 0.75 > F.col("avg_map"), 1.5)
    by_map = by_map.when(size * 3 < F.col("avg_map"), 0.25).when(size * 2 < F.col("avg_map"), 0.5).when(size * 1.5 < F.col("avg_map"), 0.75).otherwise(1.0)
    score = F.floor(score * by_map)
    score = score * F.when(F.col("handicap") >= 4, 4).when(F.col("handicap") > 0, 2).otherwise(1)
    score = score * F.when(depth <= 3, 1).when(depth <= 7, 2).when(depth <= 13, 3).when(depth <= 25, 4).otherwise(5)
    if directed:
        t = cooling(F.lit(float(progress)), schedule)
        near = F.lit(0.0) if max_distance == min_distance else (F.col("distance") - F.lit(float(min_distance))) / F.lit(float(max_distance - min_distance))
        p = (1 - near) * (1 - t) + 0.5 * t
        power = F.when((F.col("distance") > 0) & (near >= 0), F.pow(F.lit(2.0), F.lit(2 * math.log2(MOST_FACTOR)) * (p - 0.5))).otherwise(1.0)
        score = F.floor(score * power)
    if fast:
        n = F.coalesce(F.col("n_fuzz"), F.lit(0))
        low = F.floor(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.col("fuzz_level"), F.lit(30))) / F.greatest(n, F.lit(1)))
        high = F.floor(F.lit(32) / F.when(n == 0, 1).otherwise(next_p2(n)))
        factor = F.least(F.when(F.col("fuzz_level") < 16, low).otherwise(high), F.lit(32))
        score = score * F.when(F.col("is_target"), factor).otherwise(1)
    return rows.select("seed_id", F.least(score, F.lit(MOST_SCORE)).cast("long").alias("perf_score"))


def cycle_boundaries(durations: DataFrame, init: int, campaign: str = "campaign") -> DataFrame:
    """The growing cycles of each campaign: (campaign, cycle, starts, ends), over the whole of its ``duration`` seconds."""

    def fold(pdf):
        import pandas as pd

        rows = []
        for name, total in pdf[[campaign, "duration"]].itertuples(index=False):
            at, n, interval = 0, 0, init
            while at <= total:
                rows.append((name, n, at, at + interval))
                at, n = at + interval, n + 1
                interval = init + int(math.log2(at / 3600 + 1) * 150)
        return pd.DataFrame(rows, columns=[campaign, "cycle", "starts", "ends"])

    ship(durations.sparkSession)
    kind = dict(durations.dtypes)[campaign]
    return durations.select(campaign, F.col("duration").cast("long")).mapInPandas(lambda it: (fold(pdf) for pdf in it), f"{campaign} {kind}, cycle int, starts long, ends long")


def round_half_away(x: float) -> int:
    return int(math.floor(abs(x) + 0.5) * (1 if x >= 0 else -1))


class TargetStates:
    """The states of one campaign's targets, advanced once a cycle."""

    def __init__(self, scores: dict, threshold: float = 0.5):
        self.threshold = threshold
        self.targets = {t: {"state": ACTIVE, "score": s, "execs": 0, "skips": 0, "previous": 1} for t, s in sorted(scores.items())}

    def step(self, inputs: int, hits: dict, blocks_solved: bool, blocks_exhausted: bool = False) -> str:
        """Advance by a cycle of ``inputs`` executions; ``hits``: target -> executions that reached it. Returns the next cycle's mode."""
        open_ = {t: x for t, x in self.targets.items() if x["state"] != FINISHED}
        total = sum(x["score"] for x in open_.values())
        for t, x in open_.items():
            x["execs"] += hits.get(t, 0)
            required = max(1, round_half_away(inputs * x["score"] / total)) if total else 1
            if x["execs"] >= required:
                x["state"] = FINISHED
            elif hits.get(t, 0):
                x.update(state=ACTIVE, skips=0, previous=1)
            elif x["skips"] == 0:
                x.update(state=PAUSED, skips=x["previous"], previous=x["previous"] + 1)
            elif x["skips"] == 1:
                x.update(state=ACTIVE, skips=0)
            else:
                x["skips"] -= 1
        states = [x["state"] for x in self.targets.values()]
        finished, resting = all(s == FINISHED for s in states), all(s != ACTIVE for s in states)
        if blocks_solved and finished:
            for x in self.targets.values():
                if x["score"] >= self.threshold:
                    x.update(state=ACTIVE, execs=0, skips=0, previous=1)
            return "restart"
        if not blocks_solved and blocks_exhausted:
            return "coverage"
        return "coverage" if resting else "directed"

    def rows(self, cycle: int, mode: str) -> Iterable[tuple]:
        for t, x in self.targets.items():
            yield cycle, mode, t, x["state"], x["execs"], x["skips"], x["previous"]


def target_state_machine(cycles: DataFrame, targets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fold each campaign's cycles over its targets' states.

    cycles: campaign, cycle, inputs, solved, exhausted, hits map<bigint,bigint>. targets: campaign, target_id, score. All targets of a campaign
    hang together through the sum of their scores, so a campaign is one group; it has a row per cycle, pre-aggregated."""
    ship(cycles.sparkSession)
    scored = targets.groupBy("campaign").agg(F.map_from_entries(F.collect_list(F.struct("target_id", F.col("score").cast("double")))).alias("scores"))
    rows = cycles.join(scored, "campaign")

    def fold(pdf):
        import pandas as pd

        states, out = None, []
        for row in pdf.sort_values("cycle").to_dict("records"):
            states = states or TargetStates(dict(row["scores"]), threshold)
            mode = states.step(int(row["inputs"]), dict(row["hits"] or {}), bool(row["solved"]), bool(row["exhausted"]))
            out += [(row["campaign"], *r) for r in states.rows(int(row["cycle"]), mode)]
        return pd.DataFrame(out, columns=["campaign", "cycle", "mode", "target_id", "state", "execs", "skips", "previous"])

    kind = dict(cycles.dtypes)["campaign"]
    return rows.groupBy("campaign").applyInPandas(fold, f"campaign {kind}, cycle int, mode string, target_id long, state string, execs long, skips long, previous long")


def state_tallies(states: DataFrame) -> DataFrame:
    """Per campaign and cycle the number of targets in each state and of those ever hit."""
    return states.groupBy("campaign", "cycle").agg(*[F.count_if(F.col("state") == s).alias(s) for s in (ACTIVE, PAUSED, FINISHED)], F.count_if(F.col("execs") > 0).alias("hit"))


def skip_probability(seeds: DataFrame, cycle_count: int = 2, explore: bool = True) -> DataFrame:
    """The chance that a seed is passed over, in percent, as a column instead of a draw. A dead seed (is_dead, where there is such a column) always is, and no other outside of exploration.

    With favoured ones pending in the campaign, 99 if fuzzed before or not favoured. Else, in a queue of over ten, for one that isn't favoured: 75 if it is new and a cycle is over, 95 otherwise."""
    per = seeds.groupBy("campaign").agg(F.max(F.col("favored") & ~F.col("was_fuzzed")).alias("_pending"), F.count("*").alias("_queued"))
    dead = F.col("is_dead") if "is_dead" in seeds.columns else F.lit(False)
    percent = F.when(dead, 100).when(~F.lit(explore), 0).when(F.col("_pending"), F.when(F.col("was_fuzzed") | ~F.col("favored"), 99).otherwise(0))
    percent = percent.when(F.col("favored") | (F.col("_queued") <= 10), 0).when(F.lit(cycle_count > 1) & ~F.col("was_fuzzed"), 75).otherwise(95)
    return seeds.join(per, "campaign").select(*seeds.columns, percent.alias("skip_percent"))


def mask_positions(mask: DataFrame, kind: int, size: int = 1) -> DataFrame:
    """Where an input's mask (input_id, at, flags: bits 1 flip, 2 delete, 4 insert) allows a change of ``kind`` to ``size`` neighbouring bytes: (input_id, at).

    Within each run of allowed places, those from which the change fits into the run."""
    allowed = mask.filter(F.col("flags").bitwiseAND(kind) != 0).select("input_id", "at")
    if kind == 4 or size <= 1:
        return allowed
    w = Window.partitionBy("input_id").orderBy("at")
    runs = allowed.withColumn("_run", F.col("at") - F.row_number().over(w))
    return runs.withColumn("_end", F.max("at").over(Window.partitionBy("input_id", "_run"))).filter(F.col("at") + size - 1 <= F.col("_end")).select("input_id", "at")


def needs_sniffing(seeds: DataFrame, open_conditions: DataFrame, most_len: int = 1000) -> DataFrame:
    """Which of seeds (seed_id, len, is_rare_target) are worth probing byte by byte: short ones that reach a rare target or have an open condition (seed_id, ...)."""
    waiting = open_conditions.select("seed_id", F.lit(True).alias("_open")).distinct()
    need = (F.col("len") <= most_len) & (F.col("is_rare_target") | F.coalesce("_open", F.lit(False)))
    return seeds.join(waiting, "seed_id", "left").select("seed_id", need.alias("need_sniff"))


def critical_flags(seeds: DataFrame, values: DataFrame, rare_now: bool = False, explore: bool = False) -> DataFrame:
    """What a probe of each seed (seed_id, is_rare_target) has moved: 3 a rare target hit again, else 1 (2 when exploring) where an open condition's operands
    differ from the seed's own, else 0. values: seed_id, own_a, own_b, now_a, now_b of open conditions; nulls equal nulls."""
    moved = values.filter(~F.col("own_a").eqNullSafe(F.col("now_a")) | ~F.col("own_b").eqNullSafe(F.col("now_b"))).select("seed_id", F.lit(2 if explore else 1).alias("_moved")).distinct()
    return seeds.join(moved, "seed_id", "left").select("seed_id", F.when(F.col("is_rare_target") & F.lit(rare_now), 3).otherwise(F.coalesce("_moved", F.lit(0))).alias("flag"))

"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are quantised to integers and stored in blocks of neighbouring rows, each with its forward index (the matrix) and the
maximum and minimum of every dimension (term). Rows are ordered by the nearest of a few pivots before blocks are cut, so that a block's terms lie
close together. A query's bound for a block sums its terms' best products. Every task orders
its blocks by that bound per query and scores them until the next bound falls below the k-th score; equal bounds are still
scored, for the sake of ties. No task starts blindly: the k-th score among the pivots bounds a query's k-th score from the outset. The tasks' winners are merged. Vectors that lie in no clusters, as random ones do, have no block whose bound falls
below the k-th score; for these all blocks are scored (``work`` tells the share).

Queries are sent to all tasks in batches of a fixed number of rows, so that what is broadcast doesn't grow with the data. Pivots are a sample of
``PIVOTS`` rows, the same for equal tables; they decide about the order only, every row is indexed.

Cases: null vectors, and those with null or non-finite components, take no part, nor do rows without vec_id; vectors of
different dimension have no score; query rows that share a vec_id but differ have a list each; a repeated query row is answered once, while repeated candidate rows are rows of their own;
rows that share the query's vec_id are never its candidates; ties go to the smaller vec_id; scores beyond 64 bits raise an error; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, materialize, partitions, work_dir

BLOCK_ROWS, GROUP_BLOCKS, QUERY_BATCH, PIVOTS = 256, 128, 16_384, 256
BLOCKS = "dim int, n int, ids binary, matrix binary, hi binary, lo binary"


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id and v, the vector as array<bigint> of floor(scale * x); rows that take no part are left out."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def _build(block_rows: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def row(dim: int, ids: list, vectors: list) -> tuple:
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            m = np.array(vectors, np.int64).reshape(len(ids), dim)[order]
            small = not m.size or max(m.max(), -m.min()) < 1 << 31
            kind = np.int32 if small else np.int64
            hi, lo = (m.max(0), m.min(0)) if m.size else (np.zeros(0, np.int64),) * 2
            return dim, len(ids), np.array(ids, np.int64)[order].tobytes(), m.astype(kind).tobytes(), hi.astype(np.int64).tobytes(), lo.astype(np.int64).tobytes()

        def table(rows: list) -> pa.RecordBatch:
            types = (pa.int32(), pa.int32(), *(pa.binary(),) * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            rows = []
            column = batch.column("v")
            ids, flat = batch.column("vec_id").to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            for i, v in zip(ids.tolist(), np.split(flat, ends[:-1]), strict=True):
                mine = held.setdefault(len(v), ([], []))
                mine[0].append(i)
                mine[1].append(v)
                if len(mine[0]) >= block_rows:
                    rows.append(row(len(v), *held.pop(len(v))))
            if rows:
                yield table(rows)
        if rows := [row(d, *x) for d, x in held.items()]:
            yield table(rows)

    return build


def pivots_of(vectors: DataFrame, most: int = PIVOTS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (vec_ids, matrix) of at most ``most`` rows, each next to the nearest one that isn't placed yet."""
    some = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(most).select("vec_id", "v").toArrow().to_pydict()
    by: dict[int, tuple[list, list]] = {}
    for i, v in zip(some["vec_id"], some["v"], strict=True):
        by.setdefault(len(v), ([], []))[0].append(i)
        by[len(v)][1].append(v)
    out = {}
    for d, (ids, rows) in by.items():
        m = np.array(rows, np.int64)
        wide = m.astype(np.float64)
        far = (wide * wide).sum(1) - 2 * wide @ wide.T  # of a row: its distances, but for its own norm
        chain, left = [0], set(range(1, len(ids)))
        while left:
            chain.append(min(left, key=lambda i: (far[chain[-1], i], i)))  # noqa: B023
            left.remove(chain[-1])
        if d:
            out[d] = np.array(ids, np.int64)[chain], m[chain]
    return out


def floors(pivots: dict, dim: int, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best can't be below: that among the pivots, which are candidates too."""
    of, m = pivots.get(dim, (np.zeros(0, np.int64), None))
    if len(of) < k:
        return np.full(len(ids), NOTHING)
    s = _exact(m, queries).T.copy()
    s[ids[:, None] == of[None, :]] = NOTHING
    return np.sort(s, axis=1)[:, -k]


def ordered(vectors: DataFrame, pivots: dict) -> DataFrame:
    """``vectors`` (vec_id, v) in the order of dimension, nearest pivot and vec_id, whose ranges are the partitions."""
    sets = {d: m.astype(np.float64) for d, (_, m) in pivots.items()}

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            parts = np.split(column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]) if len(sizes) else []
            which = np.zeros(len(sizes), np.int64)
            for d, p in sets.items():
                if len(mine := np.flatnonzero(sizes == d)):
                    m = np.stack([parts[i] for i in mine]).astype(np.float64)
                    which[mine] = ((p * p).sum(1) - 2 * m @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(sizes, pa.int32()), pa.array(which, pa.int32())], names=["vec_id", "v", "dim", "pivot"])

    placed = vectors.mapInArrow(near, "vec_id long, v array<long>, dim int, pivot int")
    order = ["dim", "pivot", "vec_id"]
    return placed.repartitionByRange(partitions(vectors.sparkSession), *order).sortWithinPartitions(*order).select("vec_id", "v")


def build_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of consecutive rows of ``vectors`` (vec_id, v), by ascending vec_id within."""
    return vectors.mapInArrow(_build(block_rows), BLOCKS)


def _matrix(row: dict) -> np.ndarray:
    n, dim = row["n"], row["dim"]
    kind = np.int64 if n * dim and len(row["matrix"]) == 8 * n * dim else np.int32
    return np.frombuffer(row["matrix"], kind).reshape(n, dim)


def _exact(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """m @ q.T in integers: by floating point where every partial sum is exact, else in Python's integers if 64 bits may not do."""
    top = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    most = top(m) * top(q) * max(1, m.shape[1])
    if most < 2**52:
        return (m.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return m.astype(np.int64) @ q.T.astype(np.int64)
    wide = m.astype(object) @ q.T.astype(object)
    if any(abs(x) >= 2**63 - 2 for x in wide.ravel()):
        raise OverflowError("a score doesn't fit in 64 bits")
    return wide.astype(np.int64)


NOTHING = -(2**63) + 1


def search_group(blocks: list[dict], query_ids: np.ndarray, queries: np.ndarray, k: int, best: np.ndarray, who: np.ndarray, floor: np.ndarray | int = -(2**63)) -> int:
    """Improve best (scores) and who (ids), both queries x k, by the blocks; returns the number of (query, block) pairs scored. ``floor``: known bounds of the k-th scores."""
    hi = np.stack([np.frombuffer(b["hi"], np.int64) for b in blocks])
    lo = np.stack([np.frombuffer(b["lo"], np.int64) for b in blocks])
    wide = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (hi, lo)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(1, hi.shape[1])
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _exact(hi, up) + _exact(lo, down) if wide < 2**61 else np.full((len(blocks), len(queries)), 2**63 - 1)
    order = np.argsort(-bounds, axis=0, kind="stable")
    columns, scored, floor = np.arange(len(queries)), 0, np.broadcast_to(floor, len(queries))
    for r in range(len(blocks)):
        b = order[r]
        columns = columns[bounds[b[columns], columns] >= np.maximum(best[columns, -1], floor[columns])]  # a later bound is no higher: a query that stops here is done
        if not len(columns):
            break
        scored += len(columns)
        for which in np.unique(b[columns]):
            qs = columns[b[columns] == which]
            block = blocks[which]
            ids = np.frombuffer(block["ids"], np.int64)
            s = _exact(_matrix(block), queries[qs]).T.copy()
            s[query_ids[qs][:, None] == ids[None, :]] = NOTHING
            if s.shape[1] > k:
                room = (2**62) // s.shape[1]
                if np.abs(s[s != NOTHING]).max(initial=0) < room:  # one key for score and place, so that a partition orders ties too
                    key = np.where(s == NOTHING, -(2**62), s * s.shape[1] + (s.shape[1] - 1 - np.arange(s.shape[1])))
                    top = np.argpartition(-key, k - 1, axis=1)[:, :k]
                else:
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                s, found = np.take_along_axis(s, top, 1), ids[top]
            else:
                found = np.broadcast_to(ids, s.shape)
            both, names = np.concatenate([best[qs], s], 1), np.concatenate([who[qs], found], 1)
            pick = np.lexsort((names, -both), axis=1)[:, :k]
            best[qs], who[qs] = np.take_along_axis(both, pick, 1), np.take_along_axis(names, pick, 1)
    return scored


def _searcher(shared, k: int, group_blocks: int):
    names = ["query_id", "mark", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, scored, met = {}, 0, 0
        for dim, ids, marks, matrix, floor in shared.value:
            q = np.frombuffer(matrix, np.int64).reshape(len(ids) // 8, dim)
            sets[dim] = (np.frombuffer(ids, np.int64), np.frombuffer(marks, np.int64), q, np.full((len(q), k), NOTHING), np.full((len(q), k), 2**63 - 1), np.frombuffer(floor, np.int64))
        held: dict[int, list] = {}

        def search(dim: int) -> None:
            nonlocal scored, met
            ids, _, q, best, who, floor = sets[dim]
            blocks = held.pop(dim)
            scored += search_group(blocks, ids, q, k, best, who, floor)
            met += len(blocks) * len(q)

        for batch in batches:
            for row in batch.to_pylist():
                if row["dim"] in sets:
                    held.setdefault(row["dim"], []).append(row)
                    if len(held[row["dim"]]) >= group_blocks:
                        search(row["dim"])
        for dim in list(held):
            search(dim)
        for ids, marks, _, best, who, _ in sets.values():
            i, j = np.nonzero(best != NOTHING)
            for a in range(0, len(i), 8192):
                s = slice(a, a + 8192)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[s]]), pa.array(marks[i[s]]), pa.array(who[i[s], j[s]]), pa.array(best[i[s], j[s]])], names=names)
        # a row without query tells the work: (query, block) pairs met and scored
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, met, scored)], names=names)

    return run


FOUND = "query_id long, mark long, vec_id long, score long"


def _search(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int, batch: int) -> DataFrame:
    """The tasks' winners, as a written table of FOUND; ``mark`` tells query rows of one vec_id apart."""
    spark = candidates.sparkSession
    bounded_batches(spark)
    folder = work_dir(spark, "topk")
    vectors = materialize(candidates.select("vec_id", "v"), f"{folder}/vectors")
    pivots = pivots_of(vectors)
    index = materialize(build_blocks(ordered(vectors, pivots), block_rows), f"{folder}/blocks")
    asked = materialize(queries.dropDuplicates(["vec_id", "v"]).select("vec_id", F.xxhash64("v").alias("mark"), "v"), f"{folder}/queries")
    count, rounds = asked.count(), 1
    if count > batch:
        rounds = -(-2 * count // batch)  # by hash: twice as many as needed, so that none is over the bound
        # a folder for each batch, so that a round reads its own rows only
        dealt = asked.withColumn("round", F.pmod(F.xxhash64("vec_id", "v"), F.lit(rounds))).repartition("round")
        dealt.write.partitionBy("round").parquet(f"{folder}/rounds")
        asked = spark.read.schema(dealt.schema).parquet(f"{folder}/rounds")
    for i in range(rounds):
        mine = asked if rounds == 1 else asked.filter(F.col("round") == i).drop("round")
        rows = mine.limit(batch + 1).toArrow().to_pydict()
        if len(rows["vec_id"]) > batch:
            raise RuntimeError("a batch of queries is over its bound")
        by_dim: dict[int, list[int]] = {}
        for n, v in enumerate(rows["v"]):
            by_dim.setdefault(len(v), []).append(n)
        sets = []
        for d, own in by_dim.items():
            ids, marks, q = (np.array([rows[c][n] for n in own], np.int64) for c in ("vec_id", "mark", "v"))
            sets.append((d, ids.tobytes(), marks.tobytes(), q.tobytes(), floors(pivots, d, ids, q.reshape(len(own), d), k).tobytes()))
        shared = spark.sparkContext.broadcast(sets)
        index.mapInArrow(_searcher(shared, k, GROUP_BLOCKS), FOUND).write.mode("append").parquet(f"{folder}/found")
        shared.unpersist()
    discard(spark, folder, "vectors", "blocks", "queries", "rounds")
    return spark.read.schema(FOUND).parquet(f"{folder}/found")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, batch: int = QUERY_BATCH) -> DataFrame:
    """The k best candidates of each query, both (vec_id, v): query_id, rank, vec_id, score."""
    found = _search(queries, candidates, k, block_rows, batch).filter("query_id is not null")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def work(queries: DataFrame, candidates: DataFrame, k: int = 5, block_rows: int = BLOCK_ROWS, batch: int = QUERY_BATCH) -> DataFrame:
    """How many pairs of query and block a search meets, and how many of them it scores: met, scored."""
    found = _search(queries, candidates, k, block_rows, batch).filter("query_id is null")
    return found.agg(F.sum("vec_id").alias("met"), F.sum("score").alias("scored"))

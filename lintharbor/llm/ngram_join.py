"""Similarity self-join on word shingles by a MinHash LSH forest, with exact verification.

Every text becomes the set of its five-word shingles; texts with equal sets are one class of copies and represented once. A
class has a label in each of ``TREES`` trees: ``DEEPEST`` min-hashes. Labels sorted by tree are a prefix trie: a label's longest common
prefix with its neighbours is its deepest match, and a run of labels with a common prefix is a node. Labels that match nowhere down to the floor,
the depth at which even a pair at the asked similarity shares a node with the target recall, are left out at once.

Matching begins with the deepest prefixes. The members of a node are candidates of each other; they are verified on their whole shingle
sets. Then prefixes are shortened: a pair of similarity s shares a prefix of depth k in some tree with probability p = 1 - (1 - s^k)^trees, so every pair found
stands for 1 / p pairs, and what was found tells how many pairs are missed yet and how many each shorter depth would miss. The longest one that
reaches the target recall comes next, until the estimate holds; it can't go below the floor. Of a shorter depth only nodes that branch are visited, and a pair counts at the depth at which it first matches.

Nothing is emitted per pair: a node gives one edge per member, components of candidates are split into units of bounded size
(whole components, or pairs of blocks of a large component or of its nodes, whichever reads fewer rows), and a unit returns per
member the number of rows it is linked to, one edge of a spanning forest, and a histogram of its pairs' similarities. Copies enter as multiplicities.

Words are runs of letters and digits, in lower case. Shingles are compared by 64-bit hashes.

Cases: null texts and texts without words are linked to nothing; a text of one to four words is one shingle; a document is named
by its doc_id and the hash of its text, so rows with different texts under one doc_id are different documents; rows without doc_id are named by a negative number made of their text;
texts are read whole; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, join_unique, materialize, partitions, shielded, work_dir
from .components import connected_components

WORDS, SIMILARITY = 5, 0.8
TREES, DEEPEST, TARGET = 24, 8, 0.99999
#: A component of more rows than the first, or more shingles than the third, is verified in pairs of blocks of the second's size.
WHOLE_ROWS, BLOCK_ROWS, BLOCK_SHINGLES = 800, 400, 1_000_000
#: Edges (of 32 bytes) up to which components are found by one task.
SMALL_GRAPH = 100_000
#: Of the histogram of similarities.
BUCKETS = 1000
#: Words whose hashes a Python worker remembers.
KNOWN_WORDS = 150_000
WORD = re.compile(r"[^\W_]+")
SKETCH = "d long, h long, set_hash binary, n long, labels array<long>"
TRIE = "tree int, hi long, lo long, d long, h long, matched int"
LINKS = "d long, h long, linked long, root long, root_h long, bucket int, pairs long"


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """That a pair shares a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEEPEST, target: float = TARGET) -> int:
    """The floor: the depth at which even a pair at the asked similarity is matched with the target recall (or one level is left)."""
    depth = deepest
    while depth > 1 and chance(similarity, depth, trees) < target:
        depth -= 1
    return depth


def next_depth(found: dict[int, int], depth: int, similarity: float, trees: int, target: float, floor: int) -> int:
    """The depth that the pairs found so far ask for: ``depth`` itself where the target recall is reached.

    found: pairs by bucket of similarity. A pair at the asked similarity that nobody has seen is always added, so that few pairs prove little."""
    share = {b: max(similarity, b / BUCKETS) for b in found}
    stand_for = {b: n / chance(share[b], depth, trees) for b, n in found.items()}
    total = sum(stand_for.values()) + 1
    for k in range(depth, floor, -1):
        missed = sum(n * (1 - chance(share[b], k, trees)) for b, n in stand_for.items()) + 1 - chance(similarity, k, trees)
        if missed <= (1 - target) * total:
            return k
    return floor


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_hashes() -> dict:
    return {}


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The ascending distinct 64-bit hashes of the text's shingles."""
    import xxhash

    found = WORD.findall(text.lower()) if text else []
    if not found:
        return np.zeros(0, np.uint64)
    known = _word_hashes()
    if len(known) > KNOWN_WORDS:
        known.clear()
    try:
        w = np.array([known[x] for x in found], np.uint64)
    except KeyError:
        for x in found:
            if x not in known:
                known[x] = xxhash.xxh64_intdigest(x)
        w = np.array([known[x] for x in found], np.uint64)
    n = min(words, len(w))
    m = len(w) - n + 1
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + w[i : i + m])
    return np.unique(out)


@lru_cache(maxsize=4)
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    a, b = r.integers(0, 2**32, (2, count), np.uint32)
    return a | np.uint32(1), b


def signature(s: np.ndarray, trees: int = TREES) -> np.ndarray:
    """The label in each tree: trees x DEEPEST numbers of 16 bits, a hash of each min-hash."""
    a, b = _multipliers(trees * DEEPEST)
    x = (s >> np.uint64(32)).astype(np.uint32)  # already mixed: a linear map reorders it well enough
    low = np.full(trees * DEEPEST, np.uint32(2**32 - 1))
    step = max(1, (1 << 18) // len(low))
    for i in range(0, len(x), step):
        np.minimum(low, (x[None, i : i + step] * a[:, None] + b[:, None]).min(1), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).reshape(trees, DEEPEST)


def packed(label: np.ndarray) -> np.ndarray:
    """Two longs for each tree, whose bits from the highest down are the label."""
    return label.astype(">u2").reshape(-1).view(">i8").astype(np.int64)


def unpacked(longs: list[int]) -> np.ndarray:
    return np.array(longs, np.int64).astype(">i8").view(">u2").reshape(-1, DEEPEST)


def _sketcher(words: int, trees: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, labels = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                labels.append(packed(signature(s, trees)) if len(s) else np.zeros(0, np.int64))
            columns = [batch.column("d"), batch.column("h"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["d", "h", "set_hash", "n", "labels"])

    return sketch


def _common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many 16-bit numbers the rows (hi, lo) of two tables share from the front."""
    same = (a.astype(">i8").view(">u2") == b.astype(">i8").view(">u2")).reshape(len(a), DEEPEST)
    return np.where(same.all(1), DEEPEST, (~same).argmax(1))


def _matcher(floor: int):
    """Over sorted labels: each with the depth of its deepest match, its neighbours' or, at a partition's ends, perhaps more; without match down to the floor it goes."""
    names = ["tree", "hi", "lo", "d", "h"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose next neighbour isn't known

        def told(table: list[np.ndarray], first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
            label = np.stack([table[1], table[2]], 1)
            near = np.where(table[0][1:] == table[0][:-1], _common_prefix(label[1:], label[:-1]), 0) if len(label) > 1 else np.zeros(0, np.int64)
            ends = lambda on: [DEEPEST if on else 0]
            return np.concatenate([ends(first), near]), np.concatenate([near, ends(last)])

        def out(table: list[np.ndarray], depth: np.ndarray) -> pa.RecordBatch:
            keep = depth >= floor
            return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*table, depth.astype(np.int32))], names=[*names, "matched"])

        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if held is not None:
                table = [np.concatenate([[a], b]).astype(b.dtype) for a, b in zip(held[0], table, strict=True)]
            ahead, behind = told(table, first, False)
            if held is not None:
                ahead[0] = held[1]
            depth = np.maximum(ahead, behind)
            if len(depth) > 1:
                yield out([c[:-1] for c in table], depth[:-1])
            held, first = ([c[-1] for c in table], ahead[-1]), False
        if held is not None:
            yield out([np.array([x]) for x in held[0]], np.array([DEEPEST]))

    return match


def verify(sets: list[np.ndarray], sides: np.ndarray, similarity: float, allowed=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, those j that i is similar to, the similarities) over the members of a unit. Where ``sides`` differ among them, only pairs across count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    run = np.concatenate([[0], np.cumsum(np.diff(every[order]) != 0)]) if len(every) else np.zeros(0, np.int64)
    start = np.searchsorted(run, np.arange(run[-1] + 2)) if len(run) else np.zeros(1, np.int64)
    of, holders = np.empty(len(every), np.int64), owner[order]
    of[order] = run
    ends = np.cumsum(sizes)
    across = len(np.unique(sides)) > 1
    for i in range(n):
        runs = of[ends[i] - sizes[i] : ends[i]]
        count = start[runs + 1] - start[runs]
        runs, count = runs[count > 1], count[count > 1]
        if not len(runs):
            continue
        places = np.arange(count.sum()) + np.repeat(start[runs] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        shared = np.bincount(holders[places], minlength=n)
        # in whole numbers of a millionth, so that no rounding decides
        ok = shared * 1_000_000 >= round(similarity * 1_000_000) * (sizes + sizes[i] - shared)
        ok[i] = False
        if across:
            ok &= sides != sides[i]
        j = np.flatnonzero(ok & (shared > 0))
        if allowed is not None and len(j):
            j = j[allowed(i, j)]
        if len(j):
            yield i, j, shared[j] / (sizes[j] + sizes[i] - shared[j])


def _verifier(similarity: float, words: int, depth: int, before: int):
    """``depth``: of the prefixes matched now; ``before``: that of those matched already, whose pairs are settled (over DEEPEST: none)."""

    def unit(rows: list[tuple]) -> tuple[list[tuple], np.ndarray]:
        """rows: kind, key, sub, lo, hi, side, d, h, copies, labels, text."""
        kind, key, sub = rows[0][:3]
        members = list({(r[6], r[7]): r for r in rows}.values())  # a repeated row is the same member
        pairs = np.zeros(BUCKETS + 1, np.int64)
        sides = np.array([r[5] for r in members])
        if len(members) < 2 or rows[0][3] != rows[0][4] and len(np.unique(sides)) < 2:
            return [], pairs
        sets = [shingles(r[10], words) for r in members]
        copies = np.array([r[8] for r in members], np.int64)
        labels = np.stack([unpacked(r[9]) for r in members])

        def allowed(i: int, j: np.ndarray) -> np.ndarray:
            same = labels[j] == labels[i]
            met = same[:, :, :depth].all(2)
            new = met.any(1) if kind == 0 else met.argmax(1) == sub  # in nodes, a pair counts in the first tree in which it shares one
            return new if before > DEEPEST else new & ~same[:, :, :before].all(2).any(1)

        parent, linked = list(range(len(members))), np.zeros(len(members), np.int64)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j, alike in verify(sets, sides, similarity, allowed):
            linked[i] = copies[j].sum()
            pairs += np.bincount((alike[j > i] * BUCKETS).astype(np.int64), minlength=BUCKETS + 1)
            for x in j.tolist():
                a, b = root(i), root(x)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        return [(r[6], r[7], int(n), *members[root(i)][6:8]) for i, (r, n) in enumerate(zip(members, linked, strict=True)) if n], pairs

    names = ["kind", "key", "sub", "lo", "hi", "side", "d", "h", "copies", "labels", "text"]
    types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen = np.zeros(BUCKETS + 1, np.int64)

        def table(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in LINKS.split(", ")])

        def settle(rows: list[tuple]) -> list[tuple]:
            links, pairs = unit(rows)
            seen[:] += pairs
            return [(*x, None, None) for x in links]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and held[0][:5] != row[:5]:
                    out += settle(held)
                    held = []
                held.append(row)
            yield from table(out)
        if held:
            yield from table(settle(held))
        yield from table([(None,) * 5 + (int(b), int(seen[b])) for b in np.flatnonzero(seen)])

    return run


def names_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """The document's number (its doc_id, or a negative number made of its text) and its text's hash."""
    h = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 62)) - F.pmod(h, F.lit(1 << 61))), h


def _prefix(depth: int) -> list[Column]:
    """The columns that tell a node of ``depth`` in its tree."""
    if depth > DEEPEST // 2:
        return [F.col("hi"), F.shiftright("lo", 16 * (DEEPEST - depth))]
    return [F.shiftright("hi", 16 * (DEEPEST // 2 - depth))]


def forest(classes: DataFrame, floor: int, folder: str) -> DataFrame:
    """The sorted tries of ``classes`` (d, h, labels) as a written table TRIE of the labels that match another one down to the floor."""
    spread = classes.select("d", "h", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("labels") - 2, F.lit(2)), lambda i: F.struct(F.get("labels", i).alias("hi"), F.get("labels", i + 1).alias("lo")))).alias("tree", "label"))
    spread = spread.select("tree", "label.hi", "label.lo", "d", "h")
    order = ["tree", "hi", "lo", "d", "h"]
    trie = spread.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)
    return materialize(trie.mapInArrow(_matcher(floor), TRIE), f"{folder}/trie")


def _match(trie: DataFrame, sizes: DataFrame, texts: DataFrame, depth: int, before: int, similarity: float, words: int, folder: str) -> DataFrame | None:
    """The links of the pairs that match at ``depth`` and did not ``before``, as a written table LINKS; None without candidates."""
    one = F.struct("d", "h")  # a doc_id alone may name several texts
    spread = trie.filter(F.col("matched") >= depth).select("d", "h", "tree", F.xxhash64("tree", *_prefix(depth)).alias("node"), (F.xxhash64("tree", *_prefix(before)) if before <= DEEPEST else F.xxhash64("d", "h")).alias("child"))
    nodes = spread.groupBy("node").agg(F.count("*").alias("k"), F.min(one).alias("m"), F.min("child").alias("low"), F.max("child").alias("high"))
    nodes = materialize(nodes.filter("k > 1 and low <> high").select("node", "k", F.col("k").alias("size"), "m"), f"{folder}/nodes")
    if nodes.isEmpty():
        return None
    met = materialize(join_unique(spread.drop("child"), nodes, "node", "k", F.col("d")).filter("m is not null"), f"{folder}/met")
    parts = materialize(connected_components(met.select(F.col("m").alias("src"), one.alias("dst")).distinct(), in_one_task=SMALL_GRAPH), f"{folder}/parts")

    sized = materialize(sizes.join(parts.select("node.d", "node.h", "component"), ["d", "h"]), f"{folder}/sized")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    whole = sized.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("weight"))
    whole = whole.select("component", "rows", F.when((F.col("rows") <= WHOLE_ROWS) & (F.col("weight") <= BLOCK_SHINGLES), 1).otherwise(blocks).alias("b"), (F.col("weight") / F.col("rows")).alias("mean"))
    whole = materialize(whole, f"{folder}/whole")
    # of a large component, either every pair of blocks or, for each node, every pair of the node's blocks
    of_node = F.greatest(F.ceil(F.col("size") / BLOCK_ROWS), F.ceil(F.col("size") * F.col("mean") / BLOCK_SHINGLES)).cast("int")
    placed = materialize(join_unique(sized, whole, "component", "rows", F.col("d")), f"{folder}/placed")
    per_node = met.join(placed.filter("b > 1").select("d", "h", "component", "mean"), ["d", "h"]).select("component", of_node.alias("nb"))
    by_nodes = per_node.groupBy("component").agg(F.sum("nb").alias("cost"))
    mode = whole.join(by_nodes, "component", "left").select("component", F.col("rows").alias("k"), (F.coalesce("cost", F.col("rows") * F.col("b")) < F.col("rows") * F.col("b")).alias("by_node"))
    chosen = materialize(join_unique(placed, materialize(mode, f"{folder}/mode"), "component", "k", F.col("d")), f"{folder}/chosen")
    of_part = chosen.filter("not by_node").select("d", "h", F.lit(0).alias("kind"), F.col("component.d").alias("key"), F.col("component.h").alias("sub"), "b")
    picked = chosen.filter("by_node").select("d", "h", "mean")
    of_nodes = met.join(picked, ["d", "h"]).select("d", "h", F.lit(1).alias("kind"), F.col("node").alias("key"), F.col("tree").cast("long").alias("sub"), F.greatest(F.lit(1), of_node).alias("b"))
    asked = of_part.unionByName(of_nodes).groupBy("d", "h").agg(F.collect_list(F.struct("kind", "key", "sub", "b")).alias("units"))  # a unit per tree at most
    asked = materialize(asked, f"{folder}/asked")

    read = texts.join(asked, ["d", "h"]).select("d", "h", "copies", "labels", "text", F.explode("units").alias("u")).select("d", "h", "copies", "labels", "text", "u.kind", "u.key", "u.sub", "u.b")
    side = F.pmod(F.xxhash64("d", "h"), F.col("b")).cast("int")
    read = read.select("*", side.alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("other"))
    read = read.select("kind", "key", "sub", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "d", "h", "copies", "labels", "text")
    unit = ["kind", "key", "sub", "lo", "hi"]
    ranged = read.repartitionByRange(partitions(read.sparkSession), *unit).sortWithinPartitions(*unit)
    links = materialize(ranged.mapInArrow(_verifier(similarity, words, depth, before), LINKS), f"{folder}/links")
    discard(read.sparkSession, folder, "nodes", "met", "parts", "sized", "whole", "placed", "mode", "chosen", "asked")
    return links


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, trees: int = TREES, target: float = TARGET) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as doc_id, d, h, rep_id (least d with an equal set), class_id and class_h (the document of the least d, then h, reachable over links) and n_links (rows it is similar to)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder, floor = work_dir(spark, "ngrams"), prefix_depth(similarity, trees, DEEPEST, target)
    d, h = names_of(docs)
    named = docs.select(d.alias("d"), h.alias("h"), "text")
    one = F.struct("d", "h")
    sketches = materialize(named.mapInArrow(_sketcher(words, trees), SKETCH), f"{folder}/sketches")
    classes = sketches.filter("n > 0").groupBy("set_hash").agg(F.min(one).alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    classes = materialize(classes.select("set_hash", "rep.d", "rep.h", "copies", "n", "labels"), f"{folder}/classes")
    trie = forest(classes, floor, folder)
    members = trie.select("d", "h").distinct()
    sizes = materialize(classes.join(members, ["d", "h"]).select("d", "h", "n", "copies", "labels"), f"{folder}/sizes")
    # once for all depths; a repeated row is the same text, and goes before the shuffle
    texts = materialize(named.dropDuplicates(["d", "h"]).join(sizes.select("d", "h", "copies", "labels"), ["d", "h"]), f"{folder}/texts")

    found, pairs, depth, before = spark.createDataFrame([], LINKS), {}, DEEPEST, DEEPEST + 1
    while True:
        links = _match(trie, sizes.select("d", "h", "n"), texts, depth, before, similarity, words, f"{folder}/depth{depth}")
        if links is not None:
            found = found.unionByName(links.filter("bucket is null"))
            for r in links.filter("bucket is not null").groupBy("bucket").agg(F.sum("pairs").alias("n")).collect():  # a row per bucket
                pairs[r["bucket"]] = pairs.get(r["bucket"], 0) + r["n"]
        shorter = next_depth(pairs, depth, similarity, trees, target, floor)
        if shorter >= depth:
            break
        depth, before = shorter, depth

    discard(spark, folder, "trie", "texts", "sizes")
    linked = found.groupBy("d", "h").agg(F.sum("linked").alias("linked"))
    joined = materialize(connected_components(found.select(F.struct(F.col("root").alias("d"), F.col("root_h").alias("h")).alias("src"), one.alias("dst")).distinct(), in_one_task=SMALL_GRAPH), f"{folder}/joined")
    final = classes.select("set_hash", "d", "h", "copies").join(linked, ["d", "h"], "left").join(joined.select("node.d", "node.h", "component"), ["d", "h"], "left")
    final = final.select("set_hash", F.col("copies").alias("k"), F.col("d").alias("rep_id"), F.coalesce("component.d", "d").alias("class_id"), F.coalesce("component.h", "h").alias("class_h"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    final = materialize(final, f"{folder}/final")
    discard(spark, folder, "classes", "joined")
    ids = sketches.select("d", "h", F.when(F.col("d") > -(1 << 61), F.col("d")).alias("doc_id"), F.when(F.col("n") > 0, F.col("set_hash")).alias("set_hash"))
    out = join_unique(ids, final, "set_hash", "k", F.col("d"))
    own = [F.coalesce(a, b).alias(a) for a, b in (("rep_id", "d"), ("class_id", "d"), ("class_h", "h"))]
    return out.select("doc_id", "d", "h", *own, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the document of the least doc_id (then text hash) of every class, once."""
    classes = similar_classes(docs, **options)
    kept = materialize(classes.filter("d = class_id and h = class_h").select(F.col("d").alias("_d"), F.col("h").alias("_h")).distinct(), work_dir(docs.sparkSession, "kept"))
    rows, inner = shielded(docs)
    d, h = names_of(rows, inner["doc_id"], inner["text"])
    return rows.withColumns({"_d": d, "_h": h}).dropDuplicates(["_d", "_h"]).join(kept, ["_d", "_h"], "left_semi").select(*[F.col(i).alias(c) for c, i in inner.items()])

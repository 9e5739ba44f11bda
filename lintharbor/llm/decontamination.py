"""Benchmark decontamination through a positional inverted index, in DataFrame functions only.

The words of a text are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z. The index stores a posting (term, k, pos) of every
word of every document, or of those that a given vocabulary holds; k names the document. Texts are tokenised once, for the index.

A window is ten consecutive item words. Its terms are ordered by how often they occur in the corpus. The postings of its rarest term, moved back by the
term's place in the window, are its first candidates; they are intersected with the likewise moved postings of the second rarest term, and what is left with
those of all others. What stands in every list is an exact phrase match. In the same way, but with a tolerance instead of the offset, come proximity matches: all of a window's
terms near its rarest one, in any order.

Windows are broadcast where their counted number is bounded; else both sides are shuffled by term, the postings dealt out by a salt. Only postings of the terms
that a step needs are read, and of the last step only those of documents that have candidates left.

Cases: null and empty texts have no words; an item of one to nine words is one window; items without words or item_id give
no window; repeated items and rows count once per item_id; documents are told apart by (doc_id, text), so that rows that
share a doc_id don't mix, and a null doc_id is a key like any other; either table may be empty; further columns are ignored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, discard, join_unique, materialize, shielded, work_dir

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
#: Words that a proximity match may hold besides those of the window.
SLOP = 5
#: Rows up to which terms or documents (8 bytes each) and windows (a dozen terms each) are broadcast; beyond, they are shuffled.
BROADCAST_KEYS, BROADCAST_WINDOWS = 500_000, 50_000
#: Parts that the postings of a term are dealt out to where windows aren't broadcast.
SALT = 16
#: The term of the posting that ends each document, at the place after its last word: the hash of no word, which is the hash's seed.
END = 42


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The number of a document: a hash of its doc_id, whether that is null, and its text."""
    return F.xxhash64(F.col(doc_id).isNull(), doc_id, F.coalesce(F.col(text), F.lit("")))


def _only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among the distinct ``keys``, a written table: by broadcast where its counted rows are bounded, else by a shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_semi")


def build_index(docs: DataFrame, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """The postings (term, k, pos) of ``docs`` (doc_id, text), written to ``path``; of the terms of ``vocabulary`` (term) where one is given. Every document ends in a posting of END."""
    words = F.concat(words_of(F.col("text")), F.array(F.lit(None).cast("string")))
    said = docs.select(document_key().alias("k"), F.posexplode(words).alias("pos", "w")).select(F.xxhash64("w").alias("term"), "k", "pos")
    if vocabulary is not None:
        said = _only(said, vocabulary.select("term").union(vocabulary.sparkSession.range(1).select(F.lit(END).cast("long"))).distinct(), "term")
    return materialize(said, path)


def windows_of(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """A row per distinct item text and window: w (its number), item_id, need and terms."""
    said = items.filter("item_id is not null").select("item_id", F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)).alias("words")).filter(F.size("words") > 0).distinct()
    need = F.least(F.size("words"), F.lit(window))
    cut = said.select("item_id", "words", need.alias("need"), F.explode(F.sequence(F.lit(0), F.size("words") - need)).alias("start"))
    return cut.select("item_id", "need", F.slice("words", F.col("start") + 1, F.col("need")).alias("terms")).distinct().withColumn("w", F.xxhash64("item_id", "terms"))


def by_rarity(windows: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """``windows`` with ``order``: structs (n, at, term) from the rarest term, n being its postings. Windows with a term that no document has are left out."""
    placed = windows.select("w", "item_id", "need", F.posexplode("terms").alias("at", "term"))
    terms = materialize(placed.select("term").distinct(), f"{folder}/terms")
    counts = materialize(_only(index.select("term"), terms, "term").groupBy("term").agg(F.count("*").alias("n")), f"{folder}/counts")
    ordered = placed.join(counts, "term").groupBy("w", "item_id", "need").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("order"))
    return materialize(ordered.filter(F.size("order") == F.col("need")), f"{folder}/windows")


def rarest_postings(index: DataFrame, first: DataFrame, windows: int, path: str) -> DataFrame:
    """A row for each posting of ``first`` (term, ...), a row per window with its rarest term: its columns but the term, k and pos."""
    if windows <= BROADCAST_WINDOWS:
        return index.join(F.broadcast(first), "term").drop("term")
    index = _only(index, materialize(first.select("term").distinct(), path), "term")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")
    return index.withColumn("_salt", F.pmod(F.xxhash64("k"), F.lit(SALT)).cast("int")).join(first.select("*", salt), ["term", "_salt"]).drop("term", "_salt")


def _with_windows(rows: DataFrame, ordered: DataFrame, windows: int) -> DataFrame:
    return rows.join(F.broadcast(ordered) if windows <= BROADCAST_WINDOWS else ordered, "w")


def _terms(ordered: DataFrame, from_: int, to: int, path: str) -> DataFrame:
    return materialize(ordered.select(F.explode(F.slice("order", from_, to)).alias("o")).select("o.term").distinct(), path)


def _phrases(index: DataFrame, ordered: DataFrame, folder: str) -> DataFrame:
    """Exact matches of windows: k, item_id, first, last (word positions)."""
    windows, o = ordered.count(), F.col("order")
    first = ordered.select("w", "need", o[0]["term"].alias("term"), o[0]["at"].alias("at"), F.get(o, F.lit(1))["term"].alias("term2"), F.get(o, F.lit(1))["at"].alias("at2"))
    begun = rarest_postings(index, first, windows, f"{folder}/rarest").select("w", "need", "term2", "at2", "k", (F.col("pos") - F.col("at")).alias("s")).filter("s >= 0")
    second = _only(index, _terms(ordered, 2, 1, f"{folder}/second"), "term")
    asked = begun.filter("need > 1").select("w", "need", "k", "s", F.col("term2").alias("term"), (F.col("s") + F.col("at2")).alias("pos"))
    left = materialize(asked.join(second, ["k", "pos", "term"]).select("k", "w", "need", "s").distinct(), f"{folder}/second_left")
    rest = _with_windows(left.filter("need > 2"), ordered.select("w", "order"), windows).select("k", "w", "need", "s", F.explode(F.slice("order", 3, 1 << 20)).alias("o"))
    asked = rest.select("k", "w", "need", "s", "o.term", (F.col("s") + F.col("o.at")).alias("pos"))
    others = _only(_only(index, _terms(ordered, 3, 1 << 20, f"{folder}/others"), "term"), materialize(left.select("k").distinct(), f"{folder}/documents"), "k")
    met = asked.join(others.distinct(), ["k", "pos", "term"]).groupBy("k", "w", "need", "s").agg(F.count("*").alias("n"))  # distinct: a repeated row's postings are there twice
    found = [x.select("k", "w", "s") for x in (begun.filter("need = 1"), left.filter("need = 2"), met.filter("n = need - 2"))]
    found = _with_windows(reduce(DataFrame.unionByName, found), ordered.select("w", "item_id", "need"), windows)
    return found.select("k", "item_id", F.col("s").alias("first"), (F.col("s") + F.col("need") - 1).alias("last")).distinct()


def _near(index: DataFrame, ordered: DataFrame, slop: int, folder: str) -> DataFrame:
    """Proximity matches of windows: k, item_id, w, pos (of the rarest term)."""
    reach = F.col("need") - 1 + slop

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of left (k, term, pos, need, ...) with a posting of right no further off than ``reach``."""
        size = WINDOW_WORDS + slop
        bin_ = lambda x: F.floor(x / F.lit(size)).cast("int")
        spread = left.select("*", F.explode(F.sequence(bin_(F.greatest(F.col("pos") - reach, F.lit(0))), bin_(F.col("pos") + reach))).alias("bin"))
        return spread.join(right.select("k", "term", bin_(F.col("pos")).alias("bin"), F.col("pos").alias("there")), ["k", "term", "bin"]).filter(F.abs(F.col("pos") - F.col("there")) <= reach).drop("there", "bin")

    windows, terms = ordered.count(), F.array_distinct(F.transform("order", lambda o: o["term"]))
    listed = ordered.select("w", "item_id", "need", terms.alias("terms"))
    first = listed.select("w", "need", F.size("terms").alias("n"), F.col("terms")[0].alias("term"), F.get("terms", F.lit(1)).alias("term2"))
    begun = rarest_postings(index, first, windows, f"{folder}/near_rarest")
    seconds = materialize(listed.select(F.get("terms", F.lit(1)).alias("term")).filter("term is not null").distinct(), f"{folder}/near_second")
    asked = begun.filter("n > 1").withColumnRenamed("term2", "term")
    left = materialize(beside(asked, _only(index, seconds, "term")).select("k", "w", "need", "n", "pos").distinct(), f"{folder}/near_left")
    rest = _with_windows(left.filter("n > 2"), listed.select("w", "terms"), windows)
    asked = rest.select("k", "w", "need", "n", "pos", F.explode(F.slice("terms", 3, 1 << 20)).alias("term"))
    others = _only(_only(index, _terms(ordered, 2, 1 << 20, f"{folder}/near_others"), "term"), materialize(left.select("k").distinct(), f"{folder}/near_documents"), "k")
    met = beside(asked, others).groupBy("k", "w", "pos", "n").agg(F.countDistinct("term").alias("m"))
    found = [x.select("k", "w", "pos") for x in (begun.filter("n = 1"), left.filter("n = 2"), met.filter("m = n - 2"))]
    return _with_windows(reduce(DataFrame.unionByName, found), listed.select("w", "item_id"), windows).select("k", "item_id", "w", "pos").distinct()


def _prepared(docs: DataFrame, items: DataFrame, window: int, folder: str, index: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The index, built for the items' vocabulary unless one is given, and the windows by rarity."""
    windows = materialize(windows_of(items, window), f"{folder}/items")
    if index is None:
        index = build_index(docs, f"{folder}/postings", windows.select(F.explode("terms").alias("term")).distinct())
    return index, by_rarity(windows, index, folder)


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, folder: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Exact matches of the items' windows: doc_id, k, item_id, first, last (word positions). ``index``: of the same documents, for this or any other benchmark."""
    folder = folder or work_dir(docs.sparkSession, "decontamination")
    found = materialize(_phrases(*_prepared(docs, items, window, folder, index), folder), f"{folder}/phrases")
    return docs.select("doc_id", document_key().alias("k")).distinct().join(found, "k").select("doc_id", "k", "item_id", "first", "last")


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, slop: int = SLOP, folder: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Places where all terms of an item's window stand within ``window - 1 + slop`` words of its rarest one, in any order: doc_id, k, item_id, pos (of the rarest)."""
    folder = folder or work_dir(docs.sparkSession, "proximity")
    found = materialize(_near(*_prepared(docs, items, window, folder, index), slop, folder), f"{folder}/near")
    return docs.select("doc_id", document_key().alias("k")).distinct().join(found, "k").select("doc_id", "k", "item_id", "pos").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, index: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` as doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near, the number of items with a proximity match."""
    folder = work_dir(docs.sparkSession, "decontamination")
    index, ordered = _prepared(docs, items, window, folder, index)
    hits = materialize(_phrases(index, ordered, folder), f"{folder}/hits")
    before = Window.partitionBy("k").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(F.max("last").over(before), F.lit(-1))))
    covered = hits.select("k", "first", "last").distinct().select("k", fresh.alias("fresh")).groupBy("k").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = hits.select("k", F.col("item_id").cast("string").alias("item")).distinct().groupBy("k").agg(F.array_sort(F.collect_list("item")).alias("items"))
    named = named.select("k", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    near = _near(index, ordered, SLOP, folder).select("k", "item_id").distinct().groupBy("k").agg(F.count("*").alias("n_near"))
    sizes = index.filter(F.col("term") == END).groupBy("k").agg(F.max("pos").cast("long").alias("n_words"), F.count("*").alias("n"))  # n: the rows of a repeated document
    marks = materialize(reduce(lambda a, b: a.join(b, "k", "left"), [sizes, covered, named, near]), f"{folder}/marks")
    discard(docs.sparkSession, folder, "postings", "hits", "second_left", "near_left")
    zero = F.lit(0).cast("long")
    own = join_unique(docs.select("doc_id", document_key().alias("k")), marks, "k", "n", F.monotonically_increasing_id())
    return own.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with all their columns."""
    folder = work_dir(docs.sparkSession, "decontamination")
    bad = materialize(_phrases(*_prepared(docs, items, window, folder, None), folder).select("k").distinct(), f"{folder}/bad")
    discard(docs.sparkSession, folder, "postings", "second_left")
    rows, inner = shielded(docs)
    return rows.withColumn("_k", document_key(inner["doc_id"], inner["text"])).join(bad.withColumnRenamed("k", "_k"), "_k", "left_anti").select(*[F.col(i).alias(c) for c, i in inner.items()])

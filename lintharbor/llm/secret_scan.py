"""Secret scanning with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger has a row per (blob, rule version) with the
spans found, in a folder for each rule version, which is a digest of the rules; a scan looks only at blobs that the ledger lacks for the present version, appends them, and joins the
findings back to every path (here: document) that holds the blob. Spans count code points, the end is exclusive.

Texts don't leave their partition: the unseen blobs are broadcast where their counted number is bounded, else the seen ones among the asked, and only if
both are many are texts joined by a shuffle. A task scans a blob that it meets again only if it has forgotten it.

Cases: null and empty texts are one empty blob without findings; copies share their blob's findings; texts are scanned whole; an empty table scans nothing; further columns are kept by
``redact`` and ignored elsewhere. An append that is repeated after a failure adds equal rows, which the reader drops."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, discard, join_unique, materialize, shielded, work_dir

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A digest of the rules: findings of others aren't taken for theirs.
RULE_VERSION = hashlib.sha256("\n".join([*KINDS, ASSIGN.pattern, "12", ACCESS.pattern, HEX.pattern]).encode()).hexdigest()[:16]
#: Blobs (32 bytes each) that are broadcast at most, and that a task remembers.
BROADCAST_BLOBS, REMEMBERED = 250_000, 100_000
FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans as disjoint ranges."""
    out: list[list[int]] = []
    for _, start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[bytes] = set()
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if blob in done:
                continue
            if len(done) >= REMEMBERED:
                done.clear()
            done.add(blob)
            spans = find(text)
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            rows.append((blob, *(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined))
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FINDINGS.split(", ")])


def _blob(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """The table of (blob, rule version) findings in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.schema = f"{FINDINGS}, rule_version string"

    def read(self, version: str) -> DataFrame:
        """The rows of a version, of which only its folder is read; a row may be there twice."""
        if not self._exists():
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(self.schema).parquet(self.folder).filter(F.col("rule_version") == version).drop("rule_version")

    def append(self, found: DataFrame, version: str) -> None:
        found.withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(self.folder)

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)


def _unseen_texts(docs: DataFrame, asked: DataFrame, unseen: DataFrame) -> DataFrame:
    """(blob, text) of the rows whose blob is in ``unseen``; asked and unseen: written tables (blob, ...)."""
    texts = docs.select(_blob().alias("blob"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    many, total = unseen.count(), asked.count()
    if not many:
        return texts.limit(0).select("blob", "text")
    if many <= BROADCAST_BLOBS and many < total:
        return texts.join(F.broadcast(unseen.select("blob")), "blob", "left_semi").select("blob", "text")
    if many == total:
        return texts.select("blob", "text")
    if total - many <= BROADCAST_BLOBS:
        return texts.join(F.broadcast(asked.select("blob").subtract(unseen.select("blob"))), "blob", "left_anti").select("blob", "text")
    # (blob, first holder) tells one row, so that the copies of a hot blob are dealt out, not gathered
    return texts.join(unseen, ["blob", "d"], "left_semi").select("blob", "text")


def scan(docs: DataFrame, ledger: Ledger | None = None, version: str = RULE_VERSION) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) as doc_id, blob, n_assign, n_access, n_hex, base_sha256, spans; unseen blobs go to the ledger."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = work_dir(spark, "secrets")
    ledger = ledger or Ledger(spark, f"{folder}/ledger")
    paths = materialize(docs.select("doc_id", _blob().alias("blob")), f"{folder}/paths")
    holders = paths.groupBy("blob").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))).alias("first"), F.count("*").alias("n"))
    holders = materialize(holders.select("blob", F.col("first.d").alias("d"), "n"), f"{folder}/holders")
    unseen = materialize(holders.join(ledger.read(version).select("blob"), "blob", "left_anti").select("blob", "d"), f"{folder}/unseen")
    found = _unseen_texts(docs, holders, unseen).mapInArrow(_scan, FINDINGS)
    ledger.append(found.dropDuplicates(["blob"]), version)
    known = ledger.read(version).join(holders.select("blob", "n"), "blob").dropDuplicates(["blob"])
    known = materialize(known, f"{folder}/known")
    discard(spark, folder, "holders", "unseen")
    return join_unique(paths.select("doc_id", "blob"), known, "blob", "n", F.col("doc_id"))


def _without(text: str, spans: str, mark: str) -> str:
    out, at = [], 0
    for a, b in merged([(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(","))]):
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ledger: Ledger | None = None, version: str = RULE_VERSION, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret of its texts replaced by ``mark``, and n_chars, where there is one, counted anew for these."""
    spark = docs.sparkSession
    folder = work_dir(spark, "redaction")
    hits = scan(docs, ledger, version).filter("spans <> ''").select("blob", "spans").groupBy("blob").agg(F.first("spans").alias("spans"), F.count("*").alias("n"))
    hits = materialize(hits, f"{folder}/hits")
    rows, inner = shielded(docs)
    text = inner["text"]
    rows = join_unique(rows.withColumn("_blob", _blob(text)), hits.toDF("_blob", "_spans", "n"), "_blob", "n", F.xxhash64(inner["doc_id"], text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("_spans").to_pylist()
            if any(spans):
                texts = [_without(t, x, mark) if x else t for t, x in zip(batch.column(text).to_pylist(), spans, strict=True)]
                at = batch.schema.get_field_index(text)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    schema = rows.schema
    for field in schema:
        field.nullable = True
    out = rows.mapInArrow(cut, schema)
    if "n_chars" in inner:
        out = out.withColumn(inner["n_chars"], F.when(F.col("_spans").isNull(), F.col(inner["n_chars"])).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    return out.select(*[F.col(i).alias(c) for c, i in inner.items()])

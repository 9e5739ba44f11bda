"""Token counts of whole texts: batches balanced by bytes, long texts split where no token can reach across.

Cases: null and empty texts have no token; texts of any length are cut before white space between words into pieces of bounded size;
rows are never merged, so repeated rows are counted each; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

#: Characters of a piece, and UTF-8 bytes of a batch, beyond which it is closed.
PIECE_CHARS, BATCH_BYTES = 32_768, 1 << 18
#: A cut keeps both sides' tokens at one space between a printed character and a letter or digit: the pre-tokenizer drops that
#: space, no composition or case rule reaches over it, and no special string contains it.
SAFE = re.compile(r"(?<=\S) (?=[^\W_])")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores are Spark's to share out
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """``text`` in pieces of about ``most`` characters, cut at safe boundaries only; a stretch without one stays whole."""
    if len(text) <= most:
        return [text]
    out, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def lengths(texts: list[str | None], tokenizer, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """The number of tokens of each text."""
    counts, batch, owners, size = [0] * len(texts), [], [], 0

    def flush() -> None:
        for i, e in zip(owners, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
            counts[i] += len(e)

    for i, text in enumerate(texts):
        for piece in pieces(text) if text else ():
            batch.append(piece)
            owners.append(i)
            size += len(piece.encode("utf-8", "surrogatepass"))
            if size >= batch_bytes:
                flush()
                batch, owners, size = [], [], 0
    if batch:
        flush()
    return counts


def count_tokens(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Each row of ``docs`` as doc_id, n_bytes, n_tokens, over_limit."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array(lengths(batch.column("text").to_pylist(), load(path)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), n], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

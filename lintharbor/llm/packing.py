"""Order-preserving packing of documents into sequences by dynamic programming.

The token stream of a partition, in its own order, is cut into windows of at most ``length`` tokens. Cuts stand at the ends of
documents and sentences; only a stretch without either that is longer than an eighth of a window gets cut points within, which cost as much
as 64 tokens of padding. The cost of a window is its padding, plus the penalty of the cut that ends it (a truncated document's). As the padding of (i, j] is ``length`` - (j - i), the best
predecessor of j is the least cost[i] + i among the last ``length`` tokens, which a monotone queue keeps at its head. A window whose length
is a power of two isn't padded, so the few cuts that stand so far before j are tried beside it, at the fixed price of a further sequence.
Long partitions are cut in blocks; the last windows of a block are opened again with the next one, so that no padding arises
between blocks. What remains at the end of a partition goes to windows whose lengths are powers of two, wherever these end.

Cases: null and empty texts are one end token; repeated rows are packed each; very long texts are encoded in pieces, cut where no token reaches across,
and their tokens (4 bytes each, all of which must be counted before the first piece can be told) stream through block by block;
a null doc_id stays null; an empty table gives no row; further columns are ignored."""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Tokens: a window; a block of the stream; the distance of cut points in a long stretch that offers none; as a share of a window, how long such a stretch is.
LENGTH, BLOCK, GRID, STRETCH = 1024, 1 << 18, 16, 8
#: Penalties in tokens of padding, for a cut at the end of a sentence and for one within; the end of a document costs nothing.
SENTENCE, INSIDE = 1, 64
#: The shortest unpadded window that the programme chooses, and what an unpadded window costs.
LEAST_POWER, SEQUENCE = 16, 4
END_ID = 0
#: Pieces of a batch of results.
ROWS = 8192
#: Characters beyond which a text is encoded in pieces, and where these may be cut.
PIECE_CHARS, BEFORE = 65_536, re.compile(r"(?<=\S) (?=\S)")
#: Characters on which both tokenizer libraries agree by construction: ASCII and Latin letters, and general punctuation.
PLAIN = re.compile("[^\t\n\r -~¡-ɏ‐-‧]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the tokenizers library gives them. Plain texts go through the same merges in tiktoken, several times as fast."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", ())]
        #: Texts may be encoded in pieces if no special string can hold or take in a space.
        self.divisible = not spec.get("normalizer") and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ()))
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 2 + len(self.special), bool)
        self.ends[[i for s, i in vocabulary.items() if s and (s[-1] == "Ċ" or s.rstrip("\"')]»”’")[-1:] in tuple(".!?"))]] = True
        self.fast = None
        kind = spec.get("pre_tokenizer") or {}
        self.divisible &= kind.get("type") == "ByteLevel" and bool(kind.get("use_regex")) and not kind.get("add_prefix_space")
        if kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec.get("normalizer"):
            import public_tokenizers
            import tiktoken

            printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
            others = [b for b in range(256) if b not in printed]
            byte_of = {chr(b): b for b in printed} | {chr(256 + n): b for n, b in enumerate(others)}
            ranks = {bytes(byte_of[c] for c in s): i for s, i in vocabulary.items() if s not in self.special}
            self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) > PIECE_CHARS and self.divisible:
            return np.concatenate([self._encode(x) for x in pieces(text)])
        return self._encode(text)

    def _encode(self, text: str) -> np.ndarray:
        if self.fast is not None and not PLAIN.search(text) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32)


def pieces(text: str, most: int | None = None) -> list[str]:
    """``text`` in pieces of about ``most`` characters, cut before a single space between printed characters, which begins a token; a stretch without one stays whole."""
    most, out, start = most or PIECE_CHARS, [], 0
    while len(text) - start > most:
        cut = BEFORE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def best_cuts(points: list[int], penalties: list[int], length: int, powers: tuple[int, ...] = (), price: int = SEQUENCE) -> list[int]:
    """The cut points, the last of ``points`` among them, of least total cost. points: ascending, from 0, no gap over ``length``.

    ``powers``: lengths of windows that aren't padded and cost ``price`` instead."""
    costs, back, queue = [0] * len(points), [0] * len(points), deque([0])
    keys = [0] * len(points)  # cost + position
    place = {p: i for i, p in enumerate(points)} if powers else {}
    for j in range(1, len(points)):
        at = points[j]
        while points[queue[0]] < at - length:
            queue.popleft()
        i = queue[0]
        cost = keys[i] + length - at
        for n in powers:
            k = place.get(at - n)
            if k is not None and costs[k] + price < cost:
                cost, i = costs[k] + price, k
        back[j], costs[j] = i, cost + penalties[j]
        keys[j] = key = costs[j] + at
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    out, j = [], len(points) - 1
    while j:
        out.append(points[j])
        j = back[j]
    return out[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Where the stream may be cut, and what each cut costs; no two points are further apart than ``length``."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int64)
    cost[1:][sentence[ids]] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    if cost[n] < 0:  # the block's end; it is opened again
        cost[n] = INSIDE
    points = np.flatnonzero(cost >= 0)
    gaps, most = np.diff(points), max(1, length // STRETCH)
    grid = min(GRID, most)
    steps = np.where(gaps > most, (gaps - 1) // grid, 0)
    within = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1
    cost[np.repeat(points[:-1], steps) + within * grid] = INSIDE
    points = np.flatnonzero(cost >= 0)
    return points.tolist(), cost[points].tolist()


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Cuts a stream of documents into windows and gives the pieces of each."""

    def __init__(self, sentence: np.ndarray, first_id: int, length: int = LENGTH, block: int = BLOCK):
        self.sentence, self.next_id, self.length, self.block = sentence, first_id, length, max(block, 8 * length)
        self.ids: list[np.ndarray] = []
        self.spans: list[tuple] = []  # doc_id, tokens of the document, place of its first held token in it, tokens held, ends here
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(ids), self.block):
            part = ids[at : at + self.block]
            self.ids.append(part)
            self.spans.append((doc_id, len(ids), at, len(part), at + len(part) == len(ids)))
            self.held += len(part)
            if self.held >= self.block:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        stream = np.concatenate(self.ids)
        starts = np.cumsum([0, *(s[3] for s in self.spans)])
        ends = starts[1:][[s[4] for s in self.spans]]
        unpadded = tuple(1 << b for b in range(self.length.bit_length()) if LEAST_POWER <= 1 << b < self.length)
        cuts = best_cuts(*cut_points(stream, ends, self.sentence, self.length), self.length, unpadded)
        if last:
            rest = cuts.pop() - (base := cuts[-1] if cuts else 0)
            for n in powers_of_two(rest) if rest != self.length else [rest]:
                cuts.append(base := base + n)
        else:
            cuts = cuts[: max(1, len(cuts) - 3)]
        windows = np.array([0, *cuts])
        edges = np.union1d(windows, starts[starts < windows[-1]])
        of, within = np.searchsorted(starts, edges[:-1], "right") - 1, np.searchsorted(windows, edges[:-1], "right") - 1
        data = stream.astype("<u4", copy=False)
        for a, b, s, w in zip(edges[:-1].tolist(), edges[1:].tolist(), of.tolist(), within.tolist(), strict=True):
            doc_id, tokens, first, _, _ = self.spans[s]
            yield doc_id, first + a - int(starts[s]), b - a, zlib.crc32(data[a:b].data), tokens, self.next_id + w, a - int(windows[w])
        self.next_id += len(cuts)
        done = int(windows[-1])
        self.ids = [stream[done:]]
        kept = [(s, int(x)) for s, x in zip(self.spans, starts, strict=False) if x + s[3] > done]
        self.spans = [(d, n, f + max(done - x, 0), m - max(done - x, 0), e) for (d, n, f, m, e), x in kept]
        self.held = len(stream) - done


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """The pieces of all ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    bounded_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        packer = Packer(encoder.ends, TaskContext.get().partitionId() << 36, length, block)
        end = np.array([END_ID], np.uint32)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held = packer.add(doc_id, np.concatenate([encoder.encode(text), end]) if text else end)
                while rows := list(islice(held, ROWS)):
                    yield table(rows)
        held = packer.flush(True)
        while rows := list(islice(held, ROWS)):
            yield table(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)

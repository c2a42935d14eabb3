"""Byte-level BPE over a public vocabulary: a heap of merge ranks over a linked list of symbols."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import widen

# Fixed value: the pattern that parts text before the merges of the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 500_000  # pieces whose ids a worker keeps; a longer-lived worker starts anew beyond it
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str = DEFAULT_VOCABULARY) -> dict[bytes, int]:
    """The rank file: a base64 symbol and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one piece.

    Symbols stand in a doubly linked list. A heap holds the rank and place of every pair that can
    merge; entries whose symbols have changed since are stale and skipped.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = [*range(1, n), -1]
    before = [-1, *range(n - 1)]
    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = symbol[i]
        j = after[i]
        if left is None or j < 0 or len(left) + len(symbol[j]) != size:
            continue
        both = symbol[i] = left + symbol[j]
        symbol[j] = None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            r = ranks.get(both + symbol[k])
            if r is not None:
                heapq.heappush(heap, (r, i, len(both) + len(symbol[k])))
        h = before[i]
        if h >= 0:
            r = ranks.get(symbol[h] + both)
            if r is not None:
                heapq.heappush(heap, (r, h, len(symbol[h]) + len(both)))
    out = []
    i = 0
    while i >= 0:
        out.append(ranks[symbol[i]])
        i = after[i]
    return tuple(out)


class Encoder(dict):
    """Piece of text -> its ids, kept while the worker lives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> tuple[int, ...]:
        got = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(self) >= CACHE:
            self.clear()
        self[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for ids in map(self.__getitem__, self.pieces(text or "")):
            out += ids
        return out


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    """The text of ids: the vocabulary's strings, put together."""
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): one row for each row of ``docs``.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary
    text. The vocabulary, of fixed size, is read by the driver and broadcast. Texts are encoded
    whole; repeated rows and extra columns do no harm, the latter are not read.
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(load_ranks(vocabulary))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(sent.value)
        for batch in batches:
            at, flat = [0], []
            for t in batch.column(1):
                flat += enc.encode(t.as_py())
                at.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(at, dtype=np.int32)), pa.array(np.asarray(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return widen(docs.select(key, F.col(text)), 3).mapInArrow(run, f"{key} {kind}, ids array<int>")

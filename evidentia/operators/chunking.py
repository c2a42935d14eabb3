"""Chunks of documents by closed forms: no loop over a text, one row a chunk from a sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _checked(chars: int, overlap: int) -> int:
    if not 0 <= overlap < chars:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than the chunk size {chars}")
    return chars - overlap


def page_spans(pages: DataFrame, key: str = "dockey") -> DataFrame:
    """(key, page_no, text, before, upto): pages with the lengths before and up to them."""
    w = Window.partitionBy(key).orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.length("text").cast("bigint")).over(w)
    return pages.select(key, "page_no", "text", (upto - F.length("text")).alias("before"), upto.alias("upto"))


def overlap_chunks(pages: DataFrame, chars: int, overlap: int, key: str = "dockey", unit: str = "pages", joiner: str = "") -> DataFrame:
    """(key, chunk_ix, name, text): windows of ``chars`` that slide over the pages of each document.

    The name tells the pages a chunk ends and its predecessor ended on. A document without text
    gives one empty chunk. ``joiner`` stands between pages (a line break for lines of code).
    """
    stride = _checked(chars, overlap)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), joiner)
    gap = len(joiner)
    ends = F.array_sort(F.collect_list(F.struct("page_no", F.length("text").alias("n"))))
    docs = pages.groupBy(key).agg(text.alias("whole"), ends.alias("ends"))
    n = F.greatest(F.lit(0), F.ceil((F.length("whole") - chars) / stride)).cast("int")
    one = docs.select(key, "whole", "ends", F.explode(F.sequence(F.lit(0), n)).alias("chunk_ix"), n.alias("last"))
    # running ends of the pages within the row: (page, characters up to its end)
    run = F.aggregate(
        "ends",
        F.array().cast("array<struct<page_no:int,upto:bigint>>"),
        lambda a, p: F.concat(a, F.array(F.struct(p["page_no"].cast("int").alias("page_no"), (F.coalesce(F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("page_no"), F.lit(0).cast("bigint").alias("upto"))), a), -1)["upto"], F.lit(0)) + p["n"] + F.when(F.size(a) > 0, gap).otherwise(0)).alias("upto")))),
    )
    at = lambda i: F.coalesce(F.get(F.filter("run", lambda p: p["upto"] > i * stride + chars), F.lit(0))["page_no"], F.element_at("run", -1)["page_no"])
    i = F.col("chunk_ix")
    first, final = F.get("run", F.lit(0))["page_no"], F.element_at("run", -1)["page_no"]
    low = F.when(i == 0, first).otherwise(at(i - 1))
    high = F.when(i == F.col("last"), final).otherwise(at(i))
    placed = one.withColumn("run", run)
    return placed.select(
        key,
        "chunk_ix",
        F.concat(F.lit(f"{unit} "), low.cast("string"), F.lit("-"), high.cast("string")).alias("name"),
        F.substring("whole", i * stride + 1, F.lit(chars)).alias("text"),
    )


def text_chunks(docs: DataFrame, chars: int, overlap: int, key: str = "dockey", text: str = "text") -> DataFrame:
    """(key, chunk_ix, text): pieces of ``chars`` with the overlap on both sides.

    Null and empty texts give no chunk.
    """
    _checked(chars, overlap)
    n = F.ceil(F.length(text) / chars).cast("int")
    one = docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_ix"))
    start = F.greatest(F.col("chunk_ix") * chars - overlap, F.lit(0))
    end = F.least((F.col("chunk_ix") + 1) * chars + overlap, F.length(text))
    return one.select(key, "chunk_ix", F.substring(text, start + 1, end - start).alias("text"))


def token_chunks(docs: DataFrame, tokens: int, overlap: int, encode: Callable[[str], list[int]], key: str = "dockey", text: str = "text") -> DataFrame:
    """``text_chunks`` with sizes in tokens of a pluggable tokenizer, by the mean characters a token."""
    _checked(tokens, overlap)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                if not t:
                    continue
                per = len(t) / max(1, len(encode(t)))
                size, over, i = tokens * per, overlap * per, 0
                while int(i * size) < len(t):
                    rows.append((k, i, t[max(int(i * size - over), 0) : int((i + 1) * size + over)]))
                    i += 1
            yield pd.DataFrame(rows, columns=[key, "chunk_ix", "text"])

    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, chunk_ix int, text string")


def code_chunks(docs: DataFrame, chars: int, overlap: int, key: str = "dockey", text: str = "text") -> DataFrame:
    """``overlap_chunks`` over the lines of each text, counted from 0."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("page_no", "text"))
    return overlap_chunks(lines, chars, overlap, key, "lines", "\n")


def whole_texts(docs: DataFrame, key: str = "dockey", text: str = "text") -> DataFrame:
    """Each text as its one chunk."""
    return docs.select(key, F.lit(0).alias("chunk_ix"), text)


def trial_chunks(trials: DataFrame, summary: DataFrame, limit: int = 28_000) -> DataFrame:
    """One chunk a trial, cut at ``limit``, and the chunk that tells what was found."""
    return trials.select("dockey", F.lit(0).alias("chunk_ix"), F.substring("text", 1, limit).alias("text")).unionByName(summary)

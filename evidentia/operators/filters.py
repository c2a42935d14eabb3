"""Predicates and filters over documents, chunks and evidence."""

from __future__ import annotations

import math
from collections import Counter
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from evidentia.functions.text import _col

ENTROPY = (2.5, 8.0)


def matches(criteria: dict[str, Any], columns: list[str]) -> Column:
    """Conjunction of a filter map.

    ``k`` asks for equality, ``!k`` for inequality; ``?`` before either lets a missing field or a
    null pass. A field that does not exist fails without ``?``.
    """
    out = F.lit(True)
    for key, value in criteria.items():
        relaxed = key.startswith("?")
        name = key[1:] if relaxed else key
        negated = name.startswith("!")
        name = name[1:] if negated else name
        if name not in columns:
            out = out & F.lit(relaxed)
            continue
        c = F.col(name)
        one = ~c.eqNullSafe(F.lit(value)) if negated else c.eqNullSafe(F.lit(value))
        out = out & ((c.isNull() | one) if relaxed else one)
    return out


def filter_documents(docs: DataFrame, filters: list[dict[str, Any]]) -> DataFrame:
    """Documents that every map matches."""
    for f in filters:
        docs = docs.where(matches(f, docs.columns))
    return docs


@F.pandas_udf(DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    def of(t: str | None) -> float | None:
        counts = Counter(t.replace(" ", "")) if t else None
        if not counts:
            return None
        n = counts.total()
        return math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n

    return texts.map(of, na_action=None)


def entropy(c: str | Column) -> Column:
    """Shannon entropy in bits a character, blanks left out; null for nothing else.

    Counting the characters of a text is one call in C; expressions over arrays of characters take
    hundreds of times as long, and exploding them would shuffle every character.
    """
    return _entropy(_col(c))


def is_text(c: str | Column) -> Column:
    e = entropy(c)
    return F.coalesce((e > ENTROPY[0]) & (e < ENTROPY[1]), F.lit(False))


def valid_documents(chunks: DataFrame, check: bool = True) -> DataFrame:
    """(dockey) of documents with a usable text, from (dockey, chunk_ix, text, is_image).

    The first chunk needs ten characters; where ``check``, the first two need twenty that are no
    line breaks, and the first five must look like text. Images pass.
    """
    early = chunks.where(F.col("chunk_ix") < 5)
    joined = lambda n: F.array_join(F.transform(F.array_sort(F.filter(F.collect_list(F.struct("chunk_ix", "text")), lambda s: s["chunk_ix"] < n)), lambda s: s["text"]), "")
    per = early.groupBy("dockey").agg(joined(1).alias("one"), joined(2).alias("two"), joined(5).alias("five"), F.max("is_image").alias("is_image"))
    good = F.length("one") >= 10
    if check:
        good = good & (F.length(F.replace("two", F.lit("\n"), F.lit(""))) >= 20) & is_text("five")
    return per.where(F.col("is_image") | good).select("dockey")


def within_page_limit(pages: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(pages within the limit, rejected pages)."""
    fits = F.length("text") <= limit
    return pages.where(fits), pages.where(~fits)


def new_evidence(found: DataFrame, known: DataFrame) -> DataFrame:
    """Scored contexts above 0 that are not known yet, once each."""
    return found.where("score > 0").dropDuplicates(["ctx_id"]).join(known.select("ctx_id"), "ctx_id", "left_anti")


def scored(contexts: DataFrame, above: int | None = 0) -> DataFrame:
    """Contexts above an exclusive threshold, or all."""
    return contexts if above is None else contexts.where(F.col("score") > above)


def documents_of(contexts: DataFrame, at_least: int = 0) -> DataFrame:
    return contexts.where(F.col("score") >= at_least).select("dockey").distinct()


def relevant_media(media: str | Column) -> Column:
    return F.filter(_col(media), lambda m: ~F.coalesce(m["info"]["irrelevant"] == "true", F.lit(False)))


def for_display(chunks: DataFrame, hidden: tuple[str, ...] = ("embedding", "media", "text", "other")) -> DataFrame:
    return chunks.select(*[c for c in chunks.columns if c not in hidden])


def invalid_authors_removed(docs: DataFrame) -> DataFrame:
    from evidentia.functions.metadata import valid_authors

    return docs.withColumn("authors", valid_authors("authors"))


def unique_docnames(docs: DataFrame, order: str) -> DataFrame:
    """``docs`` with names made unique by letters, the first of each name kept bare.

    The second gets "a" and so on to "z", then two letters, then a number; where another document
    bears that name already, the order key makes it unique.
    """
    k = F.row_number().over(Window.partitionBy("docname").orderBy(order)) - 2
    letter = lambda n: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (n % 26 + 1).cast("int"), F.lit(1))
    tail = F.when(k < 26, letter(k)).when(k < 702, F.concat(letter(F.floor(k / 26) - 1), letter(k))).otherwise(F.concat(F.lit("_"), k.cast("string")))
    named = docs.withColumn("unique_docname", F.when(k < 0, F.col("docname")).otherwise(F.concat("docname", tail)))
    taken = docs.select(F.col("docname").alias("unique_docname"), F.lit("x").alias("_taken")).distinct()
    both = named.join(taken, "unique_docname", "left")
    clash = F.col("_taken").isNotNull() & (F.col("unique_docname") != F.col("docname"))
    return both.withColumn("unique_docname", F.when(clash, F.concat("unique_docname", F.lit("_x"), F.col(order).cast("string"))).otherwise(F.col("unique_docname"))).drop("_taken").select(*docs.columns, "unique_docname")

"""Aggregates and set operations of the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_usage(calls: DataFrame) -> DataFrame:
    """(session, model, prompt, completion, cost)."""
    return calls.groupBy("session", "model").agg(F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("cost").alias("cost"))


def usage_map(calls: DataFrame) -> DataFrame:
    """(session, token_counts): a map of model to its token counts."""
    per = token_usage(calls)
    return per.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.array("prompt", "completion"))))).alias("token_counts"))


def status(contexts: DataFrame, above: int = 0) -> DataFrame:
    """Papers, relevant papers and pieces of evidence of each session."""
    good = F.col("score") > above
    return contexts.groupBy("session").agg(F.countDistinct("dockey").alias("papers"), F.countDistinct(F.when(good, F.col("dockey"))).alias("relevant"), F.count(F.when(good, 1)).alias("evidence"))


def sections(contexts: DataFrame, group: str, order: str, text: str, joiner: str = "\n\n") -> DataFrame:
    """(group, first, section): the texts of each group in order, groups by their first place."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return contexts.groupBy(group).agg(F.min(order).alias("first"), F.array_join(F.transform(rows, lambda r: r[text]), joiner).alias("section"))


def joined_text(chunks: DataFrame, key: str, order: str, text: str, joiner: str = "") -> DataFrame:
    """(key, body): chunk texts put together; what overlaps counts twice."""
    rows = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[text]), joiner).alias("body"))


def timings(timers: DataFrame) -> DataFrame:
    return timers.groupBy("name").agg(F.min("seconds").alias("low"), F.avg("seconds").alias("mean"), F.max("seconds").alias("max"), F.sum("seconds").alias("total"))


def attempts(history, tool: str):
    """How often a tool occurs in a history of calls (a column of arrays of arrays)."""
    return F.size(F.filter(F.flatten(history), lambda t: t == tool))


def refreshed_quality(ranking: DataFrame, allowed: DataFrame, blocked: DataFrame) -> DataFrame:
    """(clean_name, quality): a raw ranking with overrides.

    Level 4 and levels that are no digit are -1; exactly blocked pairs go; allowed pairs override.
    """
    level = F.when(F.col("level").rlike("^[0-9]$") & (F.col("level") != "4"), F.col("level").cast("int")).otherwise(-1)
    base = ranking.select(F.lower("name").alias("clean_name"), level.alias("quality"))
    base = base.join(blocked.select("clean_name", "quality"), ["clean_name", "quality"], "left_anti")
    over = allowed.select("clean_name", "quality")
    return base.join(over.select("clean_name"), "clean_name", "left_anti").unionByName(over).dropDuplicates(["clean_name", "quality"]).orderBy("clean_name", "quality")


def vocabulary_of(arrays: DataFrame, column: str) -> DataFrame:
    """The sorted union of the arrays of a column, as one array."""
    return arrays.select(F.explode(column).alias("x")).distinct().agg(F.array_sort(F.collect_list("x")).alias("all"))

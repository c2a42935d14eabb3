"""Queries of the core operators on packed cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.operators import packed
from evidentia.session import table

PACKED_FIELDS = ["subject", "institution", "author", "urls"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack(table(spark, sf_dir, "retractions"), "row_id", PACKED_FIELDS)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p6_found": p6_found}

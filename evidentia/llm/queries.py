"""Queries of this subpackage, by the problem they solve, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.llm import leaks, linkage, lookalikes, names, readability, representative, scans, splitting, tokens
from evidentia.operators import packed
from evidentia.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which the plan has more than one piece."""
    return splitting.plan_texts(table(spark, sf_dir, "parsed_texts")).where("piece_no = 2").select("text_id")


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_texts(table(spark, sf_dir, "parsed_texts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.survivors(table(spark, sf_dir, "doc_details"), table(spark, sf_dir, "journal_quality"))


def p2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return representative.current_values(table(spark, sf_dir, "doc_details"), ["publisher", "license", "source_quality", "is_retracted"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(table(spark, sf_dir, "doc_details"))


def p3_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.plain_items(table(spark, sf_dir, "doc_details"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packed.unpack(table(spark, sf_dir, "retractions"), "row_id", ["author"])
    return names.pairs(names.mentioned(table(spark, sf_dir, "doc_details").select("authors"), items))


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.link(table(spark, sf_dir, "doc_details"), table(spark, sf_dir, "s2_papers"), "record_id", "paper_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_matches(spark, sf_dir).select("record_id", "paper_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.noises(table(spark, sf_dir, "parsed_texts"))


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired(table(spark, sf_dir, "parsed_texts"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p2_found": p2_found,
        "p2_current": p2_current,
        "p3_found": p3_found,
        "p3_plain": p3_plain,
        "p4_found": p4_found,
        "p5_found": p5_found,
        "p5_matches": p5_matches,
        "p7_found": p7_found,
        "p7_text": p7_text,
        "p8_ids": p8_ids,
        "p9_found": p9_found,
        "p10_found": p10_found,
    }


def oracle_sql() -> dict[str, str]:
    return {}

"""Clinical trials, reference managers, vector stores and saved objects as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string,organization:struct<fullName:string>>,"
    "statusModule:struct<overallStatus:string,startDateStruct:struct<date:string>,completionDateStruct:struct<date:string>>,"
    "descriptionModule:struct<briefSummary:string,detailedDescription:string>,eligibilityModule:struct<eligibilityCriteria:string>,"
    "designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:int>>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>>"
)
NOT_GIVEN = "Not provided"


def search(trials: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A slice of the ranked trials."""
    return trials.orderBy("rank").offset(offset).limit(limit)


def parsed(raw: DataFrame, json: str = "json") -> DataFrame:
    return raw.withColumn("t", F.from_json(json, TRIAL).getField("protocolSection"))


def _or(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NOT_GIVEN))


def report(raw: DataFrame, json: str = "json") -> DataFrame:
    """``raw`` with ``report``: a trial as text of fixed sections."""
    t = parsed(raw, json)
    part = lambda head, c: F.concat(F.lit(f"{head}: "), _or(c))
    text = F.concat_ws(
        "\n", part("Trial", "t.identificationModule.nctId"), part("Title", "t.identificationModule.briefTitle"), part("Status", "t.statusModule.overallStatus"), part("Start", "t.statusModule.startDateStruct.date"), part("Completion", "t.statusModule.completionDateStruct.date"),
        part("Type", "t.designModule.studyType"), part("Phases", F.nullif(F.array_join("t.designModule.phases", ", "), F.lit(""))), part("Enrollment", "t.designModule.enrollmentInfo.count"), part("Sponsor", "t.sponsorCollaboratorsModule.leadSponsor.name"),
        part("Summary", "t.descriptionModule.briefSummary"), part("Description", "t.descriptionModule.detailedDescription"), part("Eligibility", "t.eligibilityModule.eligibilityCriteria"),
    )
    return t.withColumn("report", text).drop("t")


def citation(raw: DataFrame, json: str = "json") -> DataFrame:
    """``raw`` with title, authors, year, docname and citation of a trial; the year is what stands before the first dash of its start."""
    t = parsed(raw, json)
    year = F.split_part(F.coalesce("t.statusModule.startDateStruct.date", F.lit("")), F.lit("-"), F.lit(1)).try_cast("int")
    org = F.coalesce("t.identificationModule.organization.fullName", F.lit("Unknown"))
    title = F.coalesce("t.identificationModule.briefTitle", F.lit("Unknown title"))
    nct = F.col("t.identificationModule.nctId")
    cite = F.concat(org, F.lit(". "), title, F.lit(". ClinicalTrials.gov, "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(". Trial "), F.coalesce(nct, F.lit("unknown")), F.lit("."))
    return t.select("*", nct.alias("docname"), title.alias("title"), F.array(org).alias("authors"), year.alias("year"), cite.alias("citation")).drop("t")


def is_trial(c: str | Column) -> Column:
    """The partition of a chunk: 1 for trials, 0 for papers."""
    return F.when((F.col(c) if isinstance(c, str) else c).rlike("^(NCT|XCT)[0-9]{8}"), 1).otherwise(0)


def read_library(items: DataFrame, limit: int | None = None) -> DataFrame:
    """A reference manager's items with a PDF, once a PDF."""
    out = items.where(F.col("pdf").isNotNull()).dropDuplicates(["pdf"])
    return out if limit is None else out.limit(limit)


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks) of a saved vector store; documents once a key."""
    rows = spark.read.parquet(path)
    docs = rows.select("doc.*").dropDuplicates(["dockey"])
    return docs, rows.withColumn("dockey", F.col("doc.dockey")).drop("doc")


def select_papers(submissions: DataFrame, question: str, choose) -> DataFrame:
    """Submissions that a chooser (DataFrame, question -> DataFrame of paper_id) takes; a plug-in."""
    return submissions.join(choose(submissions, question).select("paper_id"), "paper_id", "left_semi")

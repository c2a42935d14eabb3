"""The joins behind the pipeline, each a plain equi-join where the semantics allow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.metadata import normal_doi


def journal_quality(docs: DataFrame, quality: DataFrame, journal: str = "journal") -> DataFrame:
    """``docs`` with the best quality of the journal's name variants, -1 where unknown.

    Variants: as written, with "the " before it, with & as "and"; "amp;" is dropped and case folded.
    The last row of a name in the list counts.
    """
    last = quality.groupBy("clean_name").agg(F.max_by("quality", "line_no").alias("q"))
    name = F.lower(F.replace(F.col(journal), F.lit("amp;"), F.lit("")))
    variants = F.array_distinct(F.array(name, F.concat(F.lit("the "), name), F.replace(name, F.lit("&"), F.lit("and"))))
    names = docs.select(journal).where(F.col(journal).isNotNull()).distinct().select(journal, F.explode(variants).alias("clean_name"))
    best = names.join(last, "clean_name").groupBy(journal).agg(F.max("q").alias("_q"))
    return docs.join(best, journal, "left").withColumn("quality", F.coalesce("_q", F.lit(-1))).drop("_q")


def retraction_dois(retractions: DataFrame) -> DataFrame:
    """(doi): retracted and retracting DOIs, as written, empty ones dropped."""
    own = retractions.where("retraction_nature = 'Retraction'")
    one = own.select(F.col("retraction_doi").alias("doi")).union(own.select("original_paper_doi"))
    return one.where("trim(doi) <> ''").distinct()


def flag_retracted(docs: DataFrame, retractions: DataFrame) -> DataFrame:
    """``docs`` with ``retracted``: whether the normalised DOI is on the list."""
    dois = retraction_dois(retractions).select(normal_doi(F.trim("doi")).alias("_d")).distinct()
    return docs.join(dois, normal_doi(F.trim("doi")) == F.col("_d"), "left").withColumn("retracted", F.col("_d").isNotNull()).drop("_d")


def with_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files with their manifest row by path, else by name; of repeated paths the last row."""
    rows = manifest.groupBy("file_location").agg(*[F.max_by(c, "pos").alias(c) for c in manifest.columns if c not in ("file_location", "pos")])
    cols = [c for c in rows.columns if c != "file_location"]
    first = rows.select(F.col("file_location").alias("_p1"), *[F.col(c).alias(f"{c}_1") for c in cols])
    second = rows.select(F.col("file_location").alias("_p2"), *[F.col(c).alias(f"{c}_2") for c in cols])
    met = files.join(first, F.col("path") == F.col("_p1"), "left").join(second, F.col("name") == F.col("_p2"), "left")
    return met.select(*files.columns, *[F.when(F.col("_p1").isNotNull(), F.col(f"{c}_1")).otherwise(F.col(f"{c}_2")).alias(c) for c in cols])


def page_neighbours(pages: DataFrame, radius: int, key: str = "dockey") -> DataFrame:
    """(key, page_no, context): the text of the pages within ``radius``; -1 takes all of a document.

    A page is sent to the pages it serves, so the join is on equal keys whatever the radius.
    """
    if radius < 0:
        whole = pages.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n").alias("context"))
        return pages.select(key, "page_no").join(whole, key)
    sent = pages.select(key, F.explode(F.sequence(F.col("page_no") - radius, F.col("page_no") + radius)).alias("to"), "page_no", "text")
    served = sent.groupBy(key, "to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n").alias("context"))
    return pages.select(key, "page_no").join(served.withColumnRenamed("to", "page_no"), [key, "page_no"])


def chunk_pages(chunks: DataFrame, pages: DataFrame, key: str = "dockey", cell: int = 4096) -> DataFrame:
    """(key, chunk_ix, page_no) of the pages each character range touches.

    ``chunks`` has (key, chunk_ix, begin, end), ``pages`` (key, page_no, before, upto). Both are cut
    into cells, so that the range join is an equi-join on (key, cell).
    """
    a = chunks.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / cell), F.floor((F.greatest("end", F.col("begin") + 1) - 1) / cell))))
    b = pages.where("upto > before").withColumn("cell", F.explode(F.sequence(F.floor(F.col("before") / cell), F.floor((F.col("upto") - 1) / cell))))
    return a.join(b, [key, "cell"]).where("begin < upto and before < end").select(key, "chunk_ix", "page_no").distinct()


def best_title(asked: DataFrame, candidates: DataFrame, on: str, similar) -> DataFrame:
    """For each asked title the most similar candidate that shares the block ``on``."""
    met = asked.join(candidates, on).withColumn("similarity", similar)
    return met.groupBy("asked_id").agg(F.max_by("candidate_id", F.struct("similarity", (-F.col("candidate_id")).alias("low"))).alias("candidate_id"), F.max("similarity").alias("similarity"))


def authors_agree(a: str, b: str):
    """Whether any two authors in the same place contain each other, words of up to two letters aside."""
    bare = lambda x: F.array_join(F.filter(F.split(F.lower(x), r"(?U)\s+"), lambda w: F.length(w) > 2), " ")
    n = F.least(F.size(a), F.size(b))
    met = F.arrays_zip(F.slice(a, F.lit(1), n).alias("x"), F.slice(b, F.lit(1), n).alias("y"))
    return F.coalesce(F.exists(met, lambda p: F.contains(bare(p["x"]), bare(p["y"])) | F.contains(bare(p["y"]), bare(p["x"]))), F.lit(False))

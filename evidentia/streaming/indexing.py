"""Incremental indexing: new files of a folder, once each, into the index.

The file source keeps what it has seen in the checkpoint folder, so a run that was cut off goes on
where it stopped; the upsert is idempotent, so a batch seen twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.chunking import text_chunks
from evidentia.sources.index import Index

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def indexed_rows(files: DataFrame) -> DataFrame:
    body = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return files.select(F.col("path").alias("file_location"), F.md5("content").alias("file_hash"), F.element_at(F.split("path", "/"), -1).alias("title"), F.lit("").alias("year"), body.alias("body"))


def index_folder(spark: SparkSession, folder: str, index: Index, checkpoint: str, glob: str = "*.txt", files_a_batch: int = 1000, chars: int = 5000, overlap: int = 250) -> int:
    """Index what is new in ``folder`` and stop; returns the number of batches."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)
    batches = []

    def upsert(batch: DataFrame, number: int) -> None:
        docs = indexed_rows(batch)
        good = docs.where(F.length("body") > 0)
        pieces = text_chunks(good, chars, overlap, "file_location", "body").select("file_location", "chunk_ix", F.concat(F.lit("chunk "), F.col("chunk_ix").cast("string")).alias("name"), "text")
        index.upsert(good, pieces, docs.where(F.length("body") == 0))
        batches.append(number)

    query = source.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)

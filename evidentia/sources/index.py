"""The index as plain Parquet tables: documents, chunks and a manifest; every change is a new version.

A version is a folder; a small pointer file names the one in force and is replaced in one step, so
readers see either the old index or the new one. Nothing is kept outside the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.retrieval import bm25

OK, FAILED = "OK", "ERROR"
TABLES = {
    "docs": "file_location string, file_hash string, title string, year string, body string",
    "manifest": "file_location string, file_hash string, status string",
    "chunks": "file_location string, chunk_ix int, name string, text string",
}


class Index:
    """An index in ``path``, created on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self) -> str | None:
        fs, path = self._fs()
        p = path(f"{self.path}/CURRENT")
        if not fs.exists(p):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def table(self, name: str) -> DataFrame:
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{v}/{name}")

    def commit(self, **tables: DataFrame) -> str:
        """Write a version with the given tables, the others as they are, and point to it."""
        v = f"v-{uuid.uuid4().hex}"
        for name in TABLES:
            tables.get(name, self.table(name)).select(*[c.split()[0] for c in TABLES[name].split(", ")]).write.parquet(f"{self.path}/{v}/{name}")
        fs, path = self._fs()
        out = fs.create(path(f"{self.path}/.CURRENT-{v}"), True)
        out.write(bytearray(v.encode()))
        out.close()
        target = path(f"{self.path}/CURRENT")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(path(f"{self.path}/.CURRENT-{v}"), target, options)
        return v

    def upsert(self, docs: DataFrame, chunks: DataFrame | None = None, failed: DataFrame | None = None) -> str:
        """Add files that are not present with the same content; failed ones are noted and not retried."""
        known = self.table("manifest")
        new = docs.join(known.select("file_location", "file_hash"), ["file_location", "file_hash"], "left_anti").dropDuplicates(["file_location"])
        again = new.select("file_location")
        kept_docs = self.table("docs").join(again, "file_location", "left_anti")
        kept_manifest = known.join(again, "file_location", "left_anti")
        manifest = kept_manifest.unionByName(new.select("file_location", "file_hash", F.lit(OK).alias("status")))
        if failed is not None:
            bad = failed.select("file_location").distinct().join(manifest.select("file_location"), "file_location", "left_anti")
            manifest = manifest.unionByName(bad.select("file_location", F.lit(FAILED).alias("file_hash"), F.lit(FAILED).alias("status")))
        changed = {"docs": kept_docs.unionByName(new.select(kept_docs.columns)), "manifest": manifest}
        if chunks is not None:
            kept = self.table("chunks").join(again, "file_location", "left_anti")
            changed["chunks"] = kept.unionByName(chunks.join(again, "file_location", "left_semi").select(kept.columns))
        return self.commit(**changed)

    def delete(self, gone: DataFrame) -> str:
        """Remove files by exact path."""
        g = gone.select("file_location").distinct()
        return self.commit(**{n: self.table(n).join(g, "file_location", "left_anti") for n in TABLES})

    def sync(self, present: DataFrame, chunks: DataFrame | None = None) -> str:
        """Make the index hold exactly the present files; edited ones are indexed anew."""
        stale = self.table("manifest").join(present.select("file_location"), "file_location", "left_anti")
        if not stale.isEmpty():
            self.delete(stale)
        return self.upsert(present, chunks)

    def search(self, query: str, top_n: int = 10, offset: int = 0, min_score: float = 0.0) -> DataFrame:
        """(file_location, rank, score, title, year, body) of files in good order."""
        from evidentia.functions.text import search_query

        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string").withColumn("query", search_query("query"))
        good = self.table("docs").join(self.table("manifest").where(F.col("status") == OK).select("file_location"), "file_location", "left_semi")
        hits = bm25(good.withColumn("_all", F.concat_ws(" ", "title", "year", "body")), asked, top_n, "file_location", "_all", offset=offset, min_score=min_score)
        return hits.drop("query_id").join(good, "file_location").orderBy("rank")


class SearchCursor:
    """Continues a search: each call of the same query and years gives the next rows.

    The years belong to the key of the cursor; ``year_filter`` asks for them to restrict as well.
    """

    def __init__(self, index: Index, count: int = 8, year_filter: bool = False):
        self.index, self.count, self.year_filter = index, count, year_filter
        self.at: dict[tuple[str, str | None, str | None], int] = {}

    def search(self, query: str, min_year: str | None = None, max_year: str | None = None) -> DataFrame:
        key = (query, min_year, max_year)
        offset = self.at.get(key, 0)
        self.at[key] = offset + self.count
        hits = self.index.search(query, self.count, offset)
        if self.year_filter:
            hits = hits.where((F.lit(min_year).isNull() | (F.col("year") >= F.lit(min_year))) & (F.lit(max_year).isNull() | (F.col("year") <= F.lit(max_year))))
        return hits

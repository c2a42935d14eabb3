"""A collection of documents in memory of the session: docs, chunks and tombstones."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.filters import filter_documents, unique_docnames


@dataclass(frozen=True)
class Corpus:
    """docs (dockey, docname, citation, ...), chunks (dockey, chunk_ix, name, text, ...) and the keys of deleted documents."""

    docs: DataFrame
    chunks: DataFrame
    tombstones: DataFrame

    def add(self, docs: DataFrame, chunks: DataFrame, filters: list[dict[str, Any]] | None = None) -> Corpus:
        """Documents that are new, have chunks and pass the filters; adding brings deleted ones back."""
        new = filter_documents(docs, filters or []).join(self.docs.select("dockey"), "dockey", "left_anti")
        new = new.join(chunks.select("dockey").distinct(), "dockey", "left_semi").dropDuplicates(["dockey"])
        taken = self.docs.select(F.col("docname"), F.lit(0).alias("_new"), F.col("dockey"))
        named = taken.unionByName(new.select("docname", F.lit(1).alias("_new"), "dockey")).withColumn("_o", F.struct("_new", "dockey"))
        names = unique_docnames(named, "_o").where("_new = 1").select("dockey", "unique_docname")
        new = new.join(names, "dockey").drop("docname").withColumnRenamed("unique_docname", "docname")
        return replace(
            self,
            docs=self.docs.unionByName(new, allowMissingColumns=True),
            chunks=self.chunks.unionByName(chunks.join(new.select("dockey"), "dockey", "left_semi"), allowMissingColumns=True),
            tombstones=self.tombstones.join(new.select("dockey"), "dockey", "left_anti"),
        )

    def delete(self, docname: str | None = None, dockey: str | None = None) -> Corpus:
        """Drop documents by name or key with their chunks; their names are free again."""
        hit = F.lit(False)
        if docname is not None:
            hit = hit | (F.col("docname") == docname)
        if dockey is not None:
            hit = hit | (F.col("dockey") == dockey)
        gone = self.docs.where(hit).select("dockey")
        return replace(self, docs=self.docs.where(~hit), chunks=self.chunks.join(gone, "dockey", "left_anti"), tombstones=self.tombstones.unionByName(gone).distinct())

    def visible(self) -> DataFrame:
        return self.chunks.join(self.tombstones, "dockey", "left_anti")

    def citation(self, name: str) -> str:
        """The citation of the document of a chunk; an unknown name is an error."""
        row = self.chunks.where(F.col("name") == name).join(self.docs.select("dockey", "citation"), "dockey").select("citation").head()
        if row is None:
            raise ValueError(f"no chunk is named {name!r}")
        return row[0]


def write_vectors(chunks: DataFrame, path: str) -> None:
    """Chunks with vectors, keyed by document and place, so equal vectors stay apart."""
    chunks.dropDuplicates(["dockey", "chunk_ix"]).write.mode("append").parquet(path)

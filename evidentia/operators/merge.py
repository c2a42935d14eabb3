"""The ordered merge of metadata records of one work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.metadata import doc_id

LATEST = ("citation_count", "year", "publication_date")
PLAIN = ("docname", "citation", "title", "journal", "publisher", "volume", "issue", "issn", "pages", "doi", "doi_url", "url", "license", "pdf_url", "bibtex", "bibtex_type", "source_quality", "is_retracted")


def _merge_two(a: Column, b: Column, names: list[str], fields: dict) -> Column:
    both_dates = a["publication_date"].isNotNull() & b["publication_date"].isNotNull()
    prefer_b = ~both_dates | (a["publication_date"] <= b["publication_date"]) if "publication_date" in names else F.lit(True)
    out = []
    for n in names:
        x, y = a[n], b[n]
        if n in LATEST:
            v = F.greatest(x, y)
        elif n == "authors":
            length = lambda c: F.aggregate(F.transform(c, lambda t: F.length(t)), F.lit(0), lambda s, k: s + F.coalesce(k, F.lit(0)))
            filled = (F.coalesce(F.size(x), F.lit(0)) > 0) & (F.coalesce(F.size(y), F.lit(0)) > 0)
            other = F.when((F.coalesce(F.size(y), F.lit(0)) > 0) & prefer_b, y).otherwise(x)
            v = F.when(filled, F.when(length(x) >= length(y), x).otherwise(y)).otherwise(other)
        elif n == "key":
            v = F.when(x.isNotNull() & y.isNotNull(), F.lit(None).cast(fields[n])).otherwise(F.when(y.isNotNull() & prefer_b, y).otherwise(x))
        elif n == "content_hash":
            v = F.when(x.isNotNull() & y.isNotNull() & (x != y), F.lit(None).cast(fields[n])).otherwise(F.when(y.isNotNull() & prefer_b, y).otherwise(x))
        elif n == "other":
            v = F.map_concat(F.map_filter(F.coalesce(x, F.create_map().cast(fields[n])), lambda k, _: ~F.map_contains_key(F.coalesce(y, F.create_map().cast(fields[n])), k)), F.coalesce(y, F.create_map().cast(fields[n])))
        elif n == "client_source":
            v = F.concat(F.coalesce(x, F.array().cast(fields[n])), F.coalesce(y, F.array().cast(fields[n])))
        else:
            v = F.when(y.isNotNull() & prefer_b, y).otherwise(x)
        out.append(v.cast(fields[n]).alias(n))
    return F.struct(*out)


def merge_records(records: DataFrame, group: str, order: list[str]) -> DataFrame:
    """One record a group, folded left to right in ``order``.

    The later record wins unless both have dates and the earlier is newer; counts, years and dates
    take the greatest; the longer author list, all client sources and the union of ``other`` are
    kept; differing content hashes and repeated keys are dropped. ``doc_id`` is recomputed.
    """
    names = [c for c in records.columns if c not in (group, *order)]
    fields = {c: records.schema[c].dataType for c in names}
    rows = F.array_sort(F.collect_list(F.struct(*order, F.struct(*names).alias("_r"))))
    grouped = records.groupBy(group).agg(rows.alias("_rows"))
    folded = F.aggregate(
        F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0))),
        F.get("_rows", F.lit(0))["_r"].cast(records.select(F.struct(*names).alias("r")).schema["r"].dataType),
        lambda a, x: _merge_two(a, x["_r"], names, fields),
    )
    out = grouped.select(group, folded.alias("_m")).select(group, "_m.*")
    if "doi" in names:
        out = out.withColumn("doc_id", doc_id("doi", "content_hash" if "content_hash" in names else F.lit(None).cast("string")))
    return out


def fan_in(tiers: list[list[DataFrame]]) -> DataFrame:
    """Provider tables as one, with the tier and the place within it that order the merge."""
    out = None
    for t, tables in enumerate(tiers):
        for r, df in enumerate(tables):
            one = df.withColumn("tier", F.lit(-t)).withColumn("place", F.lit(r))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out

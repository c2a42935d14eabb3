"""The best value of each field in every group of records of the same work."""

from __future__ import annotations

import json
import re
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from evidentia.functions.doi import canonical_doi
from evidentia.session import cut

# A BibTeX value in braces (three deep; deeper ones are scanned) or quotes, or bare;
# a field; a whole entry.
_DEEP = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
_VALUE = rf'(?:{_DEEP}|"(?:[^"{{}}]++|{_DEEP})*+"|[\w.+-]+)'
_FIELD = rf"[A-Za-z][\w-]*\s*=\s*{_VALUE}"
_ENTRY = rf"(?s)\A\s*@\s*\w+\s*\{{\s*[^,{{}}=]*(?:,\s*{_FIELD}\s*)*+,?\s*\}}\s*\z"
_EMPTY = r'=\s*(?:[\s{}"]*)\z'
_HEAD = re.compile(r"\s*@\s*\w+\s*\{\s*[^,{}=]*")
_NAME = re.compile(r"[A-Za-z][\w-]*\s*=\s*")
_BARE = re.compile(r"[\w.+-]+")


def scanned_fields(entry: str | None) -> int | None:
    """``bibtex_fields`` of one entry with braces of any depth, by counting them."""
    m = _HEAD.match(entry or "")
    if not m:
        return None
    at, n, size = m.end(), 0, len(entry)
    skip = lambda i: i + len(entry[i:]) - len(entry[i:].lstrip())
    while at < size and entry[at] == ",":
        at = skip(at + 1)
        m = _NAME.match(entry, at)
        if not m:
            break
        at = begin = m.end()
        if entry[at : at + 1] in ("{", '"'):
            quoted, depth = entry[at] == '"', 0
            while at < size:
                depth += {"{": 1, "}": -1}.get(entry[at], 0)
                at += 1
                if depth < 0 or (not depth and (entry[at - 1] == '"' and at - 1 > begin if quoted else True)):
                    break
            if depth:
                return None
        else:
            m = _BARE.match(entry, at)
            if not m:
                return None
            at = m.end()
        n += bool(entry[begin:at].strip(' \t\r\n{}"'))
        at = skip(at)
    return n if entry[at:].strip() == "}" else None


@F.pandas_udf(IntegerType())
def _scanned(cells: pd.Series) -> pd.Series:
    return pd.Series([scanned_fields(s) for s in cells], dtype="Int32")


def bibtex_fields(entry: Column) -> Column:
    """The number of non-blank fields of a complete entry; null where it is cut off or none."""
    fields = F.regexp_extract_all(F.regexp_replace(entry, r"\A\s*@\s*\w+\s*\{[^,{}=]*", ""), F.lit(f"({_FIELD})"), F.lit(1))
    whole = entry.rlike(_ENTRY)
    # what the pattern doesn't take although its braces are even may be deeper than the pattern
    deep = ~whole & (F.length(F.replace(entry, F.lit("{"), F.lit(""))) == F.length(F.replace(entry, F.lit("}"), F.lit(""))))
    return F.when(whole, F.size(F.filter(fields, lambda f: ~f.rlike(_EMPTY)))).otherwise(_scanned(F.when(deep, entry)))


def _no_constant(_: str) -> None:
    raise ValueError


@F.pandas_udf(IntegerType())
def json_keys(cells: pd.Series) -> pd.Series:
    """Top-level keys with a value of a strict JSON object; null for anything else."""

    def count(s: str | None) -> int | None:
        if not s or s.lstrip()[:1] != "{":
            return None
        try:
            got = json.loads(s, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            return None
        return sum(v is not None and v != "" and v != [] and v != {} for v in got.values())

    return pd.Series([count(s) for s in cells], dtype="Int32")


def transitions(rows: DataFrame) -> DataFrame:
    """(field_name, before, after): which values follow which, an order without cycles.

    ``rows`` holds (work, field_name, v, at), values as hashes. The values of each work are put in
    the order of their first time; of two values that stand next to each other, the one that comes
    later in most works follows. A value's place is its mean place in the works it occurs in; steps
    against the order of places, which any cycle must hold, are dropped.
    """
    seen = rows.where("at is not null and v is not null").groupBy("work", "field_name", "v").agg(F.min("at").alias("first"))
    # copies are folded before: a window holds the different values of one work
    w = Window.partitionBy("work", "field_name")
    by_time = w.orderBy("first", "v")
    placed = seen.select("work", "field_name", "v", F.lag("v").over(by_time).alias("a"), F.row_number().over(by_time).alias("k"), F.count("*").over(w).alias("n")).where("n > 1")
    place = placed.groupBy("field_name", "v").agg(F.avg((F.col("k") - 1) / (F.col("n") - 1)).alias("place"))
    steps = placed.where("a is not null").groupBy("field_name", F.least("a", "v").alias("x"), F.greatest("a", "v").alias("y"))
    steps = steps.agg(F.sum(F.when(F.col("a") < F.col("v"), 1).otherwise(-1)).alias("lead")).where("lead <> 0")
    steps = steps.select("field_name", F.expr("if(lead > 0, x, y)").alias("before"), F.expr("if(lead > 0, y, x)").alias("after"))
    for side in ("before", "after"):
        steps = steps.join(place.select("field_name", F.col("v").alias(side), F.struct("place", F.col("v").alias("tie")).alias(f"at_{side}")), ["field_name", side])
    return steps.where("at_before < at_after").select("field_name", "before", "after")


def followed(values: DataFrame, steps: DataFrame) -> DataFrame:
    """(work, field_name, v): the values of ``values`` that another value of their work follows.

    The learned order is closed by walking: from each value along the steps, one step a round,
    until a value of the same work is met or nothing is left to walk. No pairs of a work's values
    are built.
    """
    front = values.select("work", "field_name", "v", F.col("v").alias("now"))
    past, met = front, values.limit(0).select("work", "field_name", "v")
    while True:
        after = front.join(steps.withColumnRenamed("before", "now"), ["field_name", "now"]).select("work", "field_name", "v", F.col("after").alias("now")).distinct()
        front = cut(after.join(past, ["work", "field_name", "v", "now"], "left_anti"))
        if front.isEmpty():
            return met
        hits = front.join(values.select("work", "field_name", F.col("v").alias("now")), ["work", "field_name", "now"]).select("work", "field_name", "v").distinct()
        met, past = met.unionByName(hits), past.unionByName(front)
        front = front.join(hits, ["work", "field_name", "v"], "left_anti")


def latest(own: DataFrame, quality: dict[str, Column]) -> DataFrame:
    """(work, first_record_id, field_name, record_id): who supplies the best value of each field.

    ``own`` holds (work, record_id, retrieved_at) and the fields. The highest ``quality`` comes
    first. Among equals with a time the latest wins. A value without a time takes its place by the
    learned order of values: it wins over the latest timed one where it follows that or, among
    untimed ones only, where no other follows it. What the order leaves open goes to the timed
    value, then to the smallest record_id.
    """
    values = [F.struct(F.lit(f).alias("field_name"), q.cast("bigint").alias("q"), F.xxhash64(F.col(f).cast("string")).alias("v")) for f, q in quality.items()]
    rated = own.select("work", "record_id", F.col("retrieved_at").alias("at"), *[s.alias(f"r_{f}") for s, f in zip(values, quality, strict=True)])
    best = [F.max(F.when(F.col(f"r_{f}.q").isNotNull(), F.struct(F.col(f"r_{f}.q").alias("q"), "at", (-F.col("record_id")).alias("low"), F.col(f"r_{f}.v").alias("v")))).alias(f) for f in quality]
    # groups of any size are folded before the shuffle; only hashes and counts leave a partition
    groups = rated.groupBy("work").agg(F.min("record_id").alias("first_record_id"), F.max("record_id").alias("_last"), *best).where("_last > first_record_id")
    tops = groups.select("work", "first_record_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("top")) for f in quality])).alias("r")).select("work", "first_record_id", "r.field_name", "r.top")
    tops = cut(tops.where("top is not null"))
    each = rated.select("work", "record_id", "at", F.explode(F.array(*[f"r_{f}" for f in quality])).alias("r")).select("work", "record_id", "at", "r.*").where("q is not null")
    untimed = each.where("at is null").groupBy("work", "field_name", "q", "v").agg(F.min("record_id").alias("record_id"))
    rivals = cut(untimed.join(tops, ["work", "field_name"]).where("q = top.q and v <> top.v").select("work", "field_name", "v", "record_id", F.col("top.v").alias("top_v"), F.col("top.at").isNotNull().alias("timed")))
    if rivals.isEmpty():
        # every untimed value is the only one of its rank: the learned order has nothing to decide
        return tops.select("work", "first_record_id", "field_name", (-F.col("top.low")).alias("record_id"))
    steps = cut(transitions(each))
    lead = rivals.select("work", "field_name", F.col("top_v").alias("v")).distinct()
    group = rivals.select("work", "field_name", "v").unionByName(lead)
    behind = cut(followed(cut(group), steps))
    # the timed leader stays unless a rival follows it; untimed rivals must not be followed themselves
    ahead = rivals.join(behind, ["work", "field_name", "v"], "left_anti").join(behind.select("work", "field_name", F.col("v").alias("top_v")), ["work", "field_name", "top_v"], "left_semi")
    winner = ahead.groupBy("work", "field_name").agg(F.min("record_id").alias("winner"))
    return tops.join(winner, ["work", "field_name"], "left").select("work", "first_record_id", "field_name", F.coalesce("winner", -F.col("top.low")).alias("record_id"))


def survivors(records: DataFrame, journals: DataFrame) -> DataFrame:
    """(first_record_id, field_name, record_id): who supplies each surviving value.

    Groups are the records, two or more, of one canonical DOI; null and blank DOIs group nothing.
    Quality comes first (largest count that is not negative; a known journal; most non-blank BibTeX
    fields; most JSON keys with a value), then currency (``latest``), then the smallest record_id.
    Fields without a usable value give no row. Repeated rows are one record.
    """
    known = journals.select(_letters("clean_name").alias("_name")).where("_name is not null").distinct()
    own = records.select(
        "record_id", "retrieved_at", canonical_doi("doi").alias("work"),
        "citation_count", "journal", "bibtex", "other", _letters("journal").alias("_letters"),
    ).where("work is not null")
    # a fixed reference table of a few hundred names; Spark broadcasts it by its own size limit
    own = own.join(known.withColumn("_known", F.lit(1)), F.col("_letters") == F.col("_name"), "left")
    quality = {
        "citation_count": F.when(F.col("citation_count") >= 0, F.col("citation_count")),
        "journal": F.col("_known"),
        "bibtex": bibtex_fields(F.col("bibtex")),
        "other": json_keys("other"),
    }
    return latest(own, quality).select("first_record_id", "field_name", "record_id")


def _letters(name: str) -> Column:
    """Lower case without blanks; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.col(name), r"(?U)\s+", "")), F.lit(""))


def current_values(records: DataFrame, fields: list[str]) -> DataFrame:
    """(first_record_id, field_name, value): the current value of each field in each group.

    All values that are not blank are equally good: currency (``latest``) decides.
    """
    text = lambda f: F.nullif(F.trim(F.col(f).cast("string")), F.lit(""))
    own = records.select("record_id", "retrieved_at", canonical_doi("doi").alias("work"), *[text(f).alias(f) for f in fields]).where("work is not null")
    chosen = latest(own, {f: F.when(F.col(f).isNotNull(), 1) for f in fields})
    values = own.select("record_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("r")).select("record_id", "r.*").where("value is not null").distinct()
    return chosen.join(values, ["record_id", "field_name"]).select("first_record_id", "field_name", "value")

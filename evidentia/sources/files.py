"""Files and tables as sources: scans, text reads, dispatch by suffix, manifests and lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".pdf", ".html", ".md", ".xlsx", ".docx", ".pptx")
IMAGES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".gif")
OFFICE = (".docx", ".xlsx", ".pptx")
# The first four bytes of documents that come without a name.
MAGIC_PDF, MAGIC_HTML = "%PDF", ("<htm", "<!DO", "<xsl")


def scan(spark: SparkSession, folder: str, recursive: bool = True, suffixes: tuple[str, ...] = SUFFIXES, keep: Column | None = None) -> DataFrame:
    """(path, name, suffix, modified, length, content) of a folder's files, listed in parallel.

    Only files with a known suffix, or those a predicate keeps, are read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    out = raw.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("suffix"), F.col("modificationTime").alias("modified"), "length", "content")
    return out.where(keep if keep is not None else F.col("suffix").isin(*suffixes))


def content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.md5("content"))


def read_text(files: DataFrame, split_lines: bool = False, page_size_limit: int | None = None) -> DataFrame:
    """(path, page_no, text): whole texts as page 1, or one row a line.

    Bytes that are no UTF-8 are dropped, and such a file keeps its lines together. Pages beyond the
    limit are left out; ``rejected_text`` has them.
    """
    text = F.try_validate_utf8(F.col("content").cast("string"))
    lenient = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    own = files.select("path", F.coalesce(text, lenient).alias("text"), text.isNotNull().alias("clean"))
    if split_lines:
        lines = F.when(F.col("clean"), F.split("text", "\n")).otherwise(F.array("text"))
        pages = own.select("path", F.posexplode(lines).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)
    else:
        pages = own.select("path", F.lit(1).alias("page_no"), "text")
    return pages if page_size_limit is None else pages.where(F.length("text") <= page_size_limit)


def sniffed(head: str | Column) -> Column:
    """pdf, html or text by the first four characters."""
    c = F.substring(F.col(head) if isinstance(head, str) else head, 1, 4)
    return F.when(c == MAGIC_PDF, "pdf").when(c.isin(*MAGIC_HTML), "html").otherwise("text")


def reader_of(suffix: str | Column) -> Column:
    """The reader that a suffix asks for: pdf, text, html, image, office or code."""
    s = F.col(suffix) if isinstance(suffix, str) else suffix
    return F.when(s == ".pdf", "pdf").when(s == ".txt", "text").when(s == ".html", "html").when(s.isin(*IMAGES), "image").when(s.isin(*OFFICE), "office").otherwise("code")


def read_all(files: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(path, page_no, text, media) of all files, each branch by its reader."""
    routed = files.withColumn("reader", reader_of("suffix"))
    out = None
    for kind, read in readers.items():
        one = read(routed.where(F.col("reader") == kind).drop("reader"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def image_media(files: DataFrame) -> DataFrame:
    """An image as an empty text with one medium."""
    medium = F.struct(F.lit(0).alias("index"), F.col("content").alias("data"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text"), F.create_map(F.lit("suffix"), F.col("suffix")).alias("info"))
    return files.select("path", F.lit(1).alias("page_no"), F.lit("").alias("text"), F.array(medium).alias("media"))


def page_range(pages: DataFrame, wanted: int | tuple[int, int] | None, page: str = "page_no") -> DataFrame:
    """Pages of a 1-based inclusive range; a number is one page, None all."""
    if wanted is None:
        return pages
    a, b = (wanted, wanted) if isinstance(wanted, int) else wanted
    return pages.where((F.col(page) >= max(1, a)) & (F.col(page) <= b))


def fetch(url: str, folder: str) -> str:
    """A URL saved into the staging folder; the one step that runs on the driver."""
    import os
    import urllib.parse
    import urllib.request

    name = os.path.basename(urllib.parse.urlparse(url).path) or "download.html"
    target = os.path.join(folder, name)
    with urllib.request.urlopen(url, timeout=60) as r, open(target, "wb") as f:  # noqa: S310
        f.write(r.read())
    return target


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest CSV with a ``pos`` that tells repeated paths apart; needs ``file_location``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "file_location" not in rows.columns:
        raise ValueError("a manifest needs a file_location column")
    return rows.withColumn("pos", F.monotonically_increasing_id())


def read_retractions(spark: SparkSession, path: str) -> DataFrame:
    """The retraction CSV with snake-case names."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {"Record ID": "record_no", "RetractionDOI": "retraction_doi", "OriginalPaperDOI": "original_paper_doi", "RetractionNature": "retraction_nature"}
    return rows.select(*[F.col(f"`{c}`").alias(names.get(c, c.lower().replace(" ", "_"))) for c in rows.columns])


def read_journal_quality(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).schema("clean_name string, quality int").csv(path)
    return rows.withColumn("line_no", F.monotonically_increasing_id())


def write_manifest(docs: DataFrame, path: str, first: tuple[str, ...] = ("doi", "file_location"), without: tuple[str, ...] = ("bibtex", "embedding")) -> None:
    """Records as CSV: chosen columns first, the rest sorted, arrays and maps as JSON."""
    lead = [c for c in first if c in docs.columns]
    cols = [*lead, *sorted(c for c in docs.columns if c not in lead and c not in without)]
    nested = {f.name for f in docs.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    docs.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in cols]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

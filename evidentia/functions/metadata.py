"""Identity, dates, BibTeX and validation of bibliographic records, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import KEY_SIGNS, UNKNOWN_AUTHORS, _col, strip_accents

# DOI prefixes, entry types of old tools (first hit in this order counts), content
# types, preprint servers, and the wording of source qualities.
DOI_PREFIXES = ("https://doi.org/", "http://dx.doi.org/")
ENTRY_TYPES = {
    "None": "article", "Article": "article", "JournalArticle": "article", "Review": "article", "Book": "book", "BookSection": "inbook",
    "ConferencePaper": "inproceedings", "Conference": "inproceedings", "Dataset": "misc", "Dissertation": "phdthesis", "Journal": "article",
    "Patent": "patent", "Preprint": "article", "Report": "techreport", "Thesis": "phdthesis", "WebPage": "misc", "Plain": "article",
}
CONTENT_TYPES = {
    "journal-article": "article", "journal-issue": "misc", "journal-volume": "misc", "journal": "misc", "proceedings-article": "inproceedings",
    "proceedings": "proceedings", "dataset": "misc", "component": "misc", "report": "techreport", "report-series": "techreport", "standard": "misc",
    "standard-series": "misc", "edited-book": "book", "monograph": "book", "reference-book": "book", "book": "book", "book-series": "book", "book-set": "book",
    "book-chapter": "inbook", "book-section": "inbook", "book-part": "inbook", "book-track": "inbook", "reference-entry": "inbook", "dissertation": "phdthesis",
    "posted-content": "misc", "peer-review": "misc", "other": "article",
}
BIORXIV_LENGTH, MEDRXIV_LENGTH = 25, 27
QUALITIES = {0: "poor quality or predatory journal", 1: "peer-reviewed journal", 2: "domain leading peer-reviewed journal", 3: "highest quality peer-reviewed journal"}
NO_AUTHORS = ("et al", "et al.")
DATE_FORMATS = (("yyyy-MM-dd'T'HH:mm:ssXX", r"^\d{4}-\d{1,2}-\d{1,2}T"), ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d"), ("MMMM d, yyyy", r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$"), ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"))


def encode_id(c: str | Column, size: int = 16) -> Column:
    return F.substring(F.md5(F.lower(_col(c))), 1, size)


def doc_id(doi: str | Column, content_hash: str | Column) -> Column:
    """From DOI and content, else content, else random."""
    d, h = F.nullif(_col(doi), F.lit("")), F.nullif(_col(content_hash), F.lit(""))
    return F.when(d.isNotNull(), encode_id(F.concat(F.lower(d), F.coalesce(h, F.lit(""))))).otherwise(encode_id(F.coalesce(h, F.uuid())))


def context_id(question: str | Column, summary: str | Column, prefix: str = "pqac-") -> Column:
    return F.concat(F.lit(prefix), encode_id(F.concat(_col(question), F.substring(_col(summary), 1, 500)), 8))


def parse_date(c: str | Column) -> Column:
    """The first of five formats that fits; null for anything else."""
    t = F.regexp_replace(_col(c), r"([+-]\d\d):(\d\d)$", "$1$2")
    return F.coalesce(*[F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for f, p in DATE_FORMATS])


def date_from_parts(parts: str | Column) -> Column:
    """[year, month?, day?] as a date."""
    p = _col(parts)
    one = F.lit(1)
    return F.make_date(F.get(p, F.lit(0)), F.coalesce(F.get(p, F.lit(1)), one), F.coalesce(F.get(p, F.lit(2)), one))


def normal_doi(c: str | Column) -> Column:
    t = _col(c)
    for p in DOI_PREFIXES:
        t = F.when(t.startswith(p), F.replace(t, F.lit(p), F.lit(""))).otherwise(t)
    return F.lower(F.nullif(t, F.lit("")))


def one_doi(dois: str | Column) -> Column:
    """The DOI of a list of one; a longer list has none."""
    return F.when(F.size(_col(dois)) == 1, normal_doi(F.get(_col(dois), F.lit(0))))


def doi_url(url: str | Column, doi: str | Column) -> Column:
    u = F.coalesce(F.nullif(_col(url), F.lit("")), F.concat(F.lit("https://doi.org/"), F.nullif(_col(doi), F.lit(""))))
    return F.lower(F.replace(u, F.lit("http://dx.doi.org/"), F.lit("https://doi.org/")))


def preprint_journal(journal: str | Column, doi: str | Column) -> Column:
    """The journal, else the preprint server that the DOI tells."""
    d = F.coalesce(_col(doi), F.lit(""))
    bio = d.contains("10.1101/")
    server = (
        F.when(d.contains("10.48550/"), "ArXiv").when(d.contains("10.26434/"), "ChemRxiv")
        .when(bio & (F.length(d) == BIORXIV_LENGTH), "BioRxiv").when(bio & (F.length(d) == MEDRXIV_LENGTH), "MedRxiv").when(d.contains("10.31224/"), "EngRxiv")
    )
    return F.coalesce(F.nullif(_col(journal), F.lit("")), server)


def clean_pages(c: str | Column) -> Column:
    return F.replace(F.replace(_col(c), F.lit("--"), F.lit("-")), F.lit(" "), F.lit(""))


def clean_key(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"</?\w{1,10}>", "")


def valid_authors(c: str | Column) -> Column:
    return F.filter(_col(c), lambda a: a.isNotNull() & (a != "") & ~F.lower(a).isin(*NO_AUTHORS))


def string_list(c: str | Column) -> Column:
    """A list or set written as text, with or without brackets, as an array; quoted commas stay."""
    bare = F.regexp_replace(F.trim(_col(c)), r"^[\[{(]|[\]})]$", "")
    items = F.regexp_extract_all(bare, F.lit(r"""\s*("[^"]*"|'[^']*'|[^,"'\s][^,]*)"""), F.lit(1))
    return F.transform(items, lambda x: F.trim(F.regexp_replace(x, r"""^["']|["']$""", "")))


def overwritten(value: str | Column, by: str | Column, fields: str | Column, name: str) -> Column:
    """``by`` where ``name`` is among the fields to overwrite and it has a value."""
    return F.when(F.array_contains(_col(fields), name) & (F.coalesce(F.length(_col(by)), F.lit(0)) > 0), _col(by)).otherwise(_col(value))


def bibtex_field(bibtex: str | Column, field: str, missing: str = "") -> Column:
    got = F.regexp_extract(_col(bibtex), rf"(?i){field}\s*=\s*\{{(.*?)\}},", 1)
    return F.when(_col(bibtex).rlike(rf"(?i){field}\s*=\s*\{{(.*?)\}},"), F.trim(got)).otherwise(F.lit(missing))


def bibtex_key(authors: str | Column, year: str | Column, title: str | Column) -> Column:
    """Last name of the first author, year and first three words of the title."""
    first = F.get(_col(authors), F.lit(0))
    last = F.lower(F.element_at(F.split(F.trim(first), r"(?U)\s+"), -1))
    name = F.when(F.coalesce(F.length(first), F.lit(0)) == 0, F.lit(UNKNOWN_AUTHORS)).when(first.contains("Unknown"), F.lit(UNKNOWN_AUTHORS)).otherwise(F.substring(strip_accents(last), 1, 50))
    head = F.array_join(F.slice(F.split(F.trim(F.lower(_col(title))), r"(?U)\s+"), 1, 3), "")
    return F.translate(F.concat(name, F.coalesce(_col(year).cast("string"), F.lit("Unknown year")), F.substring(head, 1, 100)), KEY_SIGNS, "")


def repaired_bibtex(c: str | Column) -> Column:
    """Entry types of old tools as BibTeX types: the first known part of the type counts."""
    t = _col(c)
    listed = F.regexp_extract(t, r"@\['(.*)'\]", 1)
    plain = F.regexp_extract(t, r"@(\w+)\{", 1)
    kind = F.when(listed != "", listed).otherwise(plain)
    current = F.when(listed != "", F.concat(F.lit("@['"), listed, F.lit("']"))).otherwise(F.concat(F.lit("@"), plain))
    new = None
    for old, to in ENTRY_TYPES.items():
        hit = kind.contains(old)
        new = F.when(hit, F.lit(f"@{to}")) if new is None else new.when(hit, F.lit(f"@{to}"))
    fixed = F.when(new.isNotNull() & (kind != ""), F.replace(t, current, new)).otherwise(t)
    return F.when(t.contains("@None"), F.replace(t, F.lit("@None"), F.lit("@article"))).otherwise(fixed)


def bibtex_type(c: str | Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.get(F.array(table[_col(c)]), F.lit(0)), F.lit("article"))


def bibtex_complete(c: str | Column, fields: tuple[str, ...] = ("doi", "title")) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & F.coalesce(_col(c).contains(f"{f}="), F.lit(False))
    return out


def made_bibtex(key: Column, kind: Column, fields: dict[str, Column], authors: Column) -> Column:
    """An entry of the fields that have a value."""
    parts = [F.when(F.coalesce(F.length(v.cast("string")), F.lit(0)) > 0, F.concat(F.lit(f'    {k} = "'), v.cast("string"), F.lit('"'))) for k, v in fields.items()]
    people = F.when(F.size(authors) > 0, F.concat(F.lit('    author = "'), F.array_join(authors, " and "), F.lit('"')))
    return F.concat(F.lit("@"), F.coalesce(kind, F.lit("article")), F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", people, *parts), F.lit("\n}\n"))


def reference_text(authors: Column, title: Column, journal: Column, volume: Column, issue: Column, pages: Column, year: Column, doi: Column) -> Column:
    """A plain reference: people, title, journal with its numbers, year and DOI."""
    n = F.size(authors)
    people = F.when(n > 1, F.concat(F.array_join(F.slice(authors, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(authors, -1))).when(n == 1, F.get(authors, F.lit(0)))
    numbers = F.concat(F.coalesce(volume, F.lit("")), F.coalesce(F.concat(F.lit("("), issue, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(":"), pages), F.lit("")))
    place = F.concat_ws(", ", F.coalesce(journal, F.lit("Unknown journal")), F.nullif(numbers, F.lit("")), F.coalesce(year.cast("string"), F.lit("Unknown year")))
    parts = F.concat_ws(". ", F.coalesce(people, F.lit("Unknown author(s)")), F.coalesce(title, F.lit("Unknown title")), place)
    return F.concat(parts, F.lit("."), F.coalesce(F.concat(F.lit(" URL: https://doi.org/"), doi, F.lit(", doi:"), doi, F.lit(".")), F.lit("")))


def formatted_citation(citation: Column, doi: Column, retracted: Column, count: Column, quality: Column) -> Column:
    """The citation with what is known of retraction, citations and source quality."""
    banner = F.concat(F.lit("**RETRACTED ARTICLE** "), F.when(F.coalesce(F.length(citation), F.lit(0)) > 0, F.concat(F.lit("Citation: "), citation)).otherwise(F.concat(F.lit("Original DOI: "), F.coalesce(doi, F.lit("None")))), F.lit(" Retrieved from http://retractiondatabase.org/."))
    wording = None
    for k, text in QUALITIES.items():
        wording = F.when(quality == k, text) if wording is None else wording.when(quality == k, text)
    counted = F.concat(citation, F.lit(" This article has "), count.cast("string"), F.lit(" citations"))
    full = F.when(wording.isNotNull(), F.concat(counted, F.lit(" and is from a "), wording, F.lit("."))).otherwise(F.concat(counted, F.lit(".")))
    return F.when(retracted, banner).when(count.isNull() | quality.isNull(), citation).otherwise(full)


def hydration_needed(columns: list[str]) -> Column:
    """Whether any of the fields is null."""
    return F.exists(F.array(*[F.col(c).isNull() for c in columns]), lambda x: x)


def appended_source(sources: str | Column, source: str) -> Column:
    return F.array_union(F.coalesce(_col(sources), F.array().cast("array<string>")), F.array(F.lit(source)))

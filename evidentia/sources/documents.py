"""Readers of structured files: HTML, office files and, by plug-in, PDF."""

from __future__ import annotations

import importlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = "path string, page_no int, text string"
_BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 table ul ol section article blockquote pre".split())
_HIDDEN = frozenset("script style head noscript".split())


class _Plain(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.link: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n* ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a":
            self.link.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "td":
            self.out.append(" | ")
        elif tag in _BLOCKS:
            self.out.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a" and self.link:
            self.out.append(f"]({self.link.pop()})")
        elif tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(html: str) -> str:
    """HTML as text in the manner of Markdown."""

    p = _Plain()
    p.feed(html)
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in "".join(p.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def read_html(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "page_no": 1, "text": [html_text(bytes(b).decode("utf-8", "ignore")) for b in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, PAGES)


def office_text(data: bytes, suffix: str) -> str:
    """Paragraphs and table cells of an office file, blank lines between.

    The files are zipped XML, so nothing beyond the standard library is needed.
    """
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    out: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if suffix == ".docx":
            body = ElementTree.fromstring(z.read("word/document.xml"))  # noqa: S314
            for p in body.iter():
                if local(p) == "p":
                    out.append("".join(t.text or "" for t in p.iter() if local(t) == "t"))
        elif suffix == ".pptx":
            slides = sorted((n for n in names if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(c for c in n if c.isdigit()) or 0))
            for n in slides:
                for p in ElementTree.fromstring(z.read(n)).iter():  # noqa: S314
                    if local(p) == "p":
                        out.append("".join(t.text or "" for t in p.iter() if local(t) == "t"))
        else:
            shared: list[str] = []
            if "xl/sharedStrings.xml" in names:
                for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):  # noqa: S314
                    shared.append("".join(t.text or "" for t in si.iter() if local(t) == "t"))
            for n in sorted(x for x in names if x.startswith("xl/worksheets/sheet") and x.endswith(".xml")):
                for row in ElementTree.fromstring(z.read(n)).iter():  # noqa: S314
                    if local(row) != "row":
                        continue
                    cells = []
                    for c in row:
                        v = next((x.text or "" for x in c.iter() if local(x) in ("v", "t")), "")
                        cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() else v)
                    out.append(" | ".join(cells))
    return "\n\n".join(x for x in out if x.strip())


def read_office(files: DataFrame) -> DataFrame:
    """(path, page_no, text): an office file is one page; one that cannot be read has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data, suffix in zip(pdf["path"], pdf["content"], pdf["suffix"], strict=True):
                try:
                    rows.append((path, 1, office_text(bytes(data), suffix)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.select("path", "content", "suffix").mapInPandas(run, PAGES)


Parser = Callable[[bytes], list[str]]


def parser_of(spec: str | Parser) -> Parser:
    """A PDF parser, or the import path of one: ``package.module:function`` or with dots."""
    if callable(spec):
        return spec
    module, _, name = spec.replace(":", ".").rpartition(".")
    return getattr(importlib.import_module(module), name)


def _pypdf(data: bytes) -> list[str]:
    import pypdf

    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages]


def _pymupdf(data: bytes) -> list[str]:
    import pymupdf

    return [p.get_text("text", sort=True) for p in pymupdf.open(stream=data)]


def _docling(data: bytes) -> list[str]:
    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    doc = DocumentConverter().convert(DocumentStream(name="x.pdf", stream=io.BytesIO(data))).document
    return [doc.export_to_markdown(page_no=n) for n in sorted(doc.pages)]


PDF_PARSERS: dict[str, Parser] = {"pypdf": _pypdf, "pymupdf": _pymupdf, "docling": _docling}


def read_pdf(files: DataFrame, parser: str | Parser = "pypdf", page_size_limit: int | None = None, running_total: bool = False, fallback: str | Parser | None = None, retries: int = 0) -> DataFrame:
    """(path, page_no, text) by a plug-in parser, one task a batch of files.

    A remote parser may be retried and has a fallback. A page beyond the limit, or all pages once
    the running total is, rejects the file. The parser's library must be installed on the workers.
    """
    first = PDF_PARSERS[parser] if isinstance(parser, str) and parser in PDF_PARSERS else parser_of(parser)
    second = None if fallback is None else PDF_PARSERS[fallback] if isinstance(fallback, str) and fallback in PDF_PARSERS else parser_of(fallback)

    def parse(data: bytes) -> list[str]:
        for k in range(retries + 1):
            try:
                return first(data)
            except Exception:
                if k == retries:
                    if second is None:
                        raise
                    return second(data)
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                pages = parse(bytes(data))
                sizes = [sum(map(len, pages))] if running_total else [len(p) for p in pages]
                if page_size_limit is None or max(sizes, default=0) <= page_size_limit:
                    rows += [(path, i, t) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "text"])

    return files.select("path", "content").mapInPandas(run, PAGES)


def reader_registry(pdf: str | Parser = "pypdf") -> dict[str, Callable[[DataFrame], DataFrame]]:
    """The readers that ``files.read_all`` dispatches to."""
    from evidentia.sources.files import image_media, read_text

    return {
        "text": read_text,
        "code": lambda f: read_text(f, split_lines=True),
        "html": read_html,
        "office": read_office,
        "image": image_media,
        "pdf": lambda f: read_pdf(f, pdf) if f.limit(1).count() else f.select("path", F.lit(1).alias("page_no"), F.lit("").alias("text")).limit(0),
    }

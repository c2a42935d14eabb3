"""Splitting of oversized texts at natural boundaries, range by range.

Texts come as ranges with a little of their neighbours on either side (a halo). Workers find the
boundaries in each range on their own; the boundary tables are stitched by text in range order,
where a running sum of range lengths turns local offsets into global ones, and a scan with a state
of a few numbers places the cuts. Pieces are then emitted by offset from the ranges they touch. No
step holds a whole file: ``file_ranges`` reads files by byte range, and a range is a row.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.session import spread, widen

RANGE = 8192  # characters (of columns) or bytes (of files) in a range
HALO = 8
DEFAULT_SIZE, DEFAULT_OVERLAP = 5000, 250
WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = 1, 2, 3, 4, 5
PLAN_SCHEMA = "{key} {kind}, piece_no int, begin bigint, end bigint"


def _codes(*signs: str) -> np.ndarray:
    return np.array([ord(c) for s in signs for c in s], dtype=np.uint32)


_BLANK = _codes(" \t\n\r\f\v 　  ")
_STOPS, _WIDE_STOPS = _codes(".!?…"), _codes("。！？")
_PAUSES, _WIDE_PAUSES = _codes(",;:"), _codes("，；：、")
_CLOSERS = _codes("\"')]”’»")


def boundaries(left: str, body: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets in ``body`` before which one may cut, their strength)."""
    n, at = len(body), len(left)
    a = np.frombuffer((left + body + right).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    a = np.concatenate([np.full(4, 120, np.uint32), a, np.full(1, 120, np.uint32)])
    here = a[at + 4 : at + 4 + n]
    p1, p2, p3, p4 = (a[at + 4 - k : at + 4 - k + n] for k in (1, 2, 3, 4))
    blank, nl = np.isin(p1, _BLANK), p1 == 10
    starts = ~np.isin(here, _BLANK)
    strength = np.where(blank & starts, WORD, 0)
    before = np.where(np.isin(p2, _CLOSERS), p3, p2)
    strength = np.where((blank & starts & np.isin(before, _PAUSES)) | np.isin(p1, _WIDE_PAUSES), CLAUSE, strength)
    strength = np.where((blank & starts & np.isin(before, _STOPS)) | np.isin(p1, _WIDE_STOPS), SENTENCE, strength)
    strength = np.where(nl & (here != 10) & (here != 13), LINE, strength)
    double = nl & ((p2 == 10) | ((p2 == 13) & (p3 == 10)) | ((p2 == 13) & (p3 == 13) & (p4 == 10)))
    strength = np.where((double & (here != 10) & (here != 13)) | (p1 == 12), PARAGRAPH, strength)
    found = np.flatnonzero(strength)
    return found.astype(np.int32), strength[found].astype(np.int8)


def column_ranges(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, range_no, head, body, tail) of the non-null texts of a column."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, text in zip(pdf[key], pdf[content], strict=True):
                rows = []
                for no, at in enumerate(range(0, max(1, len(text)), RANGE)):
                    end = at + RANGE
                    rows.append((k, no, text[max(0, at - HALO) : at], text[at:end], text[end : end + HALO]))
                    if len(rows) == 512:
                        yield pd.DataFrame(rows, columns=[key, "range_no", "head", "body", "tail"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "range_no", "head", "body", "tail"])

    return df.where(F.col(content).isNotNull()).select(key, content).mapInPandas(run, f"{key} {kind}, range_no bigint, head string, body string, tail string")


def file_ranges(spark: SparkSession, files: DataFrame, key: str, path: str) -> DataFrame:
    """The same of UTF-8 files in a shared folder, of which each task reads byte ranges only.

    A character belongs to the range that holds its first byte; bytes that are no UTF-8 become the
    replacement character.
    """
    kind = files.schema[key].dataType.simpleString()

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(n_ranges=[max(1, -(-os.path.getsize(p) // RANGE)) for p in pdf[path]])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, p, no in zip(pdf[key], pdf[path], pdf["range_no"], strict=True):
                at = no * RANGE
                low = max(0, at - 4 * HALO)
                with open(p, "rb") as f:
                    f.seek(low)
                    got = f.read(at - low + RANGE + 4 * HALO)
                cut = [at - low, min(len(got), at - low + RANGE)]
                for i in (0, 1):
                    while cut[i] < len(got) and got[cut[i]] & 0xC0 == 0x80 and not (i == 0 and no == 0):
                        cut[i] += 1
                text = [x.decode("utf-8", "replace") for x in (got[: cut[0]], got[cut[0] : cut[1]], got[cut[1] :])]
                rows.append((k, no, text[0][-HALO:].lstrip("�"), text[1], text[2][:HALO].rstrip("�")))
            yield pd.DataFrame(rows, columns=[key, "range_no", "head", "body", "tail"])

    cuts = widen(files.select(key, path)).mapInPandas(sizes, f"{key} {kind}, {path} string, n_ranges bigint")
    cuts = cuts.select(key, path, F.explode(F.sequence(F.lit(0), F.col("n_ranges") - 1)).alias("range_no"))
    return cuts.repartition(spread(files), key, "range_no").mapInPandas(read, f"{key} {kind}, range_no bigint, head string, body string, tail string")


def boundary_table(ranges: DataFrame, key: str) -> DataFrame:
    """(key, range_no, n_chars, offsets, strengths), found range by range."""
    kind = ranges.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [boundaries(h, b, t) for h, b, t in zip(pdf["head"], pdf["body"], pdf["tail"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "range_no": pdf["range_no"], "n_chars": [len(b) for b in pdf["body"]], "offsets": [x[0] for x in got], "strengths": [x[1].tobytes() for x in got]})

    return ranges.mapInPandas(run, f"{key} {kind}, range_no bigint, n_chars int, offsets array<int>, strengths binary")


class _Scan:
    """Places cuts while the boundaries of one text go by in order."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap = size, max(0, min(overlap, size - 1))
        self.start = self.seen = 0
        self.done: list[tuple[int, int]] = []
        self.at = np.empty(0, np.int64)
        self.strength = np.empty(0, np.int8)

    def feed(self, n_chars: int, offsets: np.ndarray, strengths: np.ndarray) -> None:
        self.at = np.concatenate([self.at, offsets.astype(np.int64) + self.seen])
        self.strength = np.concatenate([self.strength, strengths])
        self.seen += n_chars
        while self.seen - self.start > self.size:
            self._cut()

    def _cut(self) -> None:
        s, limit = self.start, self.start + self.size
        lo, mid, hi = np.searchsorted(self.at, [s + self.overlap + 1, s + max(self.overlap + 1, self.size // 2), limit + 1])
        end = limit
        for a, b in ((mid, hi), (lo, mid)):
            if b > a:
                part = self.strength[a:b]
                end = int(self.at[a + np.flatnonzero(part == part.max())[-1]])
                break
        self.done.append((s, end))
        self.start = end - self.overlap
        keep = np.searchsorted(self.at, self.start + self.overlap + 1)
        self.at, self.strength = self.at[keep:], self.strength[keep:]

    def end(self) -> list[tuple[int, int]]:
        if self.seen > self.start or not self.done:
            self.done.append((self.start, self.seen))
        return self.done


def plan(ranges: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, piece_no, begin, end) in characters, for texts longer than their size.

    ``sizes`` holds (key, size, overlap), one row a text. The boundary rows of a text are sorted by
    range within a partition and scanned once; of a text, only the boundaries since its last cut
    are in memory.
    """
    kind = ranges.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, scan = None, None

        def rows(pieces: list[tuple[int, int]], first: int) -> list[tuple]:
            return [(current, first + i, b, e) for i, (b, e) in enumerate(pieces)]

        no = 1
        for pdf in batches:
            out: list[tuple] = []
            for k, n, off, strg, size, overlap in zip(pdf[key], pdf["n_chars"], pdf["offsets"], pdf["strengths"], pdf["size"], pdf["overlap"], strict=True):
                if k != current or scan is None:
                    if scan is not None:
                        out += rows(scan.end(), no)
                    current, scan, no = k, _Scan(int(size), int(overlap)), 1
                scan.feed(int(n), np.asarray(off), np.frombuffer(strg, np.int8))
                out += rows(scan.done, no)
                no += len(scan.done)
                if scan.done:
                    scan.done = []
            yield pd.DataFrame(out, columns=[key, "piece_no", "begin", "end"])
        if scan is not None and current is not None:
            yield pd.DataFrame(rows([(scan.start, scan.seen)] if scan.seen > scan.start else [], no), columns=[key, "piece_no", "begin", "end"])

    table = boundary_table(ranges, key).join(sizes.select(key, "size", "overlap"), key).where(F.col("size") > 0)
    table = table.repartition(spread(table), key).sortWithinPartitions(key, "range_no")
    return table.mapInPandas(run, PLAN_SCHEMA.format(key=key, kind=kind))


def emit(ranges: DataFrame, pieces: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(key, piece_no, begin, end, piece): the text of each piece, from the ranges it touches.

    ``lengths`` holds (key, range_no, from_char, n_chars), the running sum of range lengths.
    """
    body = ranges.select(key, "range_no", "body").join(lengths, [key, "range_no"])
    body = body.select(key, "from_char", "body", (F.col("from_char") + F.col("n_chars")).alias("to_char"), F.explode(F.sequence(F.floor(F.col("from_char") / RANGE), F.floor((F.col("from_char") + F.greatest(F.col("n_chars"), F.lit(1)) - 1) / RANGE))).alias("cell"))
    touched = pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / RANGE), F.floor((F.col("end") - 1) / RANGE))))
    a, b = F.greatest("begin", "from_char"), F.least("end", "to_char")
    in_cell = (F.floor(a / RANGE) == F.col("cell")) & (a < b)
    part = F.substring("body", (a - F.col("from_char") + 1).cast("int"), (b - a).cast("int"))
    return (
        touched.join(body, [key, "cell"])
        .where(in_cell)
        .groupBy(key, "piece_no", "begin", "end")
        .agg(F.array_sort(F.collect_list(F.struct(a.alias("at"), part.alias("part")))).alias("parts"))
        .select(key, "piece_no", "begin", "end", F.array_join("parts.part", "").alias("piece"))
    )


def prefix_lengths(table: DataFrame, key: str) -> DataFrame:
    """(key, range_no, from_char, n_chars): the running sum over the ranges of each text."""
    before = F.expr(f"sum(n_chars) over (partition by {key} order by range_no rows between unbounded preceding and 1 preceding)")
    return table.select(key, "range_no", F.coalesce(before, F.lit(0)).alias("from_char"), "n_chars")


def size_in_force(config: str = "reader_config", size: str = "chunk_size") -> Column:
    """``chunk_size``, else ``chunk_chars`` at the top level of the settings, else 5000."""
    set_to = F.get_json_object(config, "$.chunk_chars").try_cast("double").cast("int")
    return F.coalesce(F.col(size), F.when(set_to >= 0, set_to), F.lit(DEFAULT_SIZE))


def overlap_in_force(config: str = "reader_config", overlap: str = "chunk_overlap") -> Column:
    set_to = F.get_json_object(config, "$.overlap").try_cast("double").cast("int")
    return F.coalesce(F.col(overlap), F.when(set_to >= 0, set_to), F.lit(DEFAULT_OVERLAP))


def _oversized(texts: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    own = texts.select(F.col(key), F.col(content), size_in_force().alias("size"), overlap_in_force().alias("overlap"))
    own = own.where((F.col("size") > 0) & (F.length(content) > F.col("size")))
    return own, own.select(key, "size", "overlap")


def plan_texts(texts: DataFrame, key: str = "text_id", content: str = "content") -> DataFrame:
    """The cuts of the texts that are too long for their settings.

    Null and empty texts, those within the size and those of size 0 are left whole and give no
    row. An overlap of the size or more is lowered to one character less than the size. ``key``
    must be unique; extra columns are not read.
    """
    own, sizes = _oversized(texts, key, content)
    return plan(column_ranges(widen(own), key, content), sizes, key)


def split_texts(texts: DataFrame, key: str = "text_id", content: str = "content") -> DataFrame:
    """(key, piece_no, begin, end, piece) of the same texts."""
    own, sizes = _oversized(texts, key, content)
    ranges = column_ranges(widen(own), key, content)
    lengths = prefix_lengths(ranges.select(key, "range_no", F.length("body").alias("n_chars")), key)
    return emit(ranges, plan(ranges, sizes, key), lengths, key)

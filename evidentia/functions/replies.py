"""Reading of model replies: scores and JSON that is nearly right."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from evidentia.functions.text import _col


MENTION = r"((?:[sS]core(?:[\s:]|is)+|\()?[0-9]+[a-zA-Z_]*/?)"  # a number with its label, bracket or slash


def score_of(c: str | Column) -> Column:
    """A score of 0 to 10 in a reply; null where there is none.

    A reply is read as a row of numbers, each with what stands around it. The first number after a
    label "score" counts, else the first single digit of a bracketed fraction, else the first of any
    fraction, else the last number within the last fifteen characters. "Not applicable" counts 0,
    and a score beyond ten is out of a hundred.
    """
    t = _col(c)
    low = F.lower(t)
    none = F.substring_index(low, "\n", -1).contains("n/a") | low.contains("not applicable") | low.contains("not relevant")
    rank = lambda m: F.when(F.lower(m).startswith("score"), 0).when(m.rlike(r"^\([0-9][a-zA-Z_]*/"), 1).when(m.endswith("/"), 2)
    ranked = F.transform(F.regexp_extract_all(t, F.lit(MENTION), F.lit(1)), lambda m, i: F.struct(rank(m).alias("rank"), i.alias("place"), F.regexp_extract(m, "([0-9]+)", 1).alias("n")))
    first = F.array_min(F.filter(ranked, lambda m: m["rank"].isNotNull()))["n"]
    n = F.coalesce(first, F.try_element_at(F.regexp_extract_all(F.right(t, F.lit(15)), F.lit("([0-9]+)"), F.lit(1)), F.lit(-1))).try_cast("int")
    return F.when(none, F.lit(0)).otherwise(F.when(n > 10, F.floor(n / 10).cast("int")).otherwise(n))


REPLY = StructType([StructField("summary", StringType()), StructField("relevance_score", IntegerType()), StructField("extras", MapType(StringType(), StringType()))])
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}
_NEXT_KEY = re.compile(r'[\s,]*"[^"\n]{1,60}"\s*:')
_FRACTION = re.compile(r"\s*(\d+(?:\.\d+)?)\s*/\s*(\d+)\s*")


class _Fields:
    """Reads "key": value pairs from an object that may not be valid JSON."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def __iter__(self) -> Iterator[tuple[str, object]]:
        while True:
            start = self.text.find('"', self.at)
            colon = self.text.find(":", start + 1) if start >= 0 else -1
            if colon < 0:
                return
            key = self.text[start + 1 : colon].strip().removesuffix('"')
            self.at = colon + 1
            while self.text[self.at : self.at + 1].isspace():
                self.at += 1
            yield key, self._value()

    def _value(self) -> object:
        if self.text[self.at : self.at + 1] == '"':
            self.at += 1
            return self._string()
        begin = self.at
        try:
            got, end = json.JSONDecoder().raw_decode(self.text, begin)
            if self.text[end:].lstrip()[:1] != "/":
                self.at = end
                return got
        except ValueError:
            pass
        end = begin
        while end < len(self.text) and self.text[end] not in ",}\n":
            end += 1
        self.at = end
        return self.text[begin:end].strip()

    def _string(self) -> str:
        """Up to the quote that ends the value; quotes that nothing of the object follows are its own."""
        out: list[str] = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                after = self.text[self.at]
                if after == "u" and re.match(r"u[0-9a-fA-F]{4}", self.text[self.at :]):
                    out.append(chr(int(self.text[self.at + 1 : self.at + 5], 16)))
                    self.at += 5
                    continue
                out.append(_ESCAPES.get(after, c + after))
                self.at += 1
            elif c == '"' and (not self.text[self.at :].strip(" \t\r\n,}") or _NEXT_KEY.match(self.text, self.at)):
                break
            else:
                out.append(c)
        return "".join(out)


def _as_score(value: object) -> int | None:
    """A whole score; a fraction counts as so many tenths."""
    m = _FRACTION.fullmatch(value) if isinstance(value, str) else None
    if m:
        return round(float(m.group(1)) / float(m.group(2)) * 10) if float(m.group(2)) else 0
    try:
        return round(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def parse_reply(text: str | None) -> dict | None:
    """A reply as a record, or None for null and for an object without a readable field.

    Thoughts are left out and a reply without braces is a summary. Between the outermost braces a
    scanner takes one key and one value after the other, so missing and spare commas, line breaks,
    stray backslashes, unescaped quotes and what stands around the object do no harm. A key with
    "relevance" or "score" in it is the score, a whole number.
    """
    if text is None:
        return None
    body = text.rpartition("</think>")[2] if "<think>" in text else text
    start, end = body.find("{"), body.rfind("}")
    if start < 0 and end < 0:
        return {"summary": body.strip()}
    out: dict = {}
    for key, value in _Fields(body[start + 1 : end if end > start else len(body)]):
        if "relevance" in key.lower() or "score" in key.lower():
            out["relevance_score"] = _as_score(value)
        else:
            out[key] = value
    return out or None


@F.pandas_udf(REPLY)
def reply(s: pd.Series) -> pd.DataFrame:
    got = [parse_reply(t) or {} for t in s]
    extras = [{k: v if isinstance(v, str) else json.dumps(v) for k, v in g.items() if k not in ("summary", "relevance_score")} for g in got]
    return pd.DataFrame({"summary": [None if g.get("summary") is None else str(g["summary"]) for g in got], "relevance_score": pd.array([g.get("relevance_score") for g in got], dtype="Int32"), "extras": extras})


def structured_citation(c: str | Column) -> Column:
    """The JSON object between the first opening and the next closing brace, as title, DOI and authors."""
    body = F.regexp_extract(_col(c), r"(?s)(\{[^}]*\})", 1)
    return F.from_json(body, "title string, doi string, authors array<string>", {"mode": "PERMISSIVE"})

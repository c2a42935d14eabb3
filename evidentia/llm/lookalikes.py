"""One plain form for texts that look alike.

Marks, widths, spaces, hyphens, invisible characters and ligatures have one plain form each. For
look-alike letters the script decides: a token mixed of scripts is rewritten in its dominant
script, and a token wholly of look-alikes in the script of its text, where the rewritten token
occurs in the vocabulary of the whole corpus. New names occur once and can be in no vocabulary of
words, so the vocabulary also holds the parts of its words (three letters each): a rewritten token
of which every part is known counts as occurring. A part is known if it makes at least one in
``PART_SHARE`` of the parts of all different words, so the test stays one in a corpus of any size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import cut, widen

PART_SHARE = 1_000_000

# Letters that look like Latin ones, by script.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХԌԚԜҮаеѕіјорсухԁһӏԛԝүҽ", "ABESIJKMHOPCTYXGQWYaesijopcyxdhlqwye", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρυχικϲϳ", "ABEZHIKMNOPTYXovpuxikcj", strict=True))
TO_LATIN = {**CYRILLIC, **GREEK}
TO_CYRILLIC = {"A": "А", "B": "В", "E": "Е", "K": "К", "M": "М", "H": "Н", "O": "О", "P": "Р", "C": "С", "T": "Т", "Y": "У", "X": "Х", "a": "а", "e": "е", "o": "о", "p": "р", "c": "с", "y": "у", "x": "х", "Ο": "О", "ο": "о", "Α": "А", "Β": "В", "Ε": "Е", "Κ": "К", "Μ": "М", "Η": "Н", "Ρ": "Р", "Τ": "Т", "Χ": "Х"}
TO_GREEK = {v: k for k, v in GREEK.items() if v not in "ikux"} | {c: g for c, g in (("А", "Α"), ("В", "Β"), ("Е", "Ε"), ("К", "Κ"), ("М", "Μ"), ("Н", "Η"), ("О", "Ο"), ("Р", "Ρ"), ("Т", "Τ"), ("Х", "Χ"), ("о", "ο"))}

_JOINED = re.compile(r"[؀-ࣿऀ-෿က-႟ក-៿]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​‎‏‪-‮⁠-⁤⁦-⁯﻿︀-️]")
_JOINERS = re.compile("[‌‍]")
_SPACES = re.compile("[   -   　]")
_HYPHENS = re.compile("[‐‑﹣]")
_WIDE = re.compile("[！-～￠-￦｡-ﾟ]+")
_LIGATURES = re.compile("[ﬀ-ﬆǄ-ǌĲĳ]")
WORD = re.compile(r"[^\W\d_]+")


def _styled() -> dict[str, str]:
    """Styled letters (bold, script, black-letter, double-struck, circled, small capitals) by rule.

    Compatibility gives the letter of all but small capitals, whose Unicode names hold it.
    """
    out = {}
    for first, last in ((0x1D00, 0x1D22), (0x2102, 0x2138), (0x24B6, 0x24E9), (0x1D400, 0x1D6A5)):
        for c in map(chr, range(first, last + 1)):
            name, plain = unicodedata.name(c, ""), unicodedata.normalize("NFKC", c)
            if name.startswith("LATIN LETTER SMALL CAPITAL ") and len(name) == 28:
                out[c] = name[-1].lower()
            elif len(plain) == 1 and plain.isascii() and plain.isalpha() and c not in "KÅ":
                out[c] = plain
    return out


STYLED = _styled()
_LETTER = rf"(?:[^\W\d_]|[{''.join(STYLED)}])"
#: a styled letter alone is a symbol; beside another letter it is part of a word
_STYLED = re.compile(rf"(?<={_LETTER})[{''.join(STYLED)}]|[{''.join(STYLED)}](?={_LETTER})")


def base_form(text: str) -> str:
    """Composed, of ordinary width, spaces and hyphens and plain letters, without invisible
    characters and ligatures."""
    if text.isascii():
        return text
    s = _INVISIBLE.sub("", text)
    if not _JOINED.search(s):
        s = _JOINERS.sub("", s)
    s = _SPACES.sub(" ", _HYPHENS.sub("-", s))
    s = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    s = _LIGATURES.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    return unicodedata.normalize("NFC", _STYLED.sub(lambda m: STYLED[m.group()], s))


def script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "Latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    if 0x400 <= o < 0x530:
        return "Cyrillic"
    return "other"


_TO = {"Latin": TO_LATIN, "Cyrillic": TO_CYRILLIC, "Greek": TO_GREEK}


def rewritings(text: str) -> list[tuple[str, str]]:
    """(token, token in letters of one script) of the suspicious tokens of a base form."""
    if text.isascii():
        return []
    whole: dict[str, int] = {}
    tokens = []
    for m in WORD.finditer(text):
        scripts: dict[str, int] = {}
        for c in m.group():
            s = script(c)
            # only letters without a twin in another script tell the script for sure
            sure = not any(c in t for t in _TO.values())
            scripts[s] = scripts.get(s, 0) + (100 if sure else 1)
        tokens.append((m, scripts))
        for s, n in scripts.items():
            whole[s] = whole.get(s, 0) + n
    if len(whole) < 2:
        return []
    ruling = max(whole, key=whole.get)
    out = []
    for m, scripts in tokens:
        token = m.group()
        if len(scripts) > 1:
            target = max(scripts, key=lambda s: (scripts[s], s == ruling))
        elif ruling not in scripts:
            target = ruling
        else:
            continue
        table = _TO.get(target)
        if table is None:
            continue
        new = "".join(table.get(c, c) if script(c) != target else c for c in token)
        if new == token or any(script(c) != target for c in new):
            continue
        if len(token) == 1 and script(token) == "Greek":
            # a lone Greek letter is a symbol, unless its compound is known in the other script
            rest = re.match(r"-\w+", text[m.end() :])
            if rest is None and (text[m.end() : m.end() + 1] not in ("", " ") or text[m.start() - 1 : m.start()] not in ("", " ")):
                continue
            if rest is not None:
                token, new = token + rest.group(), new + rest.group()
        out.append((token, new))
    return out


_ITEM = "array<struct<token:string,written:string>>"


def _items(records: DataFrame, key: str, title: str, authors: str) -> DataFrame:
    one = F.struct(F.lit("title").alias("field_name"), F.lit(0).alias("pos"), F.col(title).alias("text"))
    many = F.transform(F.coalesce(F.col(authors), F.array().cast("array<string>")), lambda a, i: F.struct(F.lit("authors").alias("field_name"), i.cast("int").alias("pos"), a.alias("text")))
    return records.select(key, F.explode(F.concat(F.array(one), many)).alias("_i")).select(key, "_i.*").where("text is not null")


def vocabulary(items: DataFrame) -> DataFrame:
    """(written): the distinct words of all texts in lower case, and compounds with a lone letter."""
    low = F.lower(F.regexp_replace("text", r"\p{Cf}", ""))
    words = F.split(low, r"[^\p{L}\p{M}]+")
    compounds = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{M}])(\p{L}-[\p{L}\p{N}]+)"), F.lit(1))
    return items.select(F.explode(F.concat(words, compounds)).alias("written")).where("written <> ''").distinct()


def known_writings(items: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (written) that occur in the corpus, as words or by all their parts."""
    words = cut(vocabulary(items))
    whole = words.join(asked, "written", "left_semi")
    parts = F.expr("transform(sequence(1, length(written) - 2), i -> substring(written, i, 3))")
    counted = cut(words.where("length(written) >= 3").select(F.explode(parts).alias("part")).groupBy("part").agg(F.count("*").alias("n")))
    grams = counted.where(F.col("n") >= max(1, (counted.agg(F.sum("n")).first()[0] or 0) // PART_SHARE)).select("part")
    rest = asked.where(r"written rlike '^[^-]{3,}$'").join(whole, "written", "left_anti")
    split = rest.select("written", F.explode(F.array_distinct(parts)).alias("part"), F.size(F.array_distinct(parts)).alias("n"))
    new = split.join(grams, "part").groupBy("written", "n").count().where("count = n").select("written")
    return whole.unionByName(new)


def plain_items(records: DataFrame, key: str = "record_id", title: str = "title", authors: str = "authors") -> DataFrame:
    """(key, field_name, pos, text, plain) of every title and author that is not pure ASCII.

    ASCII texts are plain already and give no row. A token in look-alikes is rewritten only where
    the result occurs in the corpus. Null fields and elements give no row; ties of scripts go to
    the script of the whole text; repeated rows give repeated rows.
    """
    kind = records.schema[key].dataType.simpleString()
    items = _items(records, key, title, authors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            base = [base_form(t) for t in pdf["text"]]
            yield pdf.assign(base=base, pairs=[[{"token": a, "written": b} for a, b in rewritings(t)] for t in base])

    odd = items.where(F.col("text").rlike(r"[^\x00-\x7F]"))
    # written once, as three readers follow
    based = cut(widen(odd).mapInPandas(run, f"{key} {kind}, field_name string, pos int, text string, base string, pairs {_ITEM}"))
    plain = based.where("size(pairs) = 0").select(key, "field_name", "pos", "text", F.col("base").alias("plain"))
    mixed = based.where("size(pairs) > 0").select(F.xxhash64("base").alias("h"), key, "field_name", "pos", "text", "base", "pairs")
    asked = mixed.select("h", F.explode("pairs").alias("p")).select("h", "p.token", "p.written", F.lower("p.written").alias("low")).distinct()
    known = known_writings(items, asked.select(F.col("low").alias("written")).distinct())
    kept = asked.join(known.withColumnRenamed("written", "low"), "low").groupBy("h").agg(F.collect_set(F.struct("token", "written")).alias("kept"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for base, pairs in zip(pdf["base"], pdf["kept"], strict=True):
                for p in sorted(pairs if pairs is not None else [], key=lambda p: -len(p["token"])):
                    base = re.sub(rf"(?<![^\W\d_]){re.escape(p['token'])}(?![^\W\d_])", p["written"], base)
                out.append(base)
            yield pdf.drop(columns=["base", "kept"]).assign(plain=out)

    done = mixed.join(kept, "h", "left").select(key, "field_name", "pos", "text", "base", "kept")
    done = done.mapInPandas(rewrite, f"{key} {kind}, field_name string, pos int, text string, plain string")
    return plain.unionByName(done)


def found(records: DataFrame) -> DataFrame:
    """(record_id, field_name) of the fields with a text that is not in its plain form."""
    return plain_items(records).where("text <> plain").select("record_id", "field_name").distinct()

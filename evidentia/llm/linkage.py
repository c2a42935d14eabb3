"""Matching works of two sources without a key: probabilistic record linkage.

Equal records are one class. Several blocking passes propose pairs of classes; each pair is
compared by agreement levels of its titles, markers, authors and years; expectation-maximisation
over the counts of level patterns learns how often each level occurs among matches and among
others; the posterior of its pattern is a pair's confidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.names import folded, forms
from evidentia.session import cut, drop_cut, widen

COMMON_SHARE = 20_000  # a word is common in at least one of so many records: at most so many times
#                        the words of a title can be, which bounds the list of common words
FEW = (12, 2_000, 40)  # and in 12 at least, or, up to 40, one of 2 000: a name that few works have is not
LEVELS = ("rare", "text", "marker", "who", "year")
SAMPLE = 16  # hot keys are told by the classes of one in so many
HOT = 2_000  # classes of one key that are joined in one go; more are dealt into blocks of so many
IN_FLIGHT = 6  # pairs a class that are compared in one go; their texts are on disk meanwhile
RULED_OUT = 0.001  # pairs of a first guess below wait as counts only; if learning disagrees, they are compared again
MIN_CONFIDENCE = 0.5

_CORRECTION = re.compile(r"^\W*(?:correction|corrigendum|erratum|retraction|retracted|comment|reply)s?\b(?:\s+(?:to|of|on|for))?\W*")
_PART = re.compile(r"\W*\bpart\s+(i{1,3}|iv|v|[0-9]+|one|two|three|four)\b\W*$")
_PARTS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "one": "1", "two": "2", "three": "3", "four": "4"}
_WORDS = re.compile(r"[^\W_]+")
_SIGNS = "-‐‑–—:;,.!?()[]/'’‘“”\"\t\n\r\u00a0"  # between words
_CUT = re.compile(r"(?:\.\.\.|…)\s*\W*$")


def title_parts(title: str | None) -> tuple[str, list[str], bool, int]:
    """(marker, words, whether cut short, words before a colon) of a title in folded lower case."""
    low = folded((title or "").lower())
    was_cut = ("..." in low or "…" in low) and bool(_CUT.search(low))
    if was_cut:
        low = _CUT.sub("", low)
    marker = ""
    m = _CORRECTION.match(low)
    if m:
        marker, low = "c", low[m.end() :]
    m = _PART.search(low) if "part" in low else None
    if m:
        marker, low = marker + _PARTS.get(m.group(1), m.group(1)), low[: m.start()]
    main, _, rest = low.partition(":")
    words = _WORDS.findall(low)
    return marker, words, was_cut, len(_WORDS.findall(main)) if rest else len(words)


@lru_cache(200_000)
def _name_words(author: str) -> tuple[str | None, tuple[str, ...]]:
    """(likely surname, words of the name) of one author."""
    got = forms(author)
    return (got[0][3] if got else None), tuple(w for g in got for w in (g[0], g[3]) if len(w) > 2)


def surnames(authors: list[str] | None) -> tuple[list[str], list[str]]:
    """(likely surnames, all words of the names)."""
    likely, words = set(), set()
    for a in authors if authors is not None else ():
        if a:
            one, all_of = _name_words(a)
            if one is not None:
                likely.add(one)
            words.update(all_of)
    return sorted(likely), sorted(words)


def features(df: DataFrame, key: str, common: frozenset[str]) -> DataFrame:
    """One row per record: its class of equal records, and what the class is compared by.

    ``rare`` are the title's words outside ``common``, ``frame`` those of its main title within.
    """
    kind = df.schema[key].dataType.simpleString()
    sent = df.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = sent.value
        for pdf in batches:
            rows = []
            for k, t, a, y in zip(pdf[key], pdf["title"], pdf["authors"], pdf["year"], strict=True):
                marker, words, was_cut, n_main = title_parts(t)
                likely, names = surnames(a)
                if words or len(likely) > 1:
                    rare = list(dict.fromkeys(w for w in words if w not in common))
                    frame = " ".join(w for w in words[: max(1, n_main)] if w in common)
                    rows.append((k, marker, was_cut, rare, frame, words[0] if words else None, " ".join(words), likely, names, y))
            yield pd.DataFrame(rows, columns=[key, "marker", "was_cut", "rare", "frame", "lead", "text", "likely", "names", "year"]).astype({"year": "Int32"})

    schema = f"{key} {kind}, marker string, was_cut boolean, rare array<string>, frame string, lead string, text string, likely array<string>, names array<string>, year int"
    own = widen(df.select(key, "title", "authors", F.col("pub_year").cast("int").alias("year"))).mapInPandas(run, schema)
    return own.withColumn("class", F.xxhash64("marker", "text", "was_cut", "frame", "likely", "names", "year"))


def _common_from(n: int) -> int:
    """In how many of ``n`` records a word is common.

    What a few works are about has about as many records whatever the size, but a phrase of a language
    without blanks has its share of the records, and as a rare word would propose pairs by the square.
    """
    least, share, most = FEW
    return max(least, min(n // share, most), n // COMMON_SHARE)


def common_words(*sides: DataFrame) -> frozenset[str]:
    """The title words in at least one of ``COMMON_SHARE`` records, folded.

    Their number is at most ``COMMON_SHARE`` times the words of a title, whatever the number of
    records.
    """
    words = None
    for s in sides:
        plain = F.translate(F.lower("title"), _SIGNS, " " * len(_SIGNS))
        one = s.select(F.explode(F.array_distinct(F.split(plain, " "))).alias("word"))
        words = one if words is None else words.unionAll(one)
    n = sum(s.count() for s in sides)
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= _common_from(n))
    return frozenset(w for r in counts.collect() for w in _WORDS.findall(folded(r["word"])))


def _classes(rows: DataFrame) -> DataFrame:
    one = rows.dropDuplicates(["class"]).select("class", "marker", "was_cut", "rare", "frame", "lead", "text", "likely", "names", "year")
    return one.withColumn("compact", F.replace("text", F.lit(" "), F.lit("")))


def _keys(c: DataFrame, right: bool) -> DataFrame:
    """Blocking keys of a class, of all passes: (class, key).

    First passes: each rare word; either end of the longest one with the frame; a name with year
    and frame; the whole title where no word is rare. Later passes need neither rare words nor the
    frame: all letters of the title; two surnames with the year; both ends of the title's letters,
    each with every name, or with the year where one side has no name. One misread word, a moved
    blank or a cut leaves one end whole; short titles give shorter ends. The lowest bit of a key
    is 1 for the first passes, which the levels are learned from.
    """
    titled, none, no_key = F.col("text") != "", F.array().cast("array<string>"), F.array().cast("array<bigint>")
    own = "names" if right else "likely"
    n = F.length("compact")
    ends = []
    for k, given in ((20, n >= 20), (12, (n >= 12) & (n < 45)), (7, (n >= 7) & (n < 27))):
        for side, letters in (("p", F.substring("compact", 1, k)), ("q", F.substring(F.reverse("compact"), 1, k))):
            ends.append(F.when(given, F.xxhash64(F.lit(f"{side}{k}"), letters)))
    years = F.when(F.col("year").isNotNull(), F.array(*[F.col("year") + k for k in ((-1, 0, 1) if right else (0,))])).otherwise(F.array().cast("array<int>"))
    # a class without names meets the ends of all others by the year: left ones under l, right ones under r
    mine, others = ("r", "l") if right else ("l", "r")
    duo = "flatten(transform(likely, (x, i) -> transform(slice(likely, i + 2, size(likely)), y -> xxhash64('d', x, y))))"
    # columns of their own, so that each is computed once
    c = c.select(
        "class", "rare", "text", "frame", "year", "compact", own, years.alias("years"),
        F.array_compact(F.array(*ends)).alias("ends"),
        F.array_max(F.transform("rare", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"].alias("longest"),
        F.expr(duo).alias("duo"),
    )
    tagged = lambda tag: F.transform("years", lambda y: F.xxhash64(F.lit(tag), y))
    heads = F.concat(F.transform(own, lambda x: F.xxhash64(F.lit("n"), x)), tagged(others), F.when(F.size(own) == 0, tagged(mine)).otherwise(no_key))
    c = c.withColumn("heads", heads)
    by_start = F.array(F.concat_ws("|", F.lit("s"), F.substring("longest", 1, 4), "frame"), F.concat_ws("|", F.lit("e"), F.substring(F.reverse("longest"), 1, 5), "frame"))
    by_name = F.transform(own, lambda x: F.concat_ws("|", F.lit("n"), x, F.col("year").cast("string"), "frame"))
    first = F.concat(
        F.transform("rare", lambda w: F.concat(F.lit("w|"), w)),
        F.when(F.size("rare") > 0, by_start).otherwise(none),
        F.when(F.col("year").isNotNull() & titled, by_name).otherwise(none),
        F.when(titled & (F.size("rare") == 0), F.array(F.concat(F.lit("t|"), "text"))).otherwise(none),
    )
    later = F.concat(
        F.when(titled, F.array(F.xxhash64(F.lit("c"), "compact"))).otherwise(no_key),
        F.flatten(F.transform("duo", lambda d: F.transform("years", lambda y: F.xxhash64(d, y)))),
        F.flatten(F.transform("ends", lambda e: F.transform("heads", lambda h: F.xxhash64(h, e)))),
    )
    keys = F.concat(
        F.transform(first, lambda k: F.shiftleft(F.xxhash64(k), 1).bitwiseOR(F.lit(1))),
        F.transform(later, lambda k: F.shiftleft(k, 1)),
    )
    # classes are distinct rows; a key that two ways of one class share is proposed twice at most
    return c.select("class", F.explode(keys).alias("key"))


def _met(ca: DataFrame, cb: DataFrame) -> DataFrame:
    """(first, a, b): for each key that both sides have, whether it is of the first passes, and the
    classes of either side. Keys of one side only, most of them, end here.

    A key of about more than ``HOT`` classes, judged by a sample, is dealt out: each side into
    blocks, every block of one side met by every block of the other, so that no row holds all of
    its classes. No pair is left out, whatever the sample says.
    """
    ka, kb = _keys(ca, False), _keys(cb, True)
    sampled = lambda c, right: _keys(c.where(F.pmod("class", F.lit(SAMPLE)) == 0), right)
    sides = sampled(ca, False).select("key", F.lit(SAMPLE).alias("a"), F.lit(0).alias("b")).unionByName(sampled(cb, True).select("key", F.lit(0).alias("a"), F.lit(SAMPLE).alias("b")))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.sum(n) / HOT)).cast("int")
    hot = cut(sides.groupBy("key").agg(blocks("a").alias("blocks"), blocks("b").alias("blocks_b"), F.sum(F.col("a") + F.col("b")).alias("n")).where(F.col("n") > HOT).drop("n"), tidy=True)
    if not hot.isEmpty():
        # at most one in HOT of all keys; a block of a key is a key of its own with the same lowest bit
        of_block = lambda k, own, other, ij: k.join(F.broadcast(hot), "key", "left").select(
            "class", "key", F.col(own).alias("own"), F.explode(F.expr(f"sequence(0, coalesce({other}, 1) - 1)")).alias("met")
        ).select("class", F.when(F.col("own").isNull(), F.col("key")).otherwise(F.shiftleft(F.xxhash64("key", *[{"own": F.expr("pmod(class, own)").cast("int"), "met": F.col("met")}[x] for x in ij]), 1).bitwiseOR(F.col("key").bitwiseAND(F.lit(1)))).alias("key"))
        ka, kb = of_block(ka, "blocks", "blocks_b", ("own", "met")), of_block(kb, "blocks_b", "blocks", ("met", "own"))
    both = ka.select("key", "class", F.lit(False).alias("right")).unionByName(kb.select("key", "class", F.lit(True).alias("right")))
    return both.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped, "first int, a array<bigint>, b array<bigint>")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, class, right) in order of their keys as a row for each key that both sides have."""

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, of_class, right = rows
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        n = [np.bincount(group[side], minlength=group[-1] + 1) for side in (~right, right)]
        kept = (n[0] > 0) & (n[1] > 0)
        lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k[kept])], pa.int32()), pa.array(of_class[side & kept[group]])) for k, side in zip(n, (~right, right), strict=True)]
        first = key[np.r_[True, key[1:] != key[:-1]]][kept] & 1
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), *lists], names=["first", "a", "b"])

    held = None  # rows of the key that a batch ends with, which the next may go on with
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if len(rows[0]):
            ends = np.searchsorted(rows[0], rows[0][-1])
            if ends:
                yield of([x[:ends] for x in rows])
            held = [x[ends:] for x in rows]
    if held is not None and len(held[0]):
        yield of(held)


def _pairs(met: DataFrame, slices: int = 1, n: int = 0) -> DataFrame:
    """(class, class_b, first): the distinct pairs of classes that share a key, and whether one of
    the first passes; of the right classes only the ``n``-th of so many slices."""
    one = met.select("first", "a", F.explode("b").alias("class_b"))
    one = one.where(F.pmod("class_b", F.lit(slices)) == n) if slices > 1 else one
    return one.select("first", "class_b", F.explode("a").alias("class")).groupBy("class", "class_b").agg(F.max("first").alias("first"))


def _propose(ca: DataFrame, cb: DataFrame) -> DataFrame:
    return _pairs(_met(ca, cb))


def _packed(c: DataFrame) -> DataFrame:
    """Only what is compared travels with the pairs, lists as one string and names as hashes."""
    return c.select("class", "marker", "was_cut", "text", F.array_join("rare", " ").alias("rare"), F.array_join("likely", "|").alias("likely"), F.transform("names", lambda x: F.hash(x)).alias("names"), "year")


def _unpacked(met: DataFrame, side: str) -> DataFrame:
    parts = lambda c, sign: F.when(F.col(c + side) == "", F.array().cast("array<string>")).otherwise(F.split(c + side, sign))
    lists = {"rare" + side: parts("rare", " "), "likely" + side: parts("likely", r"\|")}
    return met.withColumns({**lists, "lead" + side: F.substring_index("text" + side, " ", 1), "compact" + side: F.replace("text" + side, F.lit(" "), F.lit(""))})


def _untitled() -> Column:
    return (F.col("compact") == "") | (F.col("compact_b") == "")


def _other_title() -> Column:
    """Titles with different markers (a correction, another part) are different titles."""
    return _marker_level() == 0


def _rare_level() -> Column:
    """Agreement of the rare words: 0 differ, 1 follow-up (one leads with a new word), 2 one lacks
    a word, 3 a misspelling, 4 the same, 5 no title, 6 another title by its marker, 7 only one title has any."""
    a, b = F.col("only"), F.col("only_b")
    shared = F.size(a) < F.size("rare")
    typo = (F.size(a) == 1) & (F.size(b) == 1) & (F.levenshtein(F.get(a, F.lit(0)), F.get(b, F.lit(0)), 2) >= 0)
    leads = ((F.size(a) == 1) & (F.size(b) == 0) & (F.get(a, F.lit(0)) == F.col("lead")) & (F.size("rare_b") > 0)) | ((F.size(b) == 1) & (F.size(a) == 0) & (F.get(b, F.lit(0)) == F.col("lead_b")) & shared)
    leads = leads & (F.levenshtein("lead", "lead_b", 2) < 0)  # a misspelling of the other's first word is no new one
    lacks = ((F.size(a) == 0) | (F.size(b) == 0)) & (F.size(a) + F.size(b) <= 2)
    return F.when(_untitled(), 5).when(_other_title(), 6).when((F.size(a) == 0) & (F.size(b) == 0), 4).when(typo, 3).when(leads, 1).when((F.size("rare") == 0) | (F.size("rare_b") == 0), 7).when(lacks, 2).otherwise(0)


def _text_level() -> Column:
    """0 unlike, 1 a part, 2 close, 3 the same but for spaces, 4 no title, 5 another title, however
    many letters it shares: a correction's, another part's or a follow-up's."""
    a, b = F.col("compact"), F.col("compact_b")
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    # edits are counted as far as the limit and are -1 beyond
    within = lambda x, y, most: F.call_function("levenshtein", x, y, F.floor(most).cast("int")) >= 0
    head, head_b = F.substring(a, F.lit(1), short), F.substring(b, F.lit(1), short)
    most = F.floor(F.greatest(F.lit(2), long * 0.12))
    return (
        F.when(_untitled(), 4)
        .when(_other_title() | (F.col("rare_level") == 1), 5)
        .when(a == b, 3)
        .when((long - short <= most) & within(a, b, most), 2)
        .when((short >= 15) & within(head, head_b, short * 0.08 + 1), 1)
        .otherwise(0)
    )


def _marker_level() -> Column:
    """0 differ, 1 cannot tell (a title cut short, or none), 2 the same."""
    return F.when(_untitled(), 1).when(F.col("marker") == F.col("marker_b"), 2).when((F.col("was_cut") | F.col("was_cut_b")) & (F.substring("marker", 1, 1).eqNullSafe("c") == F.substring("marker_b", 1, 1).eqNullSafe("c")), 1).otherwise(0)


def _who_level() -> Column:
    """0 nobody shared, 1 unknown, 2 near, 3 some, 4 all of the shorter list, 5 and three or more."""
    n = F.least(F.size("likely"), F.size("likely_b"))
    known = lambda own, other: F.size(F.filter(own, lambda x: F.array_contains(other, F.hash(x))))
    m = F.greatest(known("likely", "names_b"), known("likely_b", "names"))
    near = F.exists("likely", lambda x: F.exists("likely_b", lambda y: F.levenshtein(x, y, 2) >= 0))
    return F.when(n == 0, 1).when((m >= n) & (n >= 3), 5).when(m >= n, 4).when(m > 0, 3).when(near, 2).otherwise(0)


def _year_level() -> Column:
    """0 further, 1 unknown, 2 two apart, 3 one apart, 4 the same."""
    d = F.abs(F.col("year") - F.col("year_b"))
    return F.when(d.isNull(), 1).when(d == 0, 4).when(d == 1, 3).when(d == 2, 2).otherwise(0)


# Where the learning starts, as chances of each level among matches and others.
_START = {
    "rare": ([0.01, 0.005, 0.05, 0.10, 0.79, 0.02, 0.005, 0.02], [0.50, 0.05, 0.10, 0.05, 0.13, 0.02, 0.05, 0.10]),
    "text": ([0.03, 0.07, 0.20, 0.675, 0.02, 0.005], [0.65, 0.05, 0.09, 0.09, 0.02, 0.10]),
    "marker": ([0.01, 0.04, 0.95], [0.30, 0.05, 0.65]),
    "who": ([0.02, 0.12, 0.05, 0.06, 0.40, 0.35], [0.60, 0.12, 0.03, 0.15, 0.08, 0.02]),
    "year": ([0.02, 0.10, 0.03, 0.10, 0.75], [0.70, 0.10, 0.05, 0.05, 0.10]),
}


def learn(patterns: pd.DataFrame, rounds: int = 40) -> pd.DataFrame:
    """``patterns`` (a column per level, n) with ``confidence``, by expectation-maximisation.

    The fields count as independent given match or not; each step keeps a little of the start, so
    that a level never seen keeps a chance.
    """
    m = {f: np.array(_START[f][0]) for f in LEVELS}
    u = {f: np.array(_START[f][1]) for f in LEVELS}
    n = patterns["n"].to_numpy(float)
    share, post = 0.2, np.zeros(len(n))
    for _ in range(rounds):
        a = np.log(share) + sum(np.log(m[f][patterns[f]]) for f in LEVELS)
        b = np.log(1 - share) + sum(np.log(u[f][patterns[f]]) for f in LEVELS)
        post = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        share = float(np.clip((post * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for f in LEVELS:
            for table, w, start in ((m, post * n, _START[f][0]), (u, (1 - post) * n, _START[f][1])):
                c = np.bincount(patterns[f], weights=w, minlength=len(start)) + 0.02 * max(1.0, w.sum()) * np.array(start)
                table[f] = c / c.sum()
    return patterns.assign(confidence=post)


def link(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left_key, right_key, confidence): every pair of records of the same work.

    Rows of ``left`` and ``right`` need title, authors and pub_year. Rows whose title is null or
    without a letter or digit match by two or more authors and the year only; null authors and years neither agree nor disagree.
    Repeated rows match each as the first does. Corrections, other parts and follow-ups are told
    apart by their markers. Empty tables give an empty result. Extra columns are not read.
    """
    spark = left.sparkSession
    common = common_words(left, right)
    a, b = (cut(features(x, k, common), tidy=True) for x, k in ((left, left_key), (right, right_key)))
    ca, cb = (cut(_classes(x), tidy=True) for x in (a, b))
    met = cut(_met(ca, cb), tidy=True)
    n_pairs = met.agg(F.sum(F.size("a").cast("bigint") * F.size("b"))).first()[0] or 0
    slices = max(1, -(-n_pairs // max(1, int(IN_FLIGHT * (ca.count() + cb.count())))))
    counts, kept = [], []
    for n in range(slices):
        whole = cut(_compared(ca, cb, met, slices, n), tidy=True)
        counts.append(whole.groupBy(*LEVELS).agg(F.sum("first").alias("n"), F.count("*").alias("n_all")).toPandas())
        if len(counts[-1]):
            kept.append((n, cut(_of(whole, _likely(counts[-1])))))
        drop_cut(whole)
    patterns = pd.concat(counts).groupby(list(LEVELS), as_index=False).sum()
    if not len(patterns):
        return a.join(b, "class").select(left_key, right_key, F.lit(1.0).alias("confidence")).limit(0)
    # the levels are learned from the first passes (and pairs without a title): the others meet many
    # unlike pairs with a name or a year in common, which would shift the shares of those levels
    patterns["n"] = patterns["n"] if patterns["n"].sum() else patterns["n_all"]
    scored = learn(patterns.drop(columns="n_all")).drop(columns="n")
    scored = scored[scored["confidence"] >= MIN_CONFIDENCE]
    sure = [x for _, x in kept]
    for n, _ in kept:
        # what is a match after all, against the first guess, is compared once more
        own = scored.merge(counts[n][list(LEVELS)], on=list(LEVELS))
        late = own.merge(_likely(counts[n]), on=list(LEVELS), how="left", indicator=True).query("_merge == 'left_only'")[list(LEVELS)]
        if len(late):
            sure.append(cut(_of(_compared(ca, cb, met, slices, n), late), tidy=True))
    pairs = sure[0]
    for x in sure[1:]:
        pairs = pairs.unionByName(x)
    return (
        _of(pairs, scored).select("class", "class_b", "confidence")
        .join(a.select(left_key, "class"), "class")
        .join(b.select(right_key, F.col("class").alias("class_b")), "class_b")
        .select(left_key, right_key, F.round("confidence", 6).alias("confidence"))
    )


def _compared(ca: DataFrame, cb: DataFrame, met: DataFrame, slices: int, n: int) -> DataFrame:
    """(class, class_b, first, a column per level) of the pairs of one slice."""
    other = _packed(cb.where(F.pmod("class", F.lit(slices)) == n))
    other = other.select(*[F.col(c).alias(f"{c}_b") for c in other.columns])
    pairs = _pairs(met, slices, n).join(other, "class_b").join(_packed(ca), "class")
    levels = _unpacked(_unpacked(pairs, ""), "_b")
    levels = levels.withColumn("only", F.array_except("rare", "rare_b")).withColumn("only_b", F.array_except("rare_b", "rare")).withColumn("rare_level", _rare_level())
    return levels.select("class", "class_b", F.when(F.col("compact") == "", 1).otherwise(F.col("first")).alias("first"), F.col("rare_level").alias("rare"), _text_level().alias("text"), _marker_level().alias("marker"), _who_level().alias("who"), _year_level().alias("year"))


def _likely(patterns: pd.DataFrame) -> pd.DataFrame:
    """The patterns that the values where the learning starts don't rule out."""
    return patterns.loc[learn(patterns.assign(n=1), 1)["confidence"] >= RULED_OUT, list(LEVELS)]


def _of(compared: DataFrame, patterns: pd.DataFrame) -> DataFrame:
    """The pairs of the given patterns (at most the product of the level counts, 4320 rows), with
    their further columns."""
    rows = pa.Table.from_pandas(patterns.astype({f: "int32" for f in LEVELS}), preserve_index=False)
    return compared.join(F.broadcast(compared.sparkSession.createDataFrame(rows)), list(LEVELS))

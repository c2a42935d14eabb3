"""Reading level: median of classic grade formulas, cut into bands learned from rated documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import widen

MIN_WORDS = 40
MAX_LABELS = 200_000  # rated documents used to place the cuts; a uniform sample where there are more

WORD = re.compile(r"[^\W\d_]+")
_CITED = re.compile(r"\[[^\]\n]{0,40}\]|\((?:[^()\n]{0,80})\)|https?://\S+|[*_`#>|]+")
_MARKED = re.compile(r"[\[(*_`#>|]|http")
_LISTED = re.compile(r"^\s*(?:\[\d+\]|[-*•]\s|\d+[.)]\s)")
_SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'”’)]*\s+")
_STOP = re.compile(r"[.!?。！？][\"'”’)]*\s*$")

# The commonest function words of each language tell it apart.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht den von mit ein eine im dem zu auf für denn aber unter nach wurde des",
    "en": "the of and to in a is that was for with on by from as an at which were so but",
    "es": "el la de que y los del las un una por con para no en se al pero tras durante su",
    "fr": "le la les de des et un une du est dans pour que qui au par sur pas avec nous dans mais",
}
_LANGS = sorted(FUNCTION_WORDS)


#: word -> its vote for each language, 24 bits each
_SIGNS: dict[str, int] = {}
for _w in sorted({w for v in FUNCTION_WORDS.values() for w in v.split()}):
    _own = [k for k, lang in enumerate(_LANGS) if _w in FUNCTION_WORDS[lang].split()]
    _SIGNS[_w] = sum((12 // len(_own)) << (24 * k) for k in _own)
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ"
_GROUP = re.compile(f"[{VOWELS}]+")
_SPLIT_PAIRS = re.compile(r"i[aou]|eo|ua(?!l)|[aeo]í|úa|ía")


def language(words: list[str]) -> str:
    """The language whose function words are commonest; ``other`` where none occurs."""
    votes = sum(map(_SIGNS.get, words, repeat(0)))
    counts = [(votes >> (24 * k)) & 0xFFFFFF for k in range(len(_LANGS))]
    return _LANGS[counts.index(max(counts))] if votes else "other"


def syllables(word: str, lang: str) -> int:
    """Nuclei of a lower-case word, as hyphenation patterns would part it.

    Vowel groups are nuclei; some groups hold two (i-a, e-o); a final mute e of English and French
    and the endings -ed and -es after most consonants hold none.
    """
    n = len(_GROUP.findall(word))
    if lang in ("en", "other", "es"):
        n += len(_SPLIT_PAIRS.findall(word)) if lang != "en" else len(re.findall(r"ia|io(?!n|u)|eo|iu", word))
    if lang == "en":
        if word.endswith("e") and not word.endswith(("le", "ee", "ie")) and n > 1:
            n -= 1
        elif re.search(r"[^aeiouytd]ed$|[^aeiouysxz]es$", word) and n > 1:
            n -= 1
    elif lang == "fr":
        if re.search(r"[^aeiouyé](e|es|ent)$", word) and n > 1:
            n -= 1
    return max(1, n)


def sentences(text: str) -> list[str]:
    """Running sentences; headings, lists of sources, key-value lines and citations are left out."""
    prose: list[str] = []
    block: list[str] = []

    def close() -> None:
        if block:
            joined = " ".join(block)
            if _STOP.search(joined) or len(WORD.findall(joined)) >= 8:
                prose.append(joined)
            block.clear()

    for line in text.splitlines():
        bare = line.strip()
        if not bare or _LISTED.match(line) or (len(bare) < 60 and not _STOP.search(bare) and (not block or len(block[-1]) < 50)):
            close()
            if bare and _LISTED.match(line) and not bare.startswith("["):
                block.append(_LISTED.sub("", bare))
                close()
            continue
        block.append(bare)
    close()
    return [s for p in prose for s in _SENTENCE.split(_CITED.sub(" ", p) if _MARKED.search(p) else p)]


def grades(n_words: int, n_sentences: int, n_syllables: int, n_letters: int, poly: int, long: int) -> list[float]:
    """Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau, automated readability and RIX grades."""
    w, s = max(1, n_words), max(1, n_sentences)
    return [
        0.39 * w / s + 11.8 * n_syllables / w - 15.59,
        0.4 * (w / s + 100 * poly / w),
        1.043 * (30 * poly / s) ** 0.5 + 3.1291,
        5.88 * n_letters / w - 29.6 * s / w - 15.8,
        4.71 * n_letters / w + 0.5 * w / s - 21.43,
        2.2 * (long / s) ** 0.75 + 1.5,
    ]


class _Counts(dict):
    """Word -> its syllables, letters, and whether it is polysyllabic or long, 32 bits each."""

    def __init__(self, lang: str):
        self.lang = lang

    def __missing__(self, word: str) -> int:
        y = syllables(word, self.lang)
        got = y | len(word) << 32 | (y >= 3) << 64 | (len(word) > 6) << 96
        if len(self) < 400_000:
            self[word] = got
        return got


_COUNTS = {lang: _Counts(lang) for lang in [*_LANGS, "other"]}


def measure(text: str | None) -> tuple[int, str, float]:
    """(words of the whole text, or of its prose where that has enough; language; median grade)."""
    if not text:
        return 0, "other", 0.0
    parts = [x for x in map(WORD.findall, sentences(text.lower())) if len(x) >= 3]
    words = [w for p in parts for w in p]
    n_all = len(words)
    if n_all < MIN_WORDS:
        whole = WORD.findall(text.lower())
        n_all = len(whole)
        if not parts:
            parts, words = [whole], whole
    lang = language(words)
    packed = sum(map(_COUNTS[lang].__getitem__, words))
    y, c, poly, long = (packed >> k & 0xFFFFFFFF for k in (0, 32, 64, 96))
    return n_all, lang, median(grades(len(words), len(parts), y, c, poly, long))


def grade(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, lang_found, grade); null and empty texts have no words and grade 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [measure(t) for t in pdf[text]]
            yield pd.DataFrame({key: pdf[key], "n_words": [x[0] for x in got], "lang_found": [x[1] for x in got], "grade": [x[2] for x in got]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, n_words int, lang_found string, grade double")


def fit_cuts(rated: pd.DataFrame) -> dict[str, list[float]]:
    """Three cuts of the grade for each language, with the fewest wrong bands; else those of all."""

    def fit(part: pd.DataFrame) -> list[float]:
        out = []
        for band in (1, 2, 3):
            g, low = part["grade"].to_numpy(), (part["band"] <= band).to_numpy()
            order = np.argsort(g, kind="stable")
            g, low = g[order], low[order]
            wrong = np.concatenate([[low.sum()], low.sum() - np.cumsum(low) + np.cumsum(~low)])
            best = np.flatnonzero(wrong == wrong.min())
            i = best[len(best) // 2]
            edge = (g[i - 1] if i else g[0] - 1, g[i] if i < len(g) else g[-1] + 1)
            out.append(float(sum(edge) / 2))
        return sorted(out)

    if not len(rated):
        return {"*": [5.0, 9.0, 13.0]}
    cuts = {"*": fit(rated)}
    for lang, part in rated.groupby("lang_found"):
        if part["band"].nunique() >= 3 and len(part) >= 25:
            cuts[str(lang)] = fit(part)
    return cuts


def bands(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, reading_band): every document with at least ``MIN_WORDS`` words.

    The cuts come from the rated documents: the median band of the raters of each, null bands
    aside. Null, empty and shorter texts give no row; repeated rows give repeated rows; without
    labels general cuts hold. Extra columns are not read.
    """
    voted = (
        labels.where(F.col("reading_band").isNotNull())
        .groupBy("doc_id")
        .agg(F.expr("percentile_approx(reading_band, 0.5)").alias("band"))
    )
    own = docs.select("doc_id", "text").join(voted, "doc_id")
    n = voted.count()
    if n > MAX_LABELS:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELS / n))
    rated = grade(widen(own.select("doc_id", "text"))).where(F.col("n_words") >= MIN_WORDS).join(voted, "doc_id")
    cuts = fit_cuts(rated.select("grade", "lang_found", "band").toPandas())
    graded = grade(widen(docs.select("doc_id", "text"), 3)).where(F.col("n_words") >= MIN_WORDS)
    band = F.lit(1)
    for k in range(3):
        cut_of = F.lit(cuts["*"][k])
        for lang in sorted(set(cuts) - {"*"}):
            cut_of = F.when(F.col("lang_found") == lang, F.lit(cuts[lang][k])).otherwise(cut_of)
        band = band + (F.col("grade") > cut_of).cast("int")
    return graded.select("doc_id", band.cast("int").alias("reading_band"))

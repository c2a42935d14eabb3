"""Evaluation items that leak into documents.

A window of words is embedded by CGK random walks: reading on by a random bit for each step and
word maps a small edit distance to a small Hamming distance. Keys over sampled places of the
embeddings of all windows of the documents meet those of all windows of the items. Pairs that meet
are verified exactly: the item's words in order, with its names and figures.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import widen

WINDOW = 8  # words of a window; parts of fewer words are one window of their own length
STEPS = 2 * WINDOW  # of a walk: two for each word
WALKS, PLACES = 2, 5  # walks, and sampled steps in a key
CHANGED, TARGET = 0.2, 0.99  # share of changed words, and the recall asked for at that share
COMMON = 40  # a word is no name if it is in more than one of so many items
BLOCK = 5_000  # items looked up at once; more are looked up in blocks
SLICE = 200_000  # words embedded at once
PASSAGE_SHARE, QUESTION_SHARE = 0.48, 0.85  # "half" and "whole", with a few changed words allowed
FILTER_BITS = 20

_MARKUP = re.compile(r"</?[a-z][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_WORDS = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words and figures; tags and entities of markup are no words."""
    low = (text or "").lower()
    if "<" in low or "&" in low:
        low = _MARKUP.sub(" ", low)
    return _WORDS.findall(low)


class _Symbols(dict):
    """Word -> its 32-bit symbol."""

    def __missing__(self, word: str) -> int:
        got = xxhash.xxh32_intdigest(word)
        if len(self) < 500_000:
            self[word] = got
        return got


def samples_for(changed: float = CHANGED, target: float = TARGET) -> int:
    """Samples a walk that reach the target for the shortest repeat that counts.

    A key agrees where all its steps do, with a chance of about (1 - changed) ** PLACES. Half of a
    passage of twice a window and a word has two windows.
    """
    agree = (1 - changed) ** PLACES
    needed = math.log(1 - target) / math.log(1 - agree)
    return max(1, math.ceil(needed / (2 * WALKS)))


SAMPLES = samples_for()


def _short_keys(symbols: np.ndarray, length: int) -> np.ndarray:
    """Keys of the runs of ``length`` symbols that start at each symbol."""
    n = max(0, len(symbols) - length + 1)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = out * np.uint64(0x9E3779B97F4A7C15) + symbols[j : j + n]
    return out ^ (out >> np.uint64(29))


def _plan() -> list[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Per walk: the multipliers of its steps, and the places and multipliers of its samples."""
    rng = np.random.default_rng(20)
    out = []
    for _ in range(WALKS):
        steps = rng.integers(1, 2**31, STEPS, dtype=np.uint32) * 2 + 1
        places = [np.sort(rng.choice(STEPS, PLACES, replace=False)) for _ in range(SAMPLES)]
        factors = [rng.integers(1, 2**62, PLACES, dtype=np.uint64) * 2 + 1 for _ in range(SAMPLES)]
        out.append((steps, places, factors))
    return out


def keys(symbols: np.ndarray) -> list[np.ndarray]:
    """For each sample the keys of the windows that start at each symbol, the last ones aside."""
    n = len(symbols) - STEPS
    found: list[np.ndarray] = []
    for steps, places, factors in _plan():
        at = np.arange(n, dtype=np.int32)
        key = [np.zeros(n, np.uint64) for _ in places]
        for j in range(STEPS):
            here = symbols[at]
            for k, (own, by) in enumerate(zip(places, factors, strict=True)):
                hit = np.flatnonzero(own == j)
                if len(hit):
                    key[k] += here * by[hit[0]]
            at += ((here * steps[j]) >> np.uint32(31)).astype(np.int32)
        found += [x ^ (x >> np.uint64(29)) for x in key]
    return found


@dataclass
class Item:
    item_id: int
    passage: list[str]
    question: list[str]
    names: set[str]


class Index:
    """All windows of a block of items, by key, and the items' words."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], common: frozenset[str]):
        parts = [(i, words_of(p), words_of(q)) for i, q, p in rows]
        rare = lambda w: any(c.isdigit() for c in w) or w not in common
        self.items = [Item(i, p, q, {w for w in p + q if rare(w)}) for i, p, q in parts]
        symbol = _Symbols()
        shorts: dict[int, list[tuple[int, list[str]]]] = {}
        for k, it in enumerate(self.items):
            for text in (it.passage, it.question):
                if 0 < len(text) < WINDOW:
                    shorts.setdefault(len(text), []).append((k, text))
        # parts shorter than a window: their own length is the window, and all of it must agree
        self.shorts = {}
        for n, own in shorts.items():
            ids = np.array([symbol[w] for _, text in own for w in text], np.uint32)
            x = _short_keys(ids, n)[::n]
            order = np.argsort(x, kind="stable")
            self.shorts[n] = (x[order], [own[j] for j in order])
        owners, tables = [], [[] for _ in range(WALKS * SAMPLES)]
        for k, it in enumerate(self.items):
            for text in (it.passage, it.question):
                if len(text) < WINDOW:
                    continue
                ids = np.array([symbol[w] for w in text] + [0] * STEPS, np.uint32)
                got = keys(ids)
                n = len(text) - WINDOW + 1
                owners.append(np.full(n, k, np.int32))
                for t, x in zip(tables, got, strict=True):
                    t.append(x[:n])
        self.owner = np.concatenate(owners) if owners else np.empty(0, np.int32)
        self.tables = []
        for t in tables:
            x = np.concatenate(t) if t else np.empty(0, np.uint64)
            order = np.argsort(x, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(x & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.tables.append((x[order], self.owner[order], bits))

    def whole_shorts(self, symbols: np.ndarray, starts: list[int], lists: list[list[str]]) -> Iterator[tuple[int, int]]:
        """(document, item) of short parts that stand word for word in a document."""
        for n, (sorted_keys, own) in self.shorts.items():
            x = _short_keys(symbols, n)
            lo, hi = np.searchsorted(sorted_keys, x, "left"), np.searchsorted(sorted_keys, x, "right")
            for at in np.flatnonzero(hi > lo):
                d = int(np.searchsorted(np.array(starts), at, "right")) - 1
                for k, text in own[lo[at] : hi[at]]:
                    if lists[d][at - starts[d] : at - starts[d] + n] == text:
                        yield d, k

    def meet(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the windows that share a key with a window of an item."""
        places, owners = [], []
        mask = np.uint64((1 << FILTER_BITS) - 1)
        for x, (sorted_keys, owner, bits) in zip(keys(symbols), self.tables, strict=True):
            maybe = np.flatnonzero(bits[(x & mask).astype(np.int32)])
            lo = np.searchsorted(sorted_keys, x[maybe], "left")
            hi = np.searchsorted(sorted_keys, x[maybe], "right")
            n = hi - lo
            keep = n > 0
            maybe, lo, n = maybe[keep], lo[keep], n[keep]
            if len(maybe):
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                places.append(np.repeat(maybe, n))
                owners.append(owner[np.repeat(lo, n) + within])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate(places), np.concatenate(owners)


def repeated(part: list[str], doc: list[str], names: set[str]) -> tuple[float, float]:
    """(share of ``part`` repeated in order, share of its names and figures in what is repeated).

    Runs of three or more equal words count that hold a name or figure, or join one with at most
    three changed words between; the changed words count as repeated.
    """
    if not part:
        return 0.0, 0.0
    blocks = [b for b in SequenceMatcher(None, part, doc, autojunk=False).get_matching_blocks() if b.size >= 2]
    groups: list[list] = []
    for b in blocks:
        last = groups[-1][-1] if groups else None
        if last and b.a - (last.a + last.size) <= 3 and b.b - (last.b + last.size) <= 3:
            groups[-1].append(b)
        else:
            groups.append([b])
    covered = named = all_named = 0
    for g in groups:
        a, e = g[0].a, g[-1].a + g[-1].size
        equal = {i for b in g for i in range(b.a, b.a + b.size)}
        want = [i for i in range(a, e) if part[i] in names]
        have = sum(i in equal for i in want)
        if len(equal) < 4 or not want or have < 0.6 * len(want):
            continue
        covered += e - a
        named += have
        all_named += len(want)
    return covered / len(part), named / max(1, all_named)


def leaked(item: Item, doc: list[str]) -> bool:
    share, named = repeated(item.passage, doc, item.names)
    if share >= PASSAGE_SHARE and named >= 0.7:
        return True
    share, named = repeated(item.question, doc, item.names)
    return share >= QUESTION_SHARE and named >= 0.7


def _found(docs: DataFrame, rows: list, common: frozenset[str], key: str, text: str, item_key: str, kinds: tuple[str, str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((rows, common))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, symbol = Index(*sent.value), _Symbols()
        for pdf in batches:
            ids, texts = pdf[key].tolist(), pdf[text].tolist()
            out: list[tuple] = []
            k = 0
            while k < len(texts):
                flat: list[int] = []
                starts, lists, first = [], [], k
                while k < len(texts) and len(flat) < SLICE:
                    w = words_of(texts[k])
                    lists.append(w)
                    starts.append(len(flat))
                    flat += map(symbol.__getitem__, w)
                    flat += [0] * STEPS
                    k += 1
                symbols = np.array(flat, np.uint32)
                if flat and index.shorts:
                    out += [(ids[first + d], index.items[i].item_id) for d, i in index.whole_shorts(symbols, starts, lists)]
                places, owners = index.meet(symbols) if flat else (np.empty(0, np.int64), np.empty(0, np.int32))
                if not len(places):
                    continue
                of = np.searchsorted(np.array(starts), places, "right") - 1
                pair = of.astype(np.int64) * len(index.items) + owners
                for p, lo, hi in _spans(pair, places):
                    d, it = int(p // len(index.items)), index.items[int(p % len(index.items))]
                    w = lists[d]
                    reach = len(it.passage) + len(it.question)
                    region = w[max(0, lo - starts[d] - reach) : hi - starts[d] + reach]
                    if len(it.names.intersection(region)) >= 3 and leaked(it, region):
                        out.append((ids[first + d], it.item_id))
            yield pd.DataFrame(out, columns=[key, item_key])

    return docs.select(key, text).mapInPandas(run, f"{key} {kinds[0]}, {item_key} {kinds[1]}")


def _spans(pair: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(pair, first place, last place) of the pairs that meet at two places or more."""
    order = np.lexsort((places, pair))
    pair, places = pair[order], places[order]
    cuts = np.flatnonzero(np.diff(pair)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pair)]]), strict=True):
        if places[b - 1] > places[a]:
            yield int(pair[a]), int(places[a]), int(places[b - 1])


def common_words(items: DataFrame) -> frozenset[str]:
    """The words in more than one of ``COMMON`` of all items (and in more than four).

    By share, so at most ``COMMON`` times the words of an item, whatever the number of items.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            df: Counter = Counter()
            for q, p in zip(pdf["question"], pdf["passage"], strict=True):
                df.update({*words_of(q), *words_of(p)})
            yield pd.DataFrame(list(df.items()), columns=["word", "n"])

    seen = items.select("question", "passage").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in seen.where(F.col("n") > max(4, items.count() // COMMON)).collect())


def find(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_key) of every document that holds an item's passage or question.

    Items, of a fixed number, are read by the driver in blocks of ``BLOCK`` and broadcast. Null and
    empty texts hold nothing; null and empty passages and questions leak nowhere; those of fewer
    words than a window leak where they stand word for word; repeated rows are one. Very long texts are read whole, in slices of documents.
    """
    kinds = (docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString())
    own = items.select(item_key, "question", "passage").dropDuplicates()
    blocks = max(1, -(-own.count() // BLOCK))
    common = common_words(own)
    wide = widen(docs.select(key, text), 3)
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in own.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b).collect()]
        got = _found(wide, rows, common, key, text, item_key, kinds)
        out = got if out is None else out.unionByName(got)
    return out.distinct()

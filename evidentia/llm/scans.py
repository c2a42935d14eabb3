"""Repair of text from scanned pages: broken words, misread words, running lines, page numbers.

Counts over the whole corpus tell how often each word occurs, and each line at page edges and
elsewhere. Two line-pair classifiers, boosted trees (``llm/boosting.py``), part running lines and
page numbers from text, and broken words from compounds. Misread words find their candidates
through a join on character q-grams; trees, trained on words misread on purpose, choose among them.
``noises`` lists what was found, ``repaired`` gives the texts as continuous paragraphs.

The classifiers are fitted on ``TRAIN_TEXTS`` texts of at most ``TRAIN_CHARS`` characters, taken by
the hash of their keys, and on at most ``TRAIN_WORDS`` words. Everything else covers all texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import boosting
from evidentia.session import cut, spread, widen

WORD_SHARE = 50_000  # words that make at least one in so many are sent to all tasks and never doubted
SUPPORT = 3  # a word needs so many occurrences in the corpus to be what another one means
EDGE_LINES = 3  # lines at either end of a page that may be furniture
EDITS = 2  # between a misread word and its meaning; 1 for words of less than five letters
LONG = 8  # letters from which trigrams find candidates
TRAIN_TEXTS, TRAIN_CHARS = 500, 200_000
TRAIN_WORDS = 4_000  # common words misread on purpose, and rare words taken as right, for training
ACCEPT = 0.5

SIGNS = "¬­‐‑-"
_BREAK_SIGNS, _SIGN = frozenset(SIGNS), re.compile(f"[{SIGNS}]")
_BREAK = re.compile(rf"([^\W\d_][\w'’|!{SIGNS}]*?)([{SIGNS}])[ \t\r]*$")
_FIRST = re.compile(r"^[\f\s]*([^\W\d_][\w|!]*)")
_WORD = re.compile(r"[^\W_][\w|!]*(?:[-'’][\w|!]+)*")
_PAGE = re.compile(r"^[\f\s]*(?:[-–—(\[]\s*)?(?:(?:page|p\.|seite)\s*)?(?:\d{1,5}|[ivxl]{1,7})(?:\s*(?:of|/)\s*\d{1,5})?(?:\s*[-–—)\]])?\s*$", re.I)
_NUMBERED = re.compile(r"^\s*(?:\d{1,5}|[ivxl]{1,6})\s{2,}\S|\S\s{2,}(?:\d{1,5}|[ivxl]{1,6})\s*$")
_RUNNING = re.compile(r"\bet al\.\s*$|,\s*vol\.\s*\d+\s*$|\bet al\.$", re.I)
_NUMERALS, _GAPS = re.compile(r"\b(?:\d+|[ivxl]{1,6})\b"), re.compile(r"\s+")
_ENDS = re.compile(r"[.!?:;。！？]['\"”’)\]]*\s*$")

# What scanners take one sign or two for.
CONFUSED = [("o", "0"), ("l", "1"), ("l", "|"), ("i", "1"), ("i", "í"), ("i", "l"), ("l", "i"), ("s", "5"), ("g", "9"), ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"), ("b", "6"), ("z", "2"), ("q", "g"), ("m", "rn"), ("rn", "m"), ("cl", "d"), ("d", "cl"), ("n", "ri"), ("ri", "n"), ("u", "ii"), ("ii", "u"), ("li", "h"), ("h", "li"), ("ti", "ü"), ("w", "vv"), ("vv", "w"), ("nn", "m"), ("in", "m"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("tt", "ft"), ("th", "fh"), ("y", "v"), ("r", "i")]
_PAIRS = frozenset(CONFUSED)


def _break(line: str) -> re.Match | None:
    """The match of a line end that may break a word."""
    return _BREAK.search(line) if line.rstrip(" \t\r")[-1:] in _BREAK_SIGNS else None


def normal_line(line: str) -> str:
    """A line without numbers and layout, to compare running lines by."""
    return _GAPS.sub(" ", _NUMERALS.sub(" ", line.strip("\f \t\r").lower())).strip()


def pages_of(lines: list[str]) -> list[list[int]]:
    """The line numbers (from 0) of each page, blank lines left out."""
    pages: list[list[int]] = [[]]
    for i, line in enumerate(lines):
        if "\f" in line and (i or line.lstrip(" ").startswith("\f")) and (pages[-1] or len(pages) > 1 or i):
            pages.append([])
        if line.strip():
            pages[-1].append(i)
    return [p for p in pages if p]


def edge_lines(lines: list[str]) -> tuple[set[int], set[int]]:
    """(lines that may be furniture at the top, at the bottom) of any page."""
    top, bottom = set(), set()
    for p in pages_of(lines):
        top.update(p[:EDGE_LINES])
        bottom.update(p[-EDGE_LINES:])
    return top, bottom


def counts(texts: DataFrame, key: str, content: str) -> DataFrame:
    """(kind, item, n): words over all text; lines at page edges and elsewhere, by texts.

    Words at either side of a line end that may be broken are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words: Counter = Counter()
            edge: Counter = Counter()
            mid: Counter = Counter()
            for text in pdf[content]:
                lines = text.split("\n")
                top, bottom = edge_lines(lines)
                at_edge = top | bottom
                edge.update({normal_line(lines[i]) for i in at_edge if len(lines[i]) < 90})
                mid.update({normal_line(x) for i, x in enumerate(lines) if i not in at_edge and len(x) < 60})
                words.update(_counted(lines, [_WORD.findall(x) for x in text.lower().split("\n")]))
            rows = [("word", k, n) for k, n in words.items()] + [("edge", k, n) for k, n in edge.items() if k] + [("mid", k, n) for k, n in mid.items() if k]
            yield pd.DataFrame(rows, columns=["kind", "item", "n"])

    return texts.select(key, content).mapInPandas(run, "kind string, item string, n bigint").groupBy("kind", "item").agg(F.sum("n").alias("n"))


class Known:
    """The common words with their counts, of bounded number, and the number of all words."""

    def __init__(self, words: dict[str, int], total: int):
        self.words, self.total = words, total
        self.tails = Counter()
        self.heads = Counter()
        for w, n in words.items():
            if "-" in w:
                head, _, tail = w.partition("-")
                self.tails[tail] += n
                self.heads[head] += n


def far(word: str) -> int:
    """How many times as common a word is at least that stands for a frequent misreading."""
    return 3 if any(not c.isalpha() and c not in "-'’" for c in word) else 400


def trusted(words: dict[str, int]) -> dict[str, int]:
    """Common words without those that are frequent misreadings of far commoner ones."""

    def doubtful(w: str, n: int) -> bool:
        for meant, seen in CONFUSED:
            at = w.find(seen)
            while at >= 0:
                v = w[:at] + meant + w[at + len(seen) :]
                if words.get(v, 0) >= far(w) * n:
                    return True
                at = w.find(seen, at + 1)
        return False

    return {w: n for w, n in words.items() if not doubtful(w, n)}


def known(all_counts: DataFrame) -> Known:
    """At most ``WORD_SHARE`` words, whatever the corpus."""
    words = all_counts.where("kind = 'word'")
    total = words.agg(F.sum("n")).first()[0] or 0
    kept = words.where(F.col("n") >= max(8, total // WORD_SHARE)).toPandas()
    return Known(trusted(dict(zip(kept["item"].tolist(), kept["n"].tolist(), strict=True))), total)


def edge_counts(texts: DataFrame, all_counts: DataFrame, key: str, content: str) -> DataFrame:
    """``texts`` with ``edges``: of each line at a page's edge, in how many texts it stands at an
    edge and elsewhere. Lines meet their counts in a join, so a rare running line counts too."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for tid, text in zip(pdf[key], pdf[content], strict=True):
                lines = text.split("\n")
                rows += [(tid, i, normal_line(lines[i])) for p in pages_of(lines) for i in {*p[:EDGE_LINES], *p[-EDGE_LINES:]} if len(lines[i]) < 90]
            yield pd.DataFrame(rows, columns=[key, "i", "item"])

    lines = texts.select(key, content).mapInPandas(run, f"{key} {kind}, i int, item string").where("item <> ''")
    seen = all_counts.where("kind <> 'word'").groupBy("item").agg(F.sum(F.when(F.col("kind") == "edge", F.col("n"))).alias("edge"), F.sum(F.when(F.col("kind") == "mid", F.col("n"))).alias("mid"))
    seen = seen.where("edge > 1 or mid > 0")  # one text alone tells nothing
    per = cut(lines.join(seen, "item").groupBy(key).agg(F.collect_list(F.struct("i", F.coalesce("edge", F.lit(0)).alias("edge"), F.coalesce("mid", F.lit(0)).alias("mid"))).alias("edges")))
    return texts.select(key, content).join(per, key, "left")


def _edges_of(rows) -> dict[int, tuple[int, int]]:
    return {r["i"]: (r["edge"], r["mid"]) for r in rows} if rows is not None else {}


class _Page:
    """What the lines at the edges of a text's pages show, as numbers."""

    def __init__(self, lines: list[str], seen: dict[int, tuple[int, int]]):
        self.lines, self.seen, self.pages = lines, seen, pages_of(lines)
        self.repeated: Counter = Counter()
        for p in self.pages:
            self.repeated.update({("t", normal_line(lines[i])) for i in p[:2]} | {("b", normal_line(lines[i])) for i in p[-EDGE_LINES:]})
        self.width = float(np.median([len(x) for x in lines if len(x) > 30] or [60]))

    def features(self, no: int, i: int, side: str, depth: int, before: str, after: str, gap: bool) -> list[float]:
        """Of line ``i`` on page ``no``, with the text's last line before it and the line after it."""
        line = self.lines[i].strip("\f \t\r")
        norm = normal_line(line)
        edge, mid = self.seen.get(i, (0, 0))
        number = bool(_PAGE.match(self.lines[i]))
        return [
            float(number), float(number and _page_fits(self.lines, self.pages, no, i)), float(side == "t"), float(depth), float(no), float(len(self.pages)),
            float(self.repeated[(side, norm)]) if norm else 0.0, float(np.log1p(edge)), float(np.log1p(mid)), float(mid > edge // 4 + 1), float(edge >= 5 and mid <= edge // 10),
            len(line) / self.width, float(len(line) > max(90, 1.5 * self.width)), float(bool(_ENDS.search(line))), float(bool(_NUMBERED.search(line))), float(bool(_RUNNING.search(line))),
            float(bool(re.search(r"[=_{}]", line))), float(line.startswith(("#", "|", "- "))), float(line[:1].islower()), float(line.isupper()), float(not norm),
            float(side == "t" and depth == 0 and no > 0 and mid < 3 and _interrupts(before, self.lines[i], after, gap, self.width)),
        ]


N_EDGE = 22


def edge_walk(lines: list[str], seen: dict[int, tuple[int, int]], judge) -> dict[int, str]:
    """Line -> header or page_number, for one text.

    Each page is walked from its ends inwards; ``judge`` takes the features of the next line, and
    the first line that it takes for text ends the walk.
    """
    page = _Page(lines, seen)
    out: dict[int, str] = {}
    last = ""
    for no, p in enumerate(page.pages):
        top, bottom = 0, len(p)
        while bottom > 0 and len(p) - bottom < EDGE_LINES:
            i = p[bottom - 1]
            if not judge(page.features(no, i, "b", len(p) - bottom, "", "", False)):
                break
            out[i] = "page_number" if _PAGE.match(lines[i]) else "header"
            bottom -= 1
        while top < bottom and top < EDGE_LINES:
            i = p[top]
            after = p[top + 1] if top + 1 < len(p) else i
            if not judge(page.features(no, i, "t", top, last, lines[after] if after != i else "", after - i > 1)):
                break
            out[i] = "page_number" if _PAGE.match(lines[i]) else "header"
            top += 1
        content = p[top:bottom]
        if content:
            last = lines[content[-1]]
    return out


def evident(x: list[float]) -> bool:
    """A label for training, from evidence that speaks for itself.

    A number that fits the page; a line that repeats at its side of the pages; one that is common
    at edges and rare elsewhere; one with a number set apart, or that cuts a running sentence in two.
    """
    number, fits, top, _, _, _, repeated, _, _, heading, at_edges, length, too_long, ends, numbered, running, code, listed, _, _, blank, interrupts = x
    if number:
        return bool(fits)
    if blank or too_long or code or (heading and not numbered):
        return False
    if repeated >= 2 and not listed:
        return True
    if at_edges:
        return bool(not ends or running or length < 0.7)
    return bool((running and length < 1) or (numbered and top and not listed) or interrupts)


def train_edges(sample: list[tuple[str, dict]]) -> dict:
    """A model of running lines and page numbers at the edges of pages, from the evident labels."""
    x: list[list[float]] = []
    y: list[bool] = []

    def judge(features: list[float]) -> bool:
        x.append(features)
        y.append(evident(features))
        return y[-1]

    for text, seen in sample:
        edge_walk(text.split("\n"), seen, judge)
    return boosting.fit(np.array(x, float).reshape(-1, N_EDGE), np.array(y, float), rounds=120, rate=0.3)


def _page_fits(lines: list[str], pages: list[list[int]], no: int, i: int) -> bool:
    """A number at a page's edge is the page's unless it goes on with a column of numbers."""
    p = pages[no]
    at = p.index(i)
    beside = p[at - 1] if at == len(p) - 1 and at else p[at + 1] if at + 1 < len(p) else None
    bare = lines[i].strip("\f \t\r")
    if re.fullmatch(r"[ivxl]+", bare, re.I) and len(pages) < 2:
        return False
    return not (beside is not None and abs(beside - i) == 1 and re.fullmatch(r"[\f\s]*[\d.,]+\s*", lines[beside]) and bare.isdigit())


def _interrupts(before: str, line: str, after: str, gap: bool, width: float) -> bool:
    """Whether a page's first line stands apart from its text.

    It does where the last page runs on in the line after it, and where it is no sentence and a
    gap or a new sentence follows.
    """
    a, b, c = (x.strip("\f \t\r") for x in (before, line, after))
    if not a or not c or not b or b[0].islower() or len(b) >= width or len(b.split()) < 3:
        return False
    whole = bool(_ENDS.search(b.removesuffix(":").removesuffix("?")))
    runs_on = not _ENDS.search(a) and (c[0].islower() or c[0].isdigit() or c[0] == "(")
    return not whole and (runs_on or b.isupper() or ((gap or c[0].isupper()) and bool(_ENDS.search(a))))


def pair_features(a: str, b: str, local: Counter, k: Known) -> list[float]:
    """Of a possibly broken word: how well it is known joined, hyphenated and in parts."""
    lg = math.log1p
    joined, dashed = a + b, f"{a}-{b}"
    return [
        lg(k.words.get(joined, 0)), lg(local.get(joined, 0)), lg(k.words.get(dashed, 0)), lg(local.get(dashed, 0)),
        lg(k.words.get(a, 0)), lg(k.words.get(b, 0)), lg(k.tails.get(b, 0)), lg(k.heads.get(a, 0)), float(len(a)), float(len(b)), lg(local.get(a, 0)), lg(local.get(b, 0)),
    ]


def _counted(lines: list[str], words: list[list[str]]) -> Counter:
    """The words of all lines, those at either side of a possible break left out."""
    flat: list[str] = []
    broken = False
    for line, found in zip(lines, words, strict=True):
        ends = _break(line) is not None
        if found:
            flat += found[broken : len(found) - ends] if broken or ends else found
        broken = ends
    return Counter(flat)


def _local(lines: list[str]) -> Counter:
    return _counted(lines, [_WORD.findall(x.lower()) for x in lines])


def breaks(lines: list[str], skip: dict[int, str]) -> list[tuple[int, str, str, str]]:
    """(line, first part, sign, second part) of the line ends that may break a word."""
    out = []
    content = [i for i in range(len(lines)) if i not in skip and lines[i].strip()]
    for i, j in zip(content, [*content[1:], None], strict=True):
        m = _break(lines[i])
        if not m:
            continue
        n = _FIRST.match(lines[j]) if j is not None else None
        a = _SIGN.split(m.group(1).lower())[-1]
        out.append((i, a, m.group(2), n.group(1).lower() if n and n.group(1)[0].islower() else ""))
    return out


def train_breaks(sample: list[str], k: Known) -> dict:
    """A model of broken words: breaks by unmistakable signs against compounds within lines."""
    x, y = [], []
    for text in sample:
        lines = text.split("\n")
        local = _local(lines)
        for _, a, sign, b in breaks(lines, {}):
            if sign in "¬­" and b:
                x.append(pair_features(a, b, local, k))
                y.append(1)
        for w in sorted({w for w in local if w.count("-") == 1}):
            a, _, b = w.partition("-")
            if a.isalpha() and b.isalpha():
                local[w] -= 1
                x.append(pair_features(a, b, local, k))
                local[w] += 1
                y.append(0)
    return boosting.fit(np.array(x, float).reshape(-1, 12), np.array(y, float))


def misread_cost(seen: str, meant: str) -> float:
    """Edits from ``meant`` to ``seen``, a known confusion counting 0.3.

    What both share at their ends is left out, so mostly a few signs are compared.
    """
    if seen == meant:
        return 0.0
    i, n, m = 0, len(seen), len(meant)
    while i < n and i < m and seen[i] == meant[i]:
        i += 1
    j = 0
    while j < n - i and j < m - i and seen[n - 1 - j] == meant[m - 1 - j]:
        j += 1
    x, y = seen[i : n - j], meant[i : m - j]
    if (y, x) in _PAIRS:
        return 0.3
    d = [[float(k) for k in range(len(y) + 1)]]
    for r in range(1, len(x) + 1):
        row = [float(r)]
        for c in range(1, len(y) + 1):
            best = min(d[r - 1][c] + 1, row[c - 1] + 1, d[r - 1][c - 1] + (x[r - 1] != y[c - 1]))
            for p in (1, 2):
                for q in (1, 2):
                    above = d[r - p] if r >= p else None
                    if above is not None and c >= q and above[c - q] + 0.3 < best and (y[c - q : c], x[r - p : r]) in _PAIRS:
                        best = above[c - q] + 0.3
            row.append(best)
        d.append(row)
    return d[-1][-1]


def grams(word: str) -> list[tuple[str, int]]:
    padded = f"^{word}$"
    return [(padded[i : i + 2], i) for i in range(len(padded) - 1)]


def rank_features(seen: str, meant: str, n_seen: int, n_meant: int, total: int) -> list[float]:
    cost = misread_cost(seen, meant)
    letters = sum(c.isalpha() and c.isascii() for c in seen)
    shared = len({*grams(seen)} & {(g, i + d) for g, i in grams(meant) for d in (-1, 0, 1)})
    return [
        cost, cost / len(meant), shared / (len(meant) + 1), float(np.log((n_meant + 1) / (total + 1))), float(np.log((n_meant + 1) / (n_seen + 1))), float(len(meant)),
        float(len(seen) - letters), float(seen[0] == meant[0]), float(seen[-1] == meant[-1]),
    ]


N_RANK = 9


def train_ranking(k: Known, right: dict[str, int]) -> dict:
    """Trees that tell a misread word's meaning from other candidates and from rare right words.

    ``right`` holds words that texts repeat, with their counts; they stand for the rare words.
    """
    rng = np.random.default_rng(7)
    index: dict[tuple[str, int], list[str]] = {}
    words = {**right, **k.words}
    for w in words:
        if w.isalpha() and len(w) >= 3:
            for g, i in grams(w):
                for s in (-1, 0, 1):
                    index.setdefault((g, i + s), []).append(w)

    def candidates(seen: str) -> Counter:
        c: Counter = Counter()
        for g in grams(seen):
            c.update(index.get(g, ()))
        return Counter({w: n for w, n in c.items() if w != seen and abs(len(w) - len(seen)) <= EDITS and n >= max(2, len(seen) // 3)})

    x, y = [], []
    meant = [w for w in words if w.isalpha() and w.isascii() and len(w) >= 3]
    # a word is misread as often as it is used, so common ones are drawn more often
    weight = np.array([words[w] for w in meant], float)
    for w in sorted(rng.choice(np.array(meant, dtype=object), TRAIN_WORDS // 2, p=weight / weight.sum())) if meant else []:
        options = [(a, b) for a, b in CONFUSED if a in w]
        if not options:
            continue
        a, b = options[rng.integers(len(options))]
        spots = [m.start() for m in re.finditer(re.escape(a), w)]
        at = spots[rng.integers(len(spots))]
        seen = w[:at] + b + w[at + len(a) :]
        if seen in words:
            continue
        n_seen = int(rng.integers(1, 1 + max(1, min(20, words[w] // far(seen)))))
        for c, _ in candidates(seen).most_common(4):
            x.append(rank_features(seen, c, n_seen, words[c], k.total))
            y.append(c == w)
    for seen in sorted(right):
        n_seen = int(rng.integers(1, 3))  # most right words are met once or twice
        for c, _ in candidates(seen).most_common(4):
            x.append(rank_features(seen, c, n_seen, words[c], k.total))
            y.append(False)
    return boosting.fit(np.array(x, float).reshape(-1, N_RANK), np.array(y, float), rounds=80)


class _Suspects(dict):
    """Lower-case word -> its parts that are no common words and look like words."""

    def __init__(self, k: Known):
        self.words = k.words

    def __missing__(self, word: str) -> tuple[str, ...]:
        got = tuple(p for p in word.split("-") if p not in self.words and _wordlike(p))
        if len(self) < 400_000:
            self[word] = got
        return got


def _wordlike(w: str) -> bool:
    """Whether letters of an alphabet make most of it; ideographs and other scripts have no such misreadings."""
    letters = sum(c.isalpha() for c in w)
    return len(w) >= 3 and letters >= 2 and letters >= 0.6 * len(w) and not any("一" <= c <= "鿿" or "Ѐ" <= c <= "ӿ" for c in w)


def line_pass(texts: DataFrame, key: str, content: str, k: Known, edger: dict, breaker: dict) -> DataFrame:
    """(key, line_no, noise, word, n): furniture, broken words, and rare words yet to judge."""
    sent = texts.sparkSession.sparkContext.broadcast((k, edger, breaker))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, edger, breaker = sent.value
        suspects, judge = _Suspects(k), boosting.scorer(edger)
        for pdf in batches:
            rows: list[tuple] = []
            read, x = [], []
            for tid, text, edges in zip(pdf[key], pdf[content], pdf["edges"], strict=True):
                lines = text.split("\n")
                skip = edge_walk(lines, _edges_of(edges), judge)
                rows += [(tid, i + 1, what, None, 0) for i, what in skip.items()]
                words = [_WORD.findall(y) for y in text.lower().split("\n")]
                local = _counted(lines, words)
                ends = breaks(lines, skip)
                x += [pair_features(a, b, local, k) for _, a, _, b in ends]
                read.append((tid, skip, words, local, ends))
            chance = iter(boosting.predict(breaker, np.array(x, float).reshape(-1, 12)).tolist())
            for tid, skip, words, local, ends in read:
                cut_at = {i for i, _, sign, b in ends if (next(chance) >= ACCEPT and b) or sign in "¬­"}
                rows += [(tid, i + 1, "hyphen", None, 0) for i in cut_at]
                after_cut = False
                for i, found in enumerate(words):
                    if not found or i in skip:
                        continue
                    for w in found[after_cut : len(found) - (i in cut_at)]:
                        for part in suspects[w]:
                            rows.append((tid, i + 1, "?", part, local[part] if part == w else 1))
                    after_cut = i in cut_at
            yield pd.DataFrame(rows, columns=[key, "line_no", "noise", "word", "n"])

    return texts.mapInPandas(run, f"{key} {kind}, line_no int, noise string, word string, n bigint")


def _grams_of(word: str, q: str) -> Column:
    p = f"concat('^', {word}, '$')"
    return F.expr(f"transform(sequence(1, length({word}) + 3 - {q}), i -> struct(substring({p}, i, {q}) as gram, i as place))")


def corrections(words: DataFrame, all_counts: DataFrame, total: int, ranker: dict) -> DataFrame:
    """(word, meant, at_most, chance): words that are misread others.

    ``at_most`` is how often a misreading may stand in a text, by how common its meaning is. What a
    word may mean is any word of the corpus with ``SUPPORT`` occurrences. Both are tables: they meet
    in an equi-join on q-grams and their places. An edit spoils at most q grams, so the rarest
    ``q * edits + 1`` grams of a word find every meaning within so many edits; q is 3 for words of
    ``LONG`` letters, which have that many trigrams, else 2.
    """
    counted = all_counts.where("kind = 'word'").select(F.col("item").alias("word"), "n")
    meanings = counted.where(F.col("n") >= SUPPORT).where(r"length(word) >= 3 and word rlike '^\\p{L}+$'").select(F.col("word").alias("meant"), F.col("n").alias("n_meant"))
    both = F.when(F.length("meant") >= LONG - EDITS, F.concat(_grams_of("meant", "2"), _grams_of("meant", "3"))).otherwise(_grams_of("meant", "2"))
    postings = cut(meanings.select("meant", "n_meant", F.explode(both).alias("g")).select("meant", "n_meant", "g.gram", "g.place"))
    load = postings.groupBy("gram").agg(F.count("*").alias("load"))
    edits = F.when(F.length("word") < 5, EDITS - 1).otherwise(EDITS)
    q = F.when(F.length("word") >= LONG, 3).otherwise(2)
    # a word so long that no meaning comes near it has none: its bigrams need not be made
    lengths = meanings.select(F.explode(F.array(*[F.length("meant") + d for d in range(-EDITS, EDITS + 1)])).alias("n_letters")).distinct()
    near_some = words.withColumn("n_letters", F.length("word")).join(lengths, "n_letters", "left_semi").select("word")
    asked = near_some.join(counted, "word", "left").select("word", F.coalesce("n", F.lit(1)).alias("n_seen"), F.explode(_grams_of("word", f"if(length(word) >= {LONG}, 3, 2)")).alias("g")).select("word", "n_seen", "g.gram", "g.place")
    rarest = F.array_sort(F.collect_list(F.struct(F.coalesce("load", F.lit(0)).alias("load"), "gram", "place")))
    keys = asked.join(load, "gram", "left").groupBy("word", "n_seen").agg(rarest.alias("g")).withColumn("edits", edits)
    keys = keys.select("word", "n_seen", "edits", F.explode(F.slice("g", F.lit(1), q * F.col("edits") + 1)).alias("g")).where("g.load > 0")
    keys = keys.select("word", "n_seen", "edits", "g.gram", F.explode(F.expr("sequence(g.place - edits, g.place + edits)")).alias("place")).repartition(spread(words, 4), "word")
    apart = F.abs(F.length("meant") - F.length("word")) <= F.col("edits")
    met = keys.join(postings, ["gram", "place"]).where(apart & (F.col("word") != F.col("meant")) & (F.col("n_meant") >= SUPPORT * F.col("n_seen")))
    near = met.where(F.levenshtein("word", "meant", EDITS) >= 0).where((F.col("edits") == EDITS) | (F.levenshtein("word", "meant") <= 1)).select("word", "n_seen", "meant", "n_meant").distinct()
    sent = words.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([rank_features(*r, total) for r in zip(pdf["word"], pdf["meant"], pdf["n_seen"], pdf["n_meant"], strict=True)], float).reshape(-1, N_RANK)
            yield pd.DataFrame({"word": pdf["word"], "meant": pdf["meant"], "at_most": [m // far(w) for w, m in zip(pdf["word"], pdf["n_meant"], strict=True)], "chance": boosting.predict(sent.value, x)})

    best = F.struct("chance", "meant")
    ranked = near.mapInPandas(run, "word string, meant string, at_most bigint, chance double").where(F.col("chance") >= ACCEPT)
    return ranked.groupBy("word").agg(F.max_by("meant", best).alias("meant"), F.max_by("at_most", best).alias("at_most"), F.max("chance").alias("chance"))


def _judged(texts: DataFrame, key: str, content: str) -> DataFrame:
    """(key, line_no, noise, word, meant) of all lines with noise; ``texts`` without empty ones."""
    all_counts = cut(counts(texts, key, content))
    k = known(all_counts)
    with_edges = edge_counts(texts, all_counts, key, content)
    sample = with_edges.where(F.length(content) <= TRAIN_CHARS).orderBy(F.xxhash64(key), key).limit(TRAIN_TEXTS).collect()
    edger = train_edges([(r[content], _edges_of(r["edges"])) for r in sample])
    breaker = train_breaks([r[content] for r in sample], k)
    passed = cut(line_pass(with_edges, key, content, k, edger, breaker))
    unsure = passed.where("noise = '?'")
    # words that stand often in a text are taken as right for training, not those that look misread
    repeated = unsure.where("n >= 3").select("word").distinct().join(all_counts.where("kind = 'word'").withColumnRenamed("item", "word"), "word").orderBy(F.xxhash64("word")).limit(TRAIN_WORDS // 2).collect()
    often = {r["word"]: r["n"] for r in repeated}
    credible = trusted({**k.words, **often})
    fixed = corrections(unsure.select("word").distinct(), all_counts, k.total, train_ranking(k, {w: n for w, n in often.items() if w in credible}))
    # a word that a text repeats is a misreading only where its meaning is far commoner
    chars = unsure.join(fixed, "word").where("n <= 2 or n <= at_most").select(key, "line_no", F.lit("char").alias("noise"), "word", "meant")
    return passed.where("noise <> '?'").select(key, "line_no", "noise", "word", F.lit(None).cast("string").alias("meant")).unionByName(chars)


def noises(texts: DataFrame, key: str = "text_id", content: str = "content") -> DataFrame:
    """(key, line_no, noise) of all lines with noise.

    ``char`` and ``hyphen`` are given once a line; running lines and page numbers have nothing
    else. Null and empty texts give no row; repeated rows count as one text.
    """
    own = widen(texts.where(F.length(content) > 0).select(key, content))
    return _judged(own, key, content).select(key, "line_no", "noise").distinct()


def paragraphs(lines: list[str], noise: dict[int, set[str]], meant: dict[int, dict[str, str]]) -> str:
    """A text without furniture, its broken words joined, its misread words put right, in paragraphs.

    A blank line, a list item, a heading and a line that ends a sentence well before the margin end
    a paragraph; a page's end doesn't.
    """
    width = float(np.median([len(x) for x in lines if len(x) > 30] or [60]))
    out: list[str] = []
    current, broken, closed = "", False, True
    for i, line in enumerate(lines):
        what = noise.get(i, set())
        if what & {"header", "page_number"}:
            continue
        bare = line.strip("\f \t\r")
        for seen, right in meant.get(i, {}).items():
            bare = re.sub(rf"(?<!\w){re.escape(seen)}(?!\w)", lambda m, r=right: _cased(m.group(), r), bare, flags=re.I)
        if not bare:
            # a gap at a page's end is the page's
            closed = closed or not ("\f" in line or (i + 1 < len(lines) and "\f" in lines[i + 1]))
            continue
        starts = bool(re.match(r"(?:[#|>•*-]|\d+[.)])\s", bare)) or bare[0] in "#|"
        if current and not broken and (closed or starts):
            out.append(current)
            current = ""
        if not current or broken:
            current += bare
        else:
            current += ("" if _unspaced(current[-1]) and _unspaced(bare[0]) else " ") + bare
        broken = "hyphen" in what
        if broken:
            current = current.rstrip(SIGNS + " \t")
        closed = not broken and (bare.startswith("#") or (bool(_ENDS.search(bare)) and len(bare) < 0.7 * width))
    return "\n\n".join([*out, current] if current else out)


def _unspaced(c: str) -> bool:
    return "　" <= c <= "鿿" or "＀" <= c <= "￯"


def _cased(seen: str, meant: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    return meant.upper() if len(letters) > 1 and all(c.isupper() for c in letters) else meant.capitalize() if seen[0].isupper() else meant


def repaired(texts: DataFrame, key: str = "text_id", content: str = "content") -> DataFrame:
    """(key, content): every text as continuous paragraphs, without the traces of page and scan.

    Null and empty texts stay as they are; repeated rows repeat. ``key`` tells the texts apart.
    """
    own = widen(texts.where(F.length(content) > 0).select(key, content))
    per = _judged(own, key, content).groupBy(key).agg(F.collect_set(F.struct("line_no", "noise", "word", "meant")).alias("found"))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, found in zip(pdf[content], pdf["found"], strict=True):
                noise: dict[int, set[str]] = {}
                meant: dict[int, dict[str, str]] = {}
                for r in found if found is not None else ():
                    noise.setdefault(r["line_no"] - 1, set()).add(r["noise"])
                    if r["meant"] is not None:
                        meant.setdefault(r["line_no"] - 1, {})[r["word"]] = r["meant"]
                out.append(paragraphs(text.split("\n"), noise, meant) if text else text)
            yield pd.DataFrame({key: pdf[key], content: out})

    return texts.select(key, content).join(per, key, "left").mapInPandas(run, f"{key} {kind}, {content} string")

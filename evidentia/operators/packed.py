"""Cells that pack several values: segmentation learned from the whole column.

A cell is cut into atoms at every sign that may delimit. Neighbouring atoms form a lattice whose
edges are candidate values. Expectation-maximisation learns, for each column, how often a value
(by its text and by its shape) and how often a delimiter occurs; a Viterbi pass then takes the
likeliest split of each cell. Quoted spans and JSON arrays are atomic.

All learned frequencies live in count sketches of fixed size (``BUCKETS`` counts of a kind; two of
them for values, of which the smaller count holds), so what the driver gathers and what it sends to
the tasks has the same bound whatever the column holds.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import spread, widen

BUCKETS = 1 << 19
KINDS = ("total", "value", "value_2", "shape", "split", "join")
#: signs that may delimit; ``and`` and the ampersand only between blanks, a blank only before a URL
DELIMITER = re.compile(r"\r?\n|[;|\t,]|\s&\s|\sand\s|(?<=[^\s;|,]) +(?=\"?https?://)")
HARD = frozenset("\n|;\t")
NEW_WORD = 0.02
SHORT = 8  # atoms of a value that needs no support; longer ones must have been seen, as text or shape
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def _quoted_end(cell: str, at: int) -> int:
    """The position after the closing quote of the span opened at ``at``, or -1."""
    i, n = at + 1, len(cell)
    while i < n:
        if cell[i] == '"':
            if i + 1 < n and cell[i + 1] == '"':
                i += 2
                continue
            rest = cell[i + 1 :]
            stripped = rest.lstrip("  ")
            if not stripped or DELIMITER.match(rest) or DELIMITER.match(stripped):
                return i + 1
            return -1
        i += 1
    return -1


def atoms_of(cell: str) -> tuple[list[tuple[str, bool]], list[str]]:
    """Atoms as (text, quoted), and the delimiters between them."""
    out: list[tuple[str, bool]] = []
    signs: list[str] = []
    i = start = 0
    n = len(cell)
    while True:
        j = i
        while j < n and cell[j] in "  ":
            j += 1
        if j < n and cell[j] == '"' and (end := _quoted_end(cell, j)) > 0:
            out.append((cell[j + 1 : end - 1].replace('""', '"').strip(), True))
            m = DELIMITER.search(cell, end)
        else:
            m = DELIMITER.search(cell, i)
            out.append((cell[start : m.start() if m else n], False))
        if not m:
            return out, signs
        signs.append(m.group())
        i = start = m.end()


def as_json(cell: str) -> list[str] | None:
    if cell[:1] != "[":
        return None
    try:
        got = json.loads(cell)
    except ValueError:
        return None
    if not isinstance(got, list) or any(isinstance(x, (dict, list)) for x in got):
        return None
    return [str(x).strip() for x in got if x is not None and str(x).strip()]


@lru_cache(200_000)
def shape(value: str) -> tuple[str, int]:
    """Word kinds (A capitalised, I initial, U upper, w lower, 9 digits; signs stay) and words."""
    out: list[str] = []
    words = WORD.findall(value)
    for w in words:
        if w[0].isdigit():
            k = "9"
        elif not w[0].isalpha():
            k = w
        elif len(w) == 1:
            k = "I" if w.isupper() else "i"
        elif w.isupper():
            k = "U" if len(w) > 3 else "V"
        elif w[0].isupper():
            k = "A"
        else:
            k = "w"
        if out[-2:] == [k, k] and k in "Aw":
            continue
        out.append(k)
    return " ".join(out), len(words)


def _sign_kind(sign: str) -> str:
    s = sign.strip(" ")
    return {"\r\n": "\n", "": " "}.get(s, s)


class _Model:
    """Log frequencies behind fixed hashes; ``tables`` maps a kind to an array of counts."""

    def __init__(self, tables: dict[str, np.ndarray] | None):
        self.tables, self.memo = tables, {}

    @staticmethod
    @lru_cache(200_000)
    def bucket(column: str, key: str) -> int:
        return xxhash.xxh64_intdigest(f"{column}\x00{key}") % BUCKETS

    @staticmethod
    @lru_cache(400_000)
    def value_buckets(column: str, text: str) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(f"{column}\x00{text.casefold()}")
        return h % BUCKETS, (h >> 32) % BUCKETS

    def value_score(self, column: str, text: str) -> float:
        """Log of an even mixture of the value's own frequency and that of its shape.

        One occurrence is taken off, so that a value cannot vouch for itself; a shape never seen
        costs a factor for each of its words.
        """
        got = self.memo.get((column, text))
        if got is None:
            t, (sh, words) = self.tables, shape(text)
            total = float(t["total"][self.bucket(column, "n")]) + 1.0
            a, b = self.value_buckets(column, text)
            seen = max(0.0, float(min(t["value"][a], t["value_2"][b])) - 1.0)
            alike = max(0.0, float(t["shape"][self.bucket(column, sh)]) - 1.0)
            got = math.log(0.5 * seen / total + 0.5 * (alike + NEW_WORD ** min(words, 60)) / total + 1e-90)
            if len(self.memo) < 500_000:
                self.memo[(column, text)] = got
        return got

    def supported(self, column: str, text: str) -> bool:
        """Whether a value or its shape has been counted more than once."""
        t = self.tables
        a, b = self.value_buckets(column, text)
        return min(t["value"][a], t["value_2"][b]) > 1.0 or t["shape"][self.bucket(column, shape(text)[0])] > 1.0

    def split_score(self, column: str, sign: str) -> tuple[float, float]:
        t = self.tables
        got = self.memo.get((column, "", sign))
        if got is None:
            yes = t["split"][self.bucket(column, sign)] + 0.5
            no = t["join"][self.bucket(column, sign)] + 0.5
            got = self.memo[(column, "", sign)] = (math.log(yes / (yes + no)), math.log(no / (yes + no)))
        return got


def _edges(column: str, atoms: list[tuple[str, bool]], signs: list[str], model: _Model) -> list[list[tuple[int, str]]]:
    """For each end atom the candidate values as (first atom, text).

    A value may have any number of atoms. Up to ``SHORT`` atoms every run is a candidate; a longer
    one is where it is supported by the counts: without support its score is that of new words
    only.
    """
    n = len(atoms)
    out: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for e in range(n):
        text = ""
        for b in range(e, -1, -1):
            part, quoted = atoms[b]
            if quoted:
                if b == e:
                    out[e].append((b, part))
                break
            text = part if b == e else part + signs[b] + text
            if b < e and (_sign_kind(signs[b]) in ("\n", "\t") or not part.strip()):
                break
            if e - b < SHORT or model.supported(column, text.strip()):
                out[e].append((b, text.strip()))
    return out


def _lattice(column: str, atoms, signs, model: _Model):
    edges = _edges(column, atoms, signs, model)
    scored = []
    for e, cands in enumerate(edges):
        row = []
        for b, text in cands:
            if not text:
                s = 0.0
            elif atoms[b][1]:
                s = -1.0
            else:
                s = model.value_score(column, text)
                for k in range(b, e):
                    s += model.split_score(column, _sign_kind(signs[k]))[1]
            if b > 0:
                s += model.split_score(column, _sign_kind(signs[b - 1]))[0]
            row.append((b, text, s))
        scored.append(row)
    return scored


def _viterbi(scored) -> list[str]:
    n = len(scored)
    best = [0.0] + [-math.inf] * n
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for e in range(n):
        for b, text, s in scored[e]:
            if best[b] + s > best[e + 1]:
                best[e + 1], back[e + 1] = best[b] + s, (b, text)
    out, i = [], n
    while i:
        b, text = back[i]
        out.append(text)
        i = b
    return out[::-1]


def _log_sum(xs: list[float]) -> float:
    m = max(xs)
    return m if m == -math.inf else m + math.log(sum(math.exp(x - m) for x in xs))


def _posteriors(scored) -> Iterator[tuple[int, int, str, float]]:
    """(first atom, last atom, value, probability) by forward-backward."""
    n = len(scored)
    f = [0.0] + [-math.inf] * n
    for e in range(n):
        f[e + 1] = _log_sum([f[b] + s for b, _, s in scored[e]])
    g = [-math.inf] * n + [0.0]
    for e in range(n - 1, -1, -1):
        for b, _, s in scored[e]:
            g[b] = _log_sum([g[b], s + g[e + 1]])
    for e in range(n):
        for b, text, s in scored[e]:
            p = math.exp(min(0.0, f[b] + s + g[e + 1] - f[n]))
            if p > 1e-4:
                yield b, e, text, p


class _Counts:
    def __init__(self) -> None:
        self.t: dict[tuple[int, int], float] = {}

    def add(self, kind: str, bucket: int, w: float) -> None:
        k = (KINDS.index(kind), bucket)
        self.t[k] = self.t.get(k, 0.0) + w

    def value(self, column: str, text: str, w: float) -> None:
        b = _Model.bucket
        self.add("total", b(column, "n"), w)
        first, second = _Model.value_buckets(column, text)
        self.add("value", first, w)
        self.add("value_2", second, w)
        self.add("shape", b(column, shape(text)[0]), w)


def _seed(column: str, cell: str, n: float, counts: _Counts) -> None:
    """First counts, without a model: cells whose reading is certain teach the most.

    Quoted values and JSON arrays are certain; hard signs split; a comma or a conjunction is as
    likely to split as not, and only where the cell has no hard sign.
    """
    got = as_json(cell)
    if got is not None:
        for v in got:
            counts.value(column, v, n)
        return
    atoms, signs = atoms_of(cell)
    kinds = {_sign_kind(s) for s in signs}
    hard = bool(kinds & HARD)
    run: list[str] = []
    for k, (text, quoted) in enumerate(atoms):
        sign = signs[k] if k < len(signs) else "\n"
        if quoted:
            counts.value(column, text, n)
            run = []
        else:
            run.append(text)
            joined = _sign_kind(sign) not in HARD
            if not joined:
                v = "".join(run).strip()
                if v:
                    counts.value(column, v, n if hard or len(run) == 1 else 0.3 * n if len(run) == 3 else 0.01 * n)
                run = []
            else:
                run.append(sign)
        if k < len(signs):
            s = _sign_kind(sign)
            p = 0.99 if s in HARD or s == " " else 0.5 if quoted or not hard else 0.05
            counts.add("split", _Model.bucket(column, s), n * p)
            counts.add("join", _Model.bucket(column, s), n * (1 - p))


def _expect(column: str, cell: str, n: float, counts: _Counts, model: _Model) -> None:
    got = as_json(cell)
    if got is not None:
        for v in got:
            counts.value(column, v, n)
        return
    atoms, signs = atoms_of(cell)
    if not signs:  # one atom has one reading
        if atoms[0][0].strip():
            counts.value(column, atoms[0][0].strip(), n)
        return
    for b, e, text, p in _posteriors(_lattice(column, atoms, signs, model)):
        if text:
            counts.value(column, text, n * p)
        if b > 0:
            counts.add("split", _Model.bucket(column, _sign_kind(signs[b - 1])), n * p)
        for k in range(b, e):
            counts.add("join", _Model.bucket(column, _sign_kind(signs[k])), n * p)


def segment(column: str, cell: str, model: _Model) -> list[str]:
    """The values of one cell, in order, without empty ones."""
    got = as_json(cell)
    if got is None:
        atoms, signs = atoms_of(cell)
        got = _viterbi(_lattice(column, atoms, signs, model)) if signs else [t.strip() for t, _ in atoms]
    return [v for v in got if v]


def _count_pass(cells: DataFrame, tables: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    spark = cells.sparkSession
    sent = spark.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, model = _Counts(), _Model(sent.value)
        for pdf in batches:
            for column, cell, n in zip(pdf["field_name"], pdf["cell"], pdf["n"], strict=True):
                if sent.value is None:
                    _seed(column, cell, float(n), counts)
                else:
                    _expect(column, cell, float(n), counts, model)
        yield pd.DataFrame([(k, b, w) for (k, b), w in counts.t.items()], columns=["kind", "bucket", "w"])

    rows = cells.mapInPandas(run, "kind tinyint, bucket int, w double").groupBy("kind", "bucket").agg(F.sum("w").alias("w"))
    # a value must occur twice to count, so single ones need not be gathered
    rows = rows.where(~F.col("kind").isin(1, 2) | (F.col("w") > 1)).toPandas()
    out = {k: np.zeros(BUCKETS, dtype=np.float32) for k in KINDS}
    for k, part in rows.groupby("kind"):
        out[KINDS[int(k)]][part["bucket"].to_numpy()] = part["w"].to_numpy()
    sent.unpersist()
    return out


def learn(df: DataFrame, fields: list[str], rounds: int = 2) -> dict[str, np.ndarray]:
    """Fit the frequencies of all ``fields`` over all rows; equal cells count by their number."""
    cells = _cells(df, fields).groupBy("field_name", "cell").agg(F.count("*").alias("n"))
    cells = cells.repartition(spread(cells, 1))
    tables = _count_pass(cells, None)
    for _ in range(rounds):
        tables = _count_pass(cells, tables)
    return tables


def _cells(df: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    packs = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("cell")) for c in fields])
    return (
        df.select(*keep, F.explode(packs).alias("_p"))
        .select(*keep, "_p.field_name", "_p.cell")
        .where(F.length(F.trim("cell")) > 0)
    )


def unpack(df: DataFrame, key: str, fields: list[str], rounds: int = 2) -> DataFrame:
    """One row per value: (key, field_name, pos, item).

    Null, blank and delimiter-only cells give no row. ``pos`` counts the non-empty values of a cell
    from 1. Other columns of ``df`` are neither read nor kept, so their names cannot clash.
    Repeated rows repeat their values. An empty table gives an empty result.
    """
    tables = learn(df, fields, rounds)
    sent = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _Model(sent.value)
        for pdf in batches:
            out = []
            for k, column, cell in zip(pdf[key], pdf["field_name"], pdf["cell"], strict=True):
                out += [(k, column, i, v) for i, v in enumerate(segment(column, cell, model), 1)]
            yield pd.DataFrame(out, columns=[key, "field_name", "pos", "item"])

    kind = df.schema[key].dataType.simpleString()
    cells = _cells(df, fields, key)
    return widen(cells).mapInPandas(run, f"{key} {kind}, field_name string, pos int, item string")

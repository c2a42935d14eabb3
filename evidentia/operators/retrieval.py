"""Ranking: BM25 keyword search, cosine top-k, partitioned and diverse retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from evidentia.functions.text import _col
from evidentia.session import widen

K1, B = 1.2, 0.75
MAX_TOKEN_BYTES = 40
QUERY_BLOCK = 1_000  # query vectors sent to all tasks at once
BROADCAST_ROWS = 100_000  # queries sent to all tasks at once; more are joined by shuffles


def tokens(c: str | Column) -> Column:
    """Lower-case runs of letters and digits, those of more than 40 bytes dropped."""
    return F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf): the index of all terms; pairs are counted before they are shuffled."""
    terms = widen(docs.select(key, text)).select(key, F.explode(tokens(text)).alias("term"))
    return terms.groupBy("term", key).agg(F.count("*").alias("tf"))


def term_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df, tf): in how many documents a term occurs, and how often.

    Each document gives its terms and its distinct terms; both fold to one row a term before the
    shuffle, so no pair of term and document leaves its partition.
    """
    t = widen(docs.select(key, text)).select(tokens(text).alias("_t"))
    seen = t.select(F.explode(F.array_distinct("_t")).alias("term"), F.lit(1).alias("df"), F.lit(0).alias("tf"))
    used = t.select(F.explode("_t").alias("term"), F.lit(0).alias("df"), F.lit(1).alias("tf"))
    return seen.unionAll(used).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query: str = "query", offset: int = 0, min_score: float = 0.0) -> DataFrame:
    """(query_key, key, rank, score): the ``k`` best documents of each query after ``offset``.

    Exact BM25 over distinct query terms. Only postings of terms that a query asks for leave their
    partition. Ties go to the smaller key.
    """
    docs = widen(docs.select(key, text))
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(query))).alias("term"))
    terms = asked.select("term").distinct()
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # with few terms their weights are few too: the hits of a common term are not shuffled to one task
    sent = F.broadcast if few else lambda d: d
    # one pass over the texts for lengths, one for the postings of the asked terms
    sizes = docs.select(F.size(tokens(text)).alias("dl")).where("dl >= 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    row = docs.select(key, tokens(text).alias("_t")).select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term"))
    hits = row.join(F.broadcast(terms) if few else terms, "term").groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(sizes)).select("term", "avg_dl", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = hits.join(sent(idf), "term").select("term", key, (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))).alias("w"))
    scores = weighed.join(sent(asked), "term").groupBy(query_key, key).agg(F.sum("w").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key))
    ranked = scores.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + k) & (F.col("score") > min_score))
    return ranked.select(query_key, key, "rank", "score")


def similarities(items: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", keep: int | None = None, part: str | None = None) -> DataFrame:
    """(query_key, key, part, similarity) of a query set against all items.

    ``queries`` holds (query_key, query_vector). They are sent to all tasks in blocks of
    ``QUERY_BLOCK``; each batch of items meets a block in one matrix product. With ``keep`` a batch
    gives only its own ``keep`` best of each query (and ``part``), ties included, so no more than
    that leaves it. Null and zero vectors come last, at minus infinity.
    """
    kinds = {c: items.schema[c].dataType.simpleString() for c in (key, *([part] if part else []))}
    schema = ", ".join([f"{query_key} {queries.schema[query_key].dataType.simpleString()}", *[f"{c} {t}" for c, t in kinds.items()], "similarity double"])
    own = items.select(*kinds, F.col(vector).cast("array<double>").alias("_v"))
    asked = queries.select(query_key, F.col("query_vector").cast("array<double>").alias("_q"))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for n in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == n).collect()
        got = own.mapInPandas(_compared([(r[0], r[1]) for r in rows], list(kinds), query_key, keep, part), schema)
        out = got if out is None else out.unionByName(got)
    return out


def _unit(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which of them are null or zero."""
    m = np.array([v if v is not None and len(v) == size else np.zeros(size) for v in vectors], float).reshape(len(vectors), size)
    norm = np.linalg.norm(m, axis=1)
    return m / np.where(norm > 0, norm, 1.0)[:, None], norm == 0


def _compared(asked: list[tuple], columns: list[str], query_key: str, keep: int | None, part: str | None):
    size = max((len(v) for _, v in asked if v is not None), default=0)
    unit, empty = _unit([v for _, v in asked], size)

    def best(sim: np.ndarray) -> np.ndarray:
        if keep is None or len(sim) <= keep:
            return np.arange(len(sim))
        rounded = np.round(sim, 9)
        return np.flatnonzero(rounded >= np.partition(rounded, len(sim) - keep)[len(sim) - keep])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors, none = _unit(pdf["_v"].tolist(), size)
            sims = vectors @ unit.T
            sims[none, :] = -np.inf
            sims[:, empty] = -np.inf
            groups = [np.arange(len(pdf))] if part is None else [np.asarray(g) for g in pdf.groupby(part, dropna=False).indices.values()]
            out = []
            for j, (q, _) in enumerate(asked):
                for g in groups:
                    at = g[best(sims[g, j])]
                    one = pdf[columns].iloc[at].copy()
                    one.insert(0, query_key, q)
                    one["similarity"] = sims[at, j]
                    out.append(one)
            yield pd.concat(out) if out else pd.DataFrame(columns=[query_key, *columns, "similarity"])

    return run


def cosine_top_k(items: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """The ``k`` most similar items of each query; ties go to the smaller key."""
    s = similarities(items, queries, key, vector, query_key, keep=k)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("similarity", 9)), key))
    return s.withColumn("rank", rank).where(F.col("rank") <= k)


def partitioned_top_k(scored: DataFrame, part: str, k: int, query_key: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Ranks within each part, parts interleaved in ascending order, cut to ``k``."""
    within = F.row_number().over(Window.partitionBy(query_key, part).orderBy(F.desc(F.round("similarity", 9)), key))
    kept = scored.withColumn("within", within).where(F.col("within") <= k)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy("within", part))
    return kept.withColumn("rank", rank).where(F.col("rank") <= k)


def retrieve(items: DataFrame, deleted: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", **kw) -> DataFrame:
    """Top ``k`` of what is not deleted: the deleted go before ranking."""
    return cosine_top_k(items.join(deleted.select(key), key, "left_anti"), queries, k, key, **kw)


def diverse(fetched: DataFrame, k: int, trade: float, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """Maximal marginal relevance among the fetched rows of each query.

    ``fetched`` holds (query_key, key, vector, similarity), a bounded number a query. With
    ``trade`` at 1, or no more rows than ``k``, all are kept by similarity. True cosine is used.
    """
    if trade >= 1:
        rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("similarity"), key))
        return fetched.withColumn("rank", rank).select(query_key, key, "rank")
    qk, kk = (fetched.schema[c].dataType.simpleString() for c in (query_key, key))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["similarity", key], ascending=[False, True]).reset_index(drop=True)
        m = np.array(pdf[vector].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        sim, chosen, rest = pdf["similarity"].to_numpy(), [0], list(range(1, len(pdf)))
        if len(pdf) <= k:
            chosen += rest
            rest = []
        while rest and len(chosen) < k:
            near = (m[rest] @ m[chosen].T).max(axis=1)
            best = rest[int(np.argmax(trade * sim[rest] - (1 - trade) * near))]
            chosen.append(best)
            rest.remove(best)
        return pd.DataFrame({query_key: pdf[query_key].iloc[0], key: pdf[key].iloc[chosen].to_numpy(), "rank": range(1, len(chosen) + 1)})

    return fetched.select(query_key, key, vector, "similarity").groupBy(query_key).applyInPandas(pick, f"{query_key} {qk}, {key} {kk}, rank int")


def best_evidence(contexts: DataFrame, n: int, cutoff: int = 1) -> DataFrame:
    """The best contexts: by score, then name; at or above the cutoff."""
    return contexts.where(F.col("score") >= cutoff).orderBy(F.desc("score"), "name", "ctx_id").limit(n)


def hashed_terms(c: str | Column, dims: int = 256) -> Column:
    """A sparse embedding: term counts by hash. Null texts have a zero vector."""

    @F.pandas_udf(ArrayType(FloatType()))
    def counted(cells: pd.Series) -> pd.Series:
        return cells.map(lambda x: np.bincount(x, minlength=dims).astype(np.float32) if x is not None and len(x) else np.zeros(dims, np.float32), na_action=None)

    return counted(F.transform(tokens(c), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")))

"""Places where a model plugs in, with offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.replies import parse_reply
from evidentia.operators.retrieval import hashed_terms

SKIP_SCORE = 5


def sparse_embedding(dims: int = 256) -> Callable[[str], Column]:
    """Hashed term counts: built in, no model."""
    return lambda c: hashed_terms(c, dims)


def dense_embedding(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[str], Column]:
    """An embedding by a model that each worker loads once."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()))

    return lambda c: embed(c)


def hybrid_embedding(dense: Callable[[str], Column], dims: int = 256) -> Callable[[str], Column]:
    return lambda c: F.concat(dense(c), hashed_terms(c, dims))


EMBEDDINGS: dict[str, Callable[..., Callable[[str], Column]]] = {"sparse": sparse_embedding, "hybrid": hybrid_embedding, "dense": dense_embedding}


def embedding(name: str, **kw) -> Callable[[str], Column]:
    """By name: sparse, or a prefix and a registered model."""
    kind, _, rest = name.partition("-")
    if name == "sparse" or kind == "sparse":
        return sparse_embedding(int(rest) if rest.isdigit() else 256)
    if kind == "hybrid":
        return hybrid_embedding(embedding(rest, **kw))
    if kind in EMBEDDINGS and kind != "sparse":
        return EMBEDDINGS[kind](**kw)
    return EMBEDDINGS[name](**kw)


def skip_summary(chunks: DataFrame) -> DataFrame:
    """Evidence without a model: the chunk itself, its outer line breaks off, scored 5."""
    return chunks.withColumn("context", F.btrim("text", F.lit("\n"))).withColumn("score", F.lit(SKIP_SCORE))


def summarise(chunks: DataFrame, question: str, load: Callable[[], Callable[[str, str], str]], retries: int = 1) -> DataFrame:
    """Evidence by a model: its reply read as JSON, tried again once where that fails.

    A chunk whose reply cannot be read keeps score -1 and a null context.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields) + ", context string, score int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for pdf in batches:
            contexts, scores = [], []
            for text in pdf["text"]:
                got = None
                for _ in range(retries + 1):
                    got = parse_reply(ask(question, text))
                    if got is not None:
                        break
                contexts.append(None if got is None else got.get("summary"))
                scores.append(-1 if got is None else int(got.get("relevance_score", SKIP_SCORE)))
            yield pdf.assign(context=contexts, score=pd.array(scores, dtype="int32"))

    return chunks.mapInPandas(run, schema)


def caption(media: DataFrame, load: Callable[[], Callable[[bytes, str], str]]) -> DataFrame:
    """Media with captions by a model, from (.., data, context)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema.fields) + ", caption string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell = load()
        for pdf in batches:
            yield pdf.assign(caption=[tell(bytes(d), c) for d, c in zip(pdf["data"], pdf["context"], strict=True)])

    return media.mapInPandas(run, schema)


def proposed_searches(question: str, propose: Callable[[str], str] | None = None) -> list[str]:
    """Search strings: a model's lines, or the question itself."""
    import re

    if propose is None:
        return [question]
    lines = [x for x in propose(question).split("\n") if len(x.strip()) > 3]
    return [re.sub(r"[\"\[\]]", "", re.sub(r"^\s*\d+\.\s*", "", x)).strip() for x in lines]

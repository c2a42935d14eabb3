"""A question from search to cited answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.metadata import context_id
from evidentia.operators import retrieval
from evidentia.operators.filters import new_evidence
from evidentia.plans import models
from evidentia.sources.collection import Corpus
from evidentia.sources.settings import Settings

CANNOT_ANSWER = "I cannot answer this question due to insufficient information."
MIN_CONTEXT = 10
EVIDENCE = "ctx_id string, question string, dockey string, chunk_ix int, name string, context string, score int"


def context_text(contexts: DataFrame, settings: Settings) -> str:
    """The best evidence as one text with the valid keys at its end; the rows are few by the limit."""
    best = retrieval.best_evidence(contexts, settings.max_sources, settings.score_cutoff)
    rows = best.select("ctx_id", "question", "name", "context").collect()
    if settings.group_by_question:
        parts: dict[str, list[str]] = {}
        for r in rows:
            parts.setdefault(r["question"], []).append(f"{r['ctx_id']}: {r['context']}\nFrom {r['name']}")
        body = "\n\n".join(f'Contexts related to the question: "{q}"\n\n' + "\n\n".join(x) for q, x in parts.items())
    else:
        body = "\n\n".join(f"{r['ctx_id']}: {r['context']}\nFrom {r['name']}" for r in rows)
    keys = f"\n\nValid Keys: {', '.join(r['ctx_id'] for r in rows)}" if rows else ""
    extra = f"\n\nContext {settings.background}" if settings.background else ""
    return body + extra + keys


def cited(answers: DataFrame, contexts: DataFrame, docs: DataFrame, prefix: str = "pqac") -> DataFrame:
    """(session, answer, bibliography): ids become names, unknown ids go, references are numbered
    in order of first citation."""
    from evidentia.functions.text import citation_ids

    ids = answers.select("session", F.posexplode(citation_ids("raw_answer", prefix)).alias("pos", "ctx_id"))
    known = contexts.join(docs.select("dockey", "citation"), "dockey").select("ctx_id", "name", "citation").dropDuplicates(["ctx_id"])
    met = ids.join(known, "ctx_id", "left")
    per = met.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", "ctx_id", "name", "citation"))).alias("cites"))
    both = answers.join(per, "session", "left")
    swapped = F.aggregate(F.coalesce("cites", F.array().cast("array<struct<pos:int,ctx_id:string,name:string,citation:string>>")), F.col("raw_answer"), lambda t, c: F.replace(t, c["ctx_id"], F.coalesce(c["name"], F.lit(""))))
    tidy = F.regexp_replace(F.regexp_replace(swapped, r"\(\s*[,;\s]*\)", ""), r"\(\s*[,;]\s*|\s*[,;]\s*(?=\))", "")
    names = F.array_distinct(F.transform(F.filter("cites", lambda c: c["name"].isNotNull()), lambda c: F.concat(F.lit("("), c["name"], F.lit("): "), c["citation"])))
    lines = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return both.select("session", F.regexp_replace(tidy, r" +([.,;])", "$1").alias("answer"), F.array_join(lines, "\n\n").alias("bibliography"))


def inferred_citation(guess: str | None, file_name: str, year: str) -> str:
    """A citation guessed from the first pages, or a fallback where it is no use."""
    if not guess or len(guess) < 3 or "Unknown" in guess or "insufficient" in guess.lower():
        return f"Unknown, {file_name}, {year}"
    return guess


@dataclass
class Session:
    """The state of one question over a corpus; the tools are its methods."""

    spark: SparkSession
    corpus: Corpus
    settings: Settings = field(default_factory=Settings)
    score: Callable[[DataFrame, str], DataFrame] | None = None
    generate: Callable[[str, str], str] | None = None
    on_event: dict[str, Callable[[Session], None]] = field(default_factory=dict)
    contexts: DataFrame | None = None
    history: list[list[str]] = field(default_factory=list)
    answer: str = ""
    raw_answer: str = ""
    successful: bool | None = None

    def __post_init__(self) -> None:
        if self.contexts is None:
            self.contexts = self.spark.createDataFrame([], EVIDENCE)

    def _note(self, tool: str) -> None:
        self.history.append([tool])
        if tool in self.on_event:
            self.on_event[tool](self)

    def paper_search(self, found: DataFrame, chunks: DataFrame) -> None:
        """Take what a search found into the corpus."""
        self.corpus = self.corpus.add(found, chunks)
        self._note("paper_search")

    clinical_trials_search = paper_search

    def gather_evidence(self, question: str) -> DataFrame:
        """Retrieve chunks, score them and keep the new relevant ones."""
        embed = models.embedding(self.settings.embedding)
        items = self.corpus.visible().withColumn("key", F.concat_ws("|", "dockey", F.col("chunk_ix").cast("string"))).withColumn("vector", embed("text"))
        asked = self.spark.createDataFrame([(0, question)], "query_id int, q string").select("query_id", embed("q").alias("query_vector"))
        k = self.settings.evidence_k
        fetched = retrieval.cosine_top_k(items, asked, 2 * k if self.settings.mmr_lambda < 1 else k, "key", "vector")
        if self.settings.mmr_lambda < 1:
            picked = retrieval.diverse(fetched.join(items.select("key", "vector"), "key"), k, self.settings.mmr_lambda, "key", "vector")
        else:
            picked = fetched
        chosen = items.join(picked.select("key"), "key", "left_semi").select("dockey", "chunk_ix", "name", "text")
        scored = self.score(chosen, question) if self.score else models.skip_summary(chosen)
        evidence = scored.select(context_id(F.lit(question), "context", f"{self.settings.context_prefix}-").alias("ctx_id"), F.lit(question).alias("question"), "dockey", "chunk_ix", "name", "context", F.col("score").cast("int").alias("score"))
        self.contexts = self.contexts.unionByName(new_evidence(evidence, self.contexts))
        self._note("gather_evidence")
        return self.contexts

    def gen_answer(self, question: str, post: Callable[[str], str] | None = None) -> str:
        """Answer from the evidence; too little of it gives a fixed refusal without a model."""
        text = context_text(self.contexts, self.settings)
        if len(text) < MIN_CONTEXT or self.generate is None and not text:
            self.raw_answer = f"{CANNOT_ANSWER}"
        else:
            self.raw_answer = self.generate(question, text) if self.generate else text
        if post is not None:
            self.raw_answer = f"{self.raw_answer}\n\n{post(self.raw_answer)}"
        rows = self.spark.createDataFrame([("s", self.raw_answer)], "session string, raw_answer string")
        got = cited(rows, self.contexts, self.corpus.docs, self.settings.context_prefix).first()
        self.answer = got["answer"] + (f"\n\nReferences\n\n{got['bibliography']}" if got["bibliography"] else "")
        self._note("gen_answer")
        return self.answer

    def reset(self) -> None:
        self.contexts = self.spark.createDataFrame([], EVIDENCE)
        self._note("reset")

    def complete(self, successful: bool) -> str:
        self.successful = successful
        self._note("complete")
        return self.answer

    def attempts(self, tool: str) -> int:
        return sum(t == tool for call in self.history for t in call)

    def status(self) -> str:
        r = self.contexts.agg(F.countDistinct("dockey").alias("relevant"), F.count("*").alias("n")).first()
        return f"Status: Paper Count={self.corpus.docs.count()} | Relevant Papers={r['relevant']} | Current Evidence={r['n']}"


def run_fixed(session: Session, question: str, search: Callable[[str], tuple[DataFrame, DataFrame]], propose: Callable[[str], str] | None = None) -> str:
    """Up to three searches, evidence, an answer: no model chooses the steps."""
    for q in models.proposed_searches(question, propose)[:3]:
        session.paper_search(*search(q))
    session.gather_evidence(question)
    session.gen_answer(question)
    return session.complete(CANNOT_ANSWER not in session.raw_answer)


def log_answer(session: Session, question: str, path: str) -> None:
    """Append an answer to the log of answers, which can be searched like any index."""
    row = [(question, session.answer, session.raw_answer, session.successful, session.settings.fingerprint())]
    session.spark.createDataFrame(row, "question string, answer string, raw_answer string, has_successful_answer boolean, settings_md5 string").write.mode("append").parquet(path)


def short_message(answer: str, limit: int = 280) -> str:
    """The first sentences of an answer within the limit."""
    parts = re.split(r"(?<=[.!?])\s+", answer.split("\n\nReferences")[0])
    return reduce(lambda a, b: f"{a} {b}".strip() if len(a) + len(b) < limit else a, parts, "")


def shown(df: DataFrame, cell: int = 2000, n: int = 20) -> str:
    """A result table as text, cells cut."""
    return df._show_string(n, cell, False)

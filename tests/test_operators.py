import random

import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunking, filters, geometry, joins, merge, retrieval


@pytest.mark.parametrize(
    ("criteria", "wanted"),
    [({"a": "x"}, [1]), ({"!a": "x"}, [2, 3]), ({"?a": "x"}, [1, 3]), ({"b": 1}, []), ({"?b": 1}, [1, 2, 3]), ({"a": "x", "?!n": 1}, []), ({"?!a": "y"}, [1, 3])],
)
def test_criteria(spark, criteria, wanted):
    df = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, None, 1)], "id int, a string, n int")
    assert sorted(r["id"] for r in filters.filter_documents(df, [criteria]).collect()) == wanted


def _slide(pages, c, o):
    """Sliding windows over pages, by a loop."""
    out, split, seen = [], "", []
    for no, text in pages:
        split += text
        seen.append(no)
        while len(split) > c:
            out.append((f"pages {seen[0]}-{seen[-1]}", split[:c]))
            split = split[c - o :]
            seen = [no]
    if len(split) > o or not out:
        out.append((f"pages {seen[0]}-{pages[-1][0]}", split[:c]))
    return out


def test_overlap_chunks_match_a_loop(spark):
    rng = random.Random(3)
    docs = {k: [(i + 1, "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 60)))) for i in range(rng.randrange(1, 6))] for k in range(40)}
    df = spark.createDataFrame([(k, no, t) for k, p in docs.items() for no, t in p], "dockey int, page_no int, text string")
    got = {}
    for r in chunking.overlap_chunks(df, 20, 5).collect():
        got.setdefault(r["dockey"], {})[r["chunk_ix"]] = (r["name"], r["text"])
    for k, pages in docs.items():
        assert [got[k][i] for i in range(len(got[k]))] == _slide(pages, 20, 5)


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError):
        chunking.text_chunks(spark.range(1).select(F.lit(1).alias("dockey"), F.lit("a").alias("text")), 5, 5)


def _fold(a, b):
    prefer_b = not (a["publication_date"] and b["publication_date"]) or a["publication_date"] <= b["publication_date"]
    out = {}
    for k in a:
        if k in ("citation_count", "publication_date"):
            v = [x for x in (a[k], b[k]) if x is not None]
            out[k] = max(v) if v else None
        elif k == "authors" and a[k] and b[k]:
            out[k] = a[k] if sum(map(len, a[k])) >= sum(map(len, b[k])) else b[k]
        else:
            out[k] = b[k] if b[k] not in (None, []) and prefer_b else a[k]
    return out


def test_merge_matches_a_fold(spark):
    import datetime as dt

    rng = random.Random(5)
    rows = []
    for i in range(120):
        rows.append((i % 15, i, rng.choice([None, 0, 3, 9]), rng.choice([None, dt.datetime(2020, 1, 1 + rng.randrange(9))]), rng.choice([None, "A", "B"]), rng.choice([None, [], ["x"], ["yy", "z"]])))
    df = spark.createDataFrame(rows, "work int, record_id int, citation_count int, publication_date timestamp, journal string, authors array<string>")
    got = {r["work"]: r.asDict() for r in merge.merge_records(df, "work", ["record_id"]).collect()}
    for w in range(15):
        recs = [dict(zip(("citation_count", "publication_date", "journal", "authors"), r[2:], strict=True)) for r in rows if r[0] == w]
        want = recs[0]
        for r in recs[1:]:
            want = _fold(want, r)
        assert {k: got[w][k] for k in want} == want


def test_cluster_boxes(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0), (1, 1.05, 0.0, 2.0, 1.0), (1, 5.0, 5.0, 6.0, 6.0)], "page int, xmin double, ymin double, xmax double, ymax double")
    got = sorted((r["xmin"], r["xmax"], r["members"]) for r in geometry.cluster_boxes(df, "page", 0.1).collect())
    assert got == [(0.0, 2.0, 2), (5.0, 6.0, 1)]


def test_diverse_takes_unlike_rows(spark):
    df = spark.createDataFrame([(0, 1, [1.0, 0.0], 0.99), (0, 2, [1.0, 0.01], 0.98), (0, 3, [0.0, 1.0], 0.5)], "query_id int, vec_id int, embedding array<float>, similarity double")
    got = [r["vec_id"] for r in retrieval.diverse(df, 2, 0.5).orderBy("rank").collect()]
    assert got == [1, 3]


def test_zero_vector_comes_last(spark):
    items = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-1.0, 0.0])], "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert [r["vec_id"] for r in retrieval.cosine_top_k(items, q, 5).orderBy("rank").collect()] == [2, 1]


def test_bm25_plan_keeps_texts_out_of_shuffles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    q = spark.read.parquet(f"{sf}/eval_items.parquet")
    plan = retrieval.bm25(docs, q, 5, query_key="item_id", query="question")._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan


def test_authors_agree(spark):
    df = spark.createDataFrame([(["Jo Smith"], ["J. Smith"]), (["Ann Lee"], ["Bo Kim"]), (None, ["X"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(joins.authors_agree("a", "b")).collect()] == [True, False, False]


def test_sections_of_whole_texts(spark, sf):
    from evidentia.plans import reference

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text <> ''")
    n_chars = docs.selectExpr("sum(length(text))").first()[0]
    assert reference._contexts(spark, sf).selectExpr("sum(length(context))").first()[0] == n_chars
    assert {"agg5_sections", "agg6_joined_text", "ans2_context"} <= set(reference.queries()) & set(reference.oracle_sql())


def test_queries_over_all_titles(spark, tmp_path):
    from evidentia.plans import reference

    known = reference.queries()
    details = [(1, "Étude sur l’éléphant şehir", ["Žižek, Slavoj"], 2001, "Journal", "(Žižek et al. 2001) été", "zizek2001"), (2, "Ночные поезда города", ["Иванов, Пётр"], 2002, None, "поезда", "ivanov2002"), (3, "Night trains of towns", ["Smith, Ann"], 2003, "Journal", "plain", "smith2003")]
    spark.createDataFrame(details, "record_id bigint, title string, authors array<string>, pub_year int, journal string, citation string, docname string").write.parquet(f"{tmp_path}/doc_details.parquet")
    spark.createDataFrame([(1100, "Étude sur l’éléphant şehir"), (1200, "ночные поезда города"), (1300, "Nigth trains of towns")], "paper_id bigint, title string").write.parquet(f"{tmp_path}/s2_papers.parquet")
    best = {r["asked_id"]: (r["candidate_id"], r["similarity"]) for r in known["jn14_best_title"](spark, str(tmp_path)).collect()}
    assert best == {1100: (1, 1.0), 1200: (2, 1.0), 1300: (3, 0.6)}
    assert {(r["asked_id"], r["record_id"]) for r in known["hlp2_title_lookup"](spark, str(tmp_path)).collect()} == {(1100, 1), (1200, 2)}
    for name in ("str3_similarity", "str4_strip_citations", "str10_accents", "str13_bibtex_key", "str18_given_first", "str22_library_key"):
        assert {r["record_id"] for r in known[name](spark, str(tmp_path)).collect()} == {1, 2, 3}, name
    assert {r["record_id"]: r["plain"] for r in known["str10_accents"](spark, str(tmp_path)).collect()}[1] == "Etude sur l’elephant sehir"
    assert {r["record_id"]: r["name"] for r in known["str18_given_first"](spark, str(tmp_path)).collect()}[2] == "Пётр Иванов"


def test_titles_meet_without_rows_of_pairs(spark, monkeypatch):
    from evidentia.sources import providers

    rows = [(i, f"On the use of word{i % 7} in an era") for i in range(40)] + [(50, "Go to it"), (51, None), (52, " "), (9, "On the use of word2 in an era")]
    asked = [(100, "on the use of WORD3 in an era"), (101, "it to go"), (102, None), (103, "nothing alike"), (104, "The word2 era"), (105, "On the use of word2 in an era")]
    a, r = spark.createDataFrame(asked, "asked_id bigint, asked_title string"), spark.createDataFrame(rows, "record_id bigint, title string")
    monkeypatch.setattr(providers, "CHUNK_WORDS", 20)
    full = {}
    for q, x in asked:
        for k, y in rows:
            one, other = set((x or "").lower().split()), set((y or "").lower().split())
            if one & other:
                full[q, k] = len(one & other) / len(one | other)
    top = {q: min((-s, k) for (p, k), s in full.items() if p == q) for q in {q for q, _ in full}}
    for block in (1_000, 2):
        monkeypatch.setattr(providers, "TITLE_BLOCK", block)
        got = providers.by_title(a, r)
        # frequent words would give rows by the square
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((x["asked_id"], x["record_id"], x["similarity"]) for x in got.collect()) == sorted((*p, s) for p, s in full.items() if s >= 0.75)
        assert {x["asked_id"]: (x["candidate_id"], x["similarity"]) for x in providers.best_by_title(a, r).collect()} == {q: (k, round(-s, 9)) for q, (s, k) in top.items()}
    assert providers.by_title(a.limit(0), r).count() == providers.best_by_title(a, r.limit(0)).count() == 0


def test_best_title_of_every_paper(spark, tmp_path, monkeypatch):
    import random

    from evidentia.plans import reference
    from evidentia.sources import providers

    rng = random.Random(5)
    made = lambda: " ".join(rng.choice(("a", "an", "of", "Heat", "flow", "in", "towns", f"word{rng.randrange(30)}")) for _ in range(rng.choice((1, 3, 6, 9))))
    titles = [made() for _ in range(120)]
    papers = [made() for _ in range(80)] + titles[:20] + ["zzz", "", None, " ".join(f"Word{i}" for i in range(29))]
    spark.createDataFrame([(i, x) for i, x in enumerate([*titles, None])], "record_id bigint, title string").write.parquet(f"{tmp_path}/doc_details.parquet")
    spark.createDataFrame([(1001 + i, x) for i, x in enumerate(papers)], "paper_id bigint, title string").write.parquet(f"{tmp_path}/s2_papers.parquet")
    want = {}
    for q, x in enumerate(papers, 1001):
        for k, y in enumerate(titles):
            one, other = set((x or "").lower().split()), set(y.lower().split())
            if one & other:
                want[q] = min(want.get(q, (0, 0)), (-round(len(one & other) / len(one | other), 9), k))
    for left_out, long, block in ((1, 24, 2_000), (0, 4, 7), (2, 24, 7)):
        for name, n in (("LEFT_OUT", left_out), ("LONG", long), ("BEST_BLOCK", block)):
            monkeypatch.setattr(providers, name, n, raising=False)
        got = {r["asked_id"]: (-r["similarity"], r["candidate_id"]) for r in reference.queries()["jn14_best_title"](spark, str(tmp_path)).collect()}
        assert got == {q: (round(s, 6), k) for q, (s, k) in want.items()}
    assert set(range(1001, 1101)) - set(want) == set()

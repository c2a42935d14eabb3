import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("evidentia.llm")

from evidentia.llm import boosting, leaks, linkage, lookalikes, names, readability, representative, scans, splitting, tokens  # noqa: E402
from evidentia.llm.queries import queries  # noqa: E402

# Splitting


def _texts(spark, rows):
    return spark.createDataFrame(rows, "text_id bigint, content string, reader_config string, chunk_size int, chunk_overlap int, size string")


def test_pieces_rebuild_texts(spark):
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) + rng.choice(["", "", ".", ",\n", ".\n\n"]) for _ in range(n))
    rows = [
        (1, words(9000), '{"chunk_chars": "300", "overlap": 40}', None, None, "x"),
        (2, "x" * 20000, None, 1000, 100, "x"),
        (3, words(10), None, None, None, "x"),
        (4, words(9000), '{"chunk_chars": 0}', None, None, "x"),
        (5, None, None, None, None, "x"),
        (6, "", None, None, None, "x"),
        (7, "é 漢字。" * 4000, "{bad", 500, 900, "x"),
        (8, words(3000).replace("\n", "\r\n"), "{}", None, None, "x"),
    ]
    limits = {1: (300, 40), 2: (1000, 100), 7: (500, 499), 8: (5000, 250)}
    got = {}
    for r in splitting.split_texts(_texts(spark, rows)).collect():
        got.setdefault(r["text_id"], []).append(r)
    assert set(got) == set(limits)
    for k, pieces in got.items():
        text, (size, overlap) = next(r[1] for r in rows if r[0] == k), limits[k]
        pieces.sort(key=lambda r: r["piece_no"])
        assert [p["piece_no"] for p in pieces] == list(range(1, len(pieces) + 1))
        assert pieces[0]["begin"] == 0 and pieces[-1]["end"] == len(text)
        for p in pieces:
            assert p["piece"] == text[p["begin"] : p["end"]] and len(p["piece"]) <= size
        for a, b in zip(pieces, pieces[1:]):
            assert b["begin"] == a["end"] - overlap and b["end"] > a["end"]
            if k in (1, 8):
                assert text[a["end"] - 1].isspace()


def test_split_empty_table(spark):
    assert splitting.split_texts(_texts(spark, [])).count() == 0


def test_file_ranges_are_whole(spark, tmp_path):
    text = "".join(chr(random.Random(2).choice([97, 233, 28450, 128512, 10, 32])) for _ in range(30000))
    text += "".join(random.Random(4).choice("aé漢😀 \n") for _ in range(30000))
    (tmp_path / "big.txt").write_text(text, encoding="utf-8", newline="")
    files = spark.createDataFrame([(1, str(tmp_path / "big.txt"))], "text_id bigint, path string")
    rows = splitting.file_ranges(spark, files, "text_id", "path").orderBy("range_no").collect()
    assert len(rows) > 3
    assert "".join(r["body"] for r in rows) == text
    ranges = splitting.file_ranges(spark, files, "text_id", "path")
    sizes = spark.createDataFrame([(1, 700, 50)], "text_id bigint, size int, overlap int")
    lengths = splitting.prefix_lengths(splitting.boundary_table(ranges, "text_id"), "text_id")
    for p in splitting.emit(ranges, splitting.plan(ranges, sizes, "text_id"), lengths, "text_id").collect():
        assert p["piece"] == text[p["begin"] : p["end"]]


# Best values


def _records(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, doi string, retrieved_at timestamp, citation_count bigint, journal string, bibtex string, other string, work string")


def test_survivors(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    full, short, cut = "@article{a, title={x {Y}}, year = 2020}", '@misc{a, title="x", year={ }}', "@article{a, title={x}, ye"
    rows = [
        (3, "10.1/A", t(1), -1, " Known  Journal", short, '{"a": 1, "b": [], "c": null}', "w"),
        (5, "https://doi.org/10.1%2fa", t(2), 7, "known journal", full, "{'a': 1}", "w"),
        (8, "doi:10.1/a ", t(3), 7, "other", cut, '{"a": 1, "b": 2}', "w"),
        (9, None, t(3), 99, "known journal", full, "{}", "w"),
        (10, "10.2/solo", t(3), 99, "known journal", full, "{}", "w"),
        (11, "10.3/x", t(3), None, None, None, "[1]", "w"),
        (12, "10.3/X", t(3), -1, "", "", '{"a": NaN}', "w"),
    ]
    journals = spark.createDataFrame([("known journal", 1)], "clean_name string, line_no int")
    got = {tuple(r) for r in representative.survivors(_records(spark, rows), journals).collect()}
    assert got == {(3, "citation_count", 8), (3, "journal", 5), (3, "bibtex", 5), (3, "other", 8)}
    assert representative.survivors(_records(spark, []), journals).count() == 0


def test_currency_orders_untimed_values(spark):
    import datetime as dt

    rows = []
    for g in range(6):
        rows += [(10 * g, f"10.1/{g}", dt.datetime(2020, 1, 1), 1, "draft", None, None, "w"), (10 * g + 1, f"10.1/{g}", dt.datetime(2021, 1, 1), 1, "final", None, None, "w")]
    rows += [(90, "10.1/u", None, 1, "final", None, None, "w"), (91, "10.1/u", None, 1, "draft", None, None, "w")]
    got = {r["first_record_id"]: r["value"] for r in representative.current_values(_records(spark, rows), ["journal"]).collect()}
    assert got[90] == "final" and got[0] == "final"


# Look-alikes


def test_plain_forms(spark):
    rows = [
        (1, "Heat transfer after growth", ["Ann Lee"], "x"),
        (2, "Hеat transfer", ["Аnn Lee", None], "x"),  # Cyrillic e and A
        (3, "Ｈeat trans​fer", None, "x"),
        (4, "café", ["Zoë Å"], "x"),
        (5, "α-growth – naïve", [], "x"),
        (6, "Рост растений", ["Иван Рост"], "x"),
        (7, None, None, "x"),
        (8, "", ["ﬁne"], "x"),
        (8, "", ["ﬁne"], "x"),
        (9, "co‑op", ["Lee"], "x"),
    ]
    df = spark.createDataFrame(rows, "record_id bigint, title string, authors array<string>, plain string")
    got = {tuple(r) for r in lookalikes.found(df).collect()}
    assert got == {(2, "title"), (2, "authors"), (3, "title"), (4, "title"), (8, "authors"), (9, "title")}
    plain = {(r["record_id"], r["field_name"], r["pos"]): r["plain"] for r in lookalikes.plain_items(df).collect()}
    assert plain[2, "title", 0] == "Heat transfer" and plain[2, "authors", 0] == "Ann Lee"
    assert lookalikes.found(df.limit(0)).count() == 0


def test_base_form_keeps_joiners_of_scripts():
    assert lookalikes.base_form("می‌خواهم") == "می‌خواهم"
    assert lookalikes.base_form("a‌b") == "ab"


# Names


def test_name_pairs(spark):
    one = ["Robert Keller", "R. Keller", "Keller, Robert", "Bob Keller", "Keller RA", "R.Keller", "ROBERT KELLER", "Prof. Robert Keller", "Rob. Keller", "Robert Kelller"]
    other = ["Maria Jansen", "M. Jansen", "Jansen Maria"]
    group = ["The Alpha Study Group", "ALPHA Study Group", "Study Group of Alpha"]
    fill = [f"{g} {s}" for g in ("Robert", "Maria", "Anna") for s in ("Moe", "Roth", "Vogt", "Weiss", "Zimmer")]
    rows = [(s, 3 if s in ("Robert Keller", "Maria Jansen") else 1) for s in [*one, *other, *group, *fill]]
    got = {tuple(r) for r in names.pairs(spark.createDataFrame(rows, "spelling string, n bigint")).collect()}
    want = {(a, b) for part in (one, other, group) for a in part for b in part if a < b}
    assert want <= got
    assert not {(a, b) for a, b in got if (a in one) != (b in one)}
    assert names.pairs(spark.createDataFrame([], "spelling string, n bigint")).count() == 0


def test_mentions_skip_blanks(spark):
    a = spark.createDataFrame([(["x", None, " "],), (None,)], "authors array<string>")
    assert [tuple(r) for r in names.mentioned(a, spark.createDataFrame([("x",)], "item string")).collect()] == [("x", 2)]


# Linkage


def test_linkage(spark):
    rng = random.Random(4)
    drugs = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5)) + "lin" for _ in range(60)]
    people = [f"{a} {b}" for a in ("Ann", "Bo", "Cy") for b in ("Miller", "Fischer", "Olsen", "Weber")]
    left, right, want = [], [], set()
    for i, w in enumerate(drugs):
        who = [people[i % 12], people[(i * 5 + 1) % 12]]
        left.append((i, f"Effects of {w} on sleep in mice", who, 2000 + i % 20, "x"))
        left.append((1000 + i, f"Correction to: Effects of {w} on sleep in mice", who, 2000 + i % 20, "x"))
        if i % 2:
            right.append((5000 + i, f"EFFECTS of {w[:-1]}{w[-1] * 2} on sleep in mice", who[:1], 2000 + i % 20))
            want.add((i, 5000 + i))
    left += [(2000, None, None, None, "x"), (2001, "", [], 2001, "x"), (1, *left[2][1:])]
    schema = "record_id bigint, title string, authors array<string>, pub_year int, class string"
    a = spark.createDataFrame(left, schema)
    b = spark.createDataFrame(right, "paper_id bigint, title string, authors array<string>, pub_year int")
    got = linkage.link(a, b, "record_id", "paper_id").collect()
    assert {(r[0], r[1]) for r in got} == want
    assert all(0.5 <= r["confidence"] <= 1 for r in got)
    assert linkage.link(a.limit(0), b, "record_id", "paper_id").count() == 0


def test_linkage_of_one_title_by_many(spark, monkeypatch):
    monkeypatch.setattr(linkage, "HOT", 10)
    rng = random.Random(6)
    surname = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) + "sen"
    who = [f"Ann {surname()}" for _ in range(80)]
    left = [(i, "Editorial", [w], 1990 + i % 30) for i, w in enumerate(who)]
    right = [(500 + i, "editorial", [w], 1990 + i % 30) for i, w in enumerate(who) if i % 2]
    schema = "{} bigint, title string, authors array<string>, pub_year int"
    got = linkage.link(spark.createDataFrame(left, schema.format("record_id")), spark.createDataFrame(right, schema.format("paper_id")), "record_id", "paper_id")
    assert {(r[0], r[1]) for r in got.collect()} == {(i, 500 + i) for i in range(80) if i % 2}


def test_hot_keys_leave_no_pair_out(spark, monkeypatch):
    schema = "record_id bigint, title string, authors array<string>, pub_year int"
    left = [(i, "Editorial", None if i % 3 else [f"Vera Nachname{i}"], 2000 + i % 4) for i in range(23)]
    right = [(100 + i, "Editorial", None if i % 2 else [f"Otto Anders{i}"], None) for i in range(17)]
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    common = frozenset(["editorial"])
    ca, cb = (linkage._classes(linkage.features(x, "record_id", common)) for x in (a, b))
    n = ca.count() * cb.count()
    assert n > 20
    monkeypatch.setattr(linkage, "SAMPLE", 1)
    for hot in (2_000, 3, 1):
        monkeypatch.setattr(linkage, "HOT", hot)
        assert linkage._propose(ca, cb).count() == n


def test_linkage_phrases_without_blanks(spark):
    # a phrase in one of 2 222 records has its share of them at any size, so it must not propose pairs by itself
    many = spark.range(100_000).selectExpr("if(id % 2222 = 7, '泰萨林在高压下的行为 ', '') || 'w' || id as title")
    assert "泰萨林在高压下的行为" in linkage.common_words(many)
    schema = "{} bigint, title string, authors array<string>, pub_year int"
    names = [f"{x}{y}vinsen" for x in ("Bor", "Kal", "Mur", "Tel") for y in ("da", "fe", "go", "lu")]
    left = [(i, f"泰萨林在高压下的行为 {(i + 1) * 6173}", [f"Anna {x}"], 2001 + i) for i, x in enumerate(names)]
    right = [(100 + i, t.replace("压", "压压") if i == 3 else t, a, y) for i, t, a, y in left]
    got = linkage.link(spark.createDataFrame(left, schema.format("record_id")), spark.createDataFrame(right, schema.format("paper_id")), "record_id", "paper_id")
    assert {(r["record_id"], r["paper_id"]) for r in got.collect()} == {(i, 100 + i) for i in range(len(names))}


def test_linkage_keeps_no_shuffle_files_and_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(5))
    works = [(f"Effects of {word()} on {word()} in mice", [f"Ann {word()}", f"Bo {word()}"], 2000 + i % 9) for i in range(150)]
    a = spark.createDataFrame([(i, *w) for i, w in enumerate(works)], "record_id bigint, title string, authors array<string>, pub_year int")
    b = spark.createDataFrame([(900 + i, t.upper(), who[:1], y) for i, (t, who, y) in enumerate(works) if i % 2], "paper_id bigint, title string, authors array<string>, pub_year int")
    shuffled = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith(".data") and f.length()}
    before = shuffled()
    linked = linkage.link(a, b, "record_id", "paper_id")
    assert sum(f.startswith("shuffle_") for f in shuffled() - before) <= 40  # counts and samples only
    whole = {tuple(r) for r in linked.collect()}
    assert {r[:2] for r in whole} == {(i, 900 + i) for i in range(150) if i % 2}
    monkeypatch.setattr(linkage, "IN_FLIGHT", 2)
    monkeypatch.setattr(linkage, "RULED_OUT", 1.1)  # the first guess rules all out, so all matches are compared again
    assert {tuple(r) for r in linkage.link(a, b, "record_id", "paper_id").collect()} == whole


def test_titles_with_a_moved_blank_meet(spark):
    schema = "record_id bigint, title string, authors array<string>, pub_year int"
    who = ["Ann Miller", "Bo Fischer"]
    cases = [
        ("Early ulmrarine xposure shifts heat transfer", who, 2001, "Early ulmrarin exposure shifts heat transfer", who, 2002),  # a moved blank
        ("Limits of velrakethane in predicting frost damage", who, 2001, "Limits ofvelrakithane in predicting frost damage", who[:1], 2009),  # and one name, a far year
        ("Does ethraium improve air quality in old schools", None, 2001, "Doesethraiumi mprove air quality in old schools", who, 2001),  # and no names
        ("Is xylofen safe in dogs", who, 2001, "Isxylofem safe in dogs", who[:1], 2007),  # short
    ]
    a = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], schema)
    b = spark.createDataFrame([(i, *c[3:]) for i, c in enumerate(cases)], schema)
    common = frozenset("early exposure shifts heat transfer limits of in predicting frost damage does improve air quality old schools is safe dogs".split())
    fa, fb = linkage.features(a, "record_id", common), linkage.features(b, "record_id", common)
    met = linkage._propose(linkage._classes(fa), linkage._classes(fb))
    got = met.join(fa.select("class", "record_id"), "class").join(fb.select(F.col("class").alias("class_b"), F.col("record_id").alias("other")), "class_b")
    assert {r["record_id"] for r in got.collect() if r["record_id"] == r["other"]} == set(range(len(cases)))


def test_text_levels_equal_full_edit_distances(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(400):
        x = "".join(rng.choice("abcde") for _ in range(rng.choice((3, 14, 30, 60))))
        y = list(x)
        for _ in range(rng.randrange(9)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.randrange(2)] = rng.choice(("", "a", "f"))
        rows.append((x, "".join(y)[: rng.choice((99, 20))]))
    df = spark.createDataFrame(rows, "compact string, compact_b string").withColumn("rare_level", F.lit(0)).withColumn("marker", F.lit("")).withColumn("marker_b", F.lit("")).withColumn("was_cut", F.lit(False)).withColumn("was_cut_b", F.lit(False)).withColumn("short", F.expr("least(length(compact), length(compact_b))")).withColumn("long", F.expr("greatest(length(compact), length(compact_b))"))
    full = F.expr("case when compact = '' or compact_b = '' then 4 when compact = compact_b then 3 when levenshtein(compact, compact_b) <= greatest(2, long * 0.12) then 2 when levenshtein(left(compact, short), left(compact_b, short)) <= short * 0.08 + 1 and short >= 15 then 1 else 0 end")
    got = df.select(linkage._text_level().alias("got"), full.alias("full")).collect()
    assert all(r["got"] == r["full"] for r in got)
    assert len({r["got"] for r in got}) >= 4


# Scans


def test_noises(spark):
    rng = random.Random(8)
    vocabulary = "careful laboratory group measured several blood samples during winter months reported level continuous outcome study patient under normal conditions with mixed success".split()
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(8))

    def page(no, inside):
        body = [line() for _ in range(9)]
        return [f"Journal of Things, Vol. {no}", "", *body[:4], *inside, *body[4:], f"{line()}.", str(no)]

    texts, marks = [], {}
    for i in range(60):
        pages = [page(1, ["of the con-", "tinuous study reported under"]), page(2, ["a well-known out\xad", "come of the patient with"]), page(3, ["the lab0ratory and the gr0up were", "kept well-", "known during winter"])]
        texts.append((i, "\n\f".join("\n".join(p) for p in pages), "x"))
        flat = [x for p in pages for x in p]
        marks[i] = {(n, "header") for n, x in enumerate(flat, 1) if "Journal" in x} | {(n, "page_number") for n, x in enumerate(flat, 1) if x in ("1", "2", "3")}
        marks[i] |= {(n, "hyphen") for n, x in enumerate(flat, 1) if x.endswith(("con-", "\xad"))} | {(n, "char") for n, x in enumerate(flat, 1) if "0rat" in x}
    texts += [(100 + i, f"{line()}. {line()} well-known {line()}.\n12\n14\n15\n\n{line()}.", "x") for i in range(30)]
    texts += [(200, None, "x"), (201, "", "x"), (3, texts[3][1], "x")]
    df = spark.createDataFrame(texts, "text_id bigint, content string, noise string")
    got = scans.noises(df).where("text_id = 3 or text_id >= 100").collect()
    assert {(r["line_no"], r["noise"]) for r in got if r["text_id"] == 3} == marks[3]
    assert not [r for r in got if r["text_id"] >= 100]
    assert len(got) == len(marks[3])
    assert scans.noises(df.limit(0)).count() == 0


def test_words_misread_again_and_again_in_a_text(spark):
    rng = random.Random(8)
    vocabulary = "careful laboratory group measured several blood samples during winter months reported level continuous outcome study patient under normal conditions with mixed success".split()
    line = lambda: " ".join(rng.choice(vocabulary) for _ in range(8))
    page = lambda *inside: "\n".join([*(line() for _ in range(6)), *inside, *(line() for _ in range(5)), f"{line()}."])
    texts = [(i, page(line(), line(), line(), "the lab0ratory was under level")) for i in range(60)]
    texts.append((100, page(*["the lab0ratory was under level"] * 4)))
    texts.append((101, page(*["given velraketan during winter"] * 4)))
    got = scans.noises(spark.createDataFrame(texts, "text_id bigint, content string")).where("text_id >= 100").collect()
    assert {(r["text_id"], r["line_no"], r["noise"]) for r in got} == {(100, n, "char") for n in (7, 8, 9, 10)}


def test_misread_cost():
    assert scans.misread_cost("misdassification", "misclassification") == pytest.approx(0.3)
    assert scans.misread_cost("gr0up", "group") == pytest.approx(0.3)
    assert scans.misread_cost("abc", "abc") == 0


def test_boosting_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:400], y[:400])
    assert ((boosting.predict(model, x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert boosting.predict(boosting.fit(x[:5], np.ones(5)), x).min() > 0.9


# Tokens


def test_tokens_match_the_library(spark, sf):
    lib = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = lib.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(r["doc_id"], r["text"], "x") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None, "x"), (-2, "", "x"), (-3, "<|endoftext|>", "x"), (-4, "  \n\n ", "x"), (-5, "漢字 é😀" * 500, "x"), (-5, "漢字 é😀" * 500, "x"), (-6, "a" * 20000, "x")]
    got = tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    ranks = tokens.load_ranks()
    for r in got:
        assert r["ids"] == t.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert tokens.decode(r["ids"], ranks) == (text[r["doc_id"]] or "")


# Leaks


def test_leaks(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bdgklmnprstvz") + rng.choice("aeiou") for _ in range(5))
    items = []
    for i in range(40):
        a, b, c = name(), name(), name()
        p = f"Even where the {a} index fell below {rng.randrange(999)}, release of {b} raised the yield of {c} by {rng.randrange(999)} percent at night. Site {rng.randrange(999)} sent {rng.randrange(999)} tubes of {a}, of which many had lost {c} in the outer ring."
        items.append((i, f"By how many percent did {b} change the yield of {c} once the {a} index had dropped under a limit?", p))
    items += [(90, None, None), (91, "", "short one")]
    fill = "the quick study of many things went on for a long time without any result worth telling. "
    p = lambda i: items[i][2]
    docs = [
        (1, fill * 5 + p(1) + fill * 3, "x"),
        (2, fill + f"<p>{p(2).upper().replace(',', '')}</p>", "x"),
        (3, fill + p(3).split(". ")[0] + ". " + fill + p(3).split(". ")[1], "x"),
        (4, fill + items[4][1], "x"),
        (5, fill + " ".join(p(5).split()[:9]), "x"),
        (6, fill * 40, "x"),
        (7, None, "x"),
        (8, "", "x"),
        (9, fill * 3000 + p(9), "x"),
        (9, fill * 3000 + p(9), "x"),
        (10, p(10).replace("release of", "release at").replace("tubes", "boxes"), "x"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    q = spark.createDataFrame(items, "item_id bigint, question string, passage string")
    assert {tuple(r) for r in leaks.find(d, q).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (9, 9), (10, 10)}
    assert leaks.find(d, q.limit(0)).count() == 0
    assert leaks.find(d.limit(0), q).count() == 0


def test_lsh_recall_against_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/eval_items.parquet")
    got = {tuple(r) for r in leaks.find(docs, items).collect()}
    index = leaks.Index([tuple(r) for r in items.select("item_id", "question", "passage").collect()], leaks.common_words(items))
    want = {(r["doc_id"], it.item_id) for r in docs.collect() for w in [leaks.words_of(r["text"])] for it in index.items if len(it.names.intersection(w)) >= 3 and leaks.leaked(it, w)}
    assert len(got & want) >= 0.9 * len(want) and not got - want


# Reading level


def test_bands(spark):
    easy, hard = "The old dog ran. The cat sat by the door. " * 8, "Notwithstanding considerable methodological heterogeneity, the multidimensional characterisation systematically outperformed conventional approximations of interdependent physiological parameters. " * 5
    mid = "The medical team reported the number of visits in the winter months after several attempts at the local clinic. " * 5
    high = "The automated procedure compared the apparent distribution of the reaction under experimental conditions, although the committee reviewed conventional parameters. " * 5
    docs, labels = [], []
    for i in range(40):
        for b, t in enumerate((easy, mid, high, hard), 1):
            docs.append((4 * i + b, t, "x"))
            labels.append((4 * i + b, b if i else None))
    docs += [(900, None, "x"), (901, "", "x"), (902, "Too short.", "x"), (903, easy * 300, "x"), (903, easy * 300, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, reading_band string")
    got = readability.bands(d, spark.createDataFrame(labels, "doc_id bigint, reading_band int")).collect()
    by = {r["doc_id"]: r["reading_band"] for r in got}
    assert [by[k] for k in (5, 6, 7, 8)] == [1, 2, 3, 4] and by[903] == 1
    assert len(got) == 162 and not {900, 901, 902} & set(by)
    none = spark.createDataFrame([], "doc_id bigint, reading_band int")
    assert readability.bands(d, none).count() == 162
    assert readability.bands(d.limit(0), none).count() == 0


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("make", 1), ("table", 2), ("reading", 2), ("laboratory", 5), ("walked", 1), ("wanted", 2)])
def test_syllables(word, n):
    assert readability.syllables(word, "en") == n


# All queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.columns and df.count() > 0


def test_json_keys(spark):
    df = spark.createDataFrame([(x,) for x in ('{"a": 1}', "[1]", '{"a": "", "b": 0}', None, '{"a": 1} x', json.dumps({"k": {}}))], "other string")
    assert [r[0] for r in df.select(representative.json_keys("other")).collect()] == [1, None, 1, None, None, 0]
    assert df.select(F.lit(1)).count() == 6


def test_currency_closes_the_order_and_breaks_cycles(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2020, 1, d)
    rows, k = [], 0

    def add(doi, at, value):
        nonlocal k
        k += 1
        rows.append((k, doi, at, None, value, None, None, "w"))
        return k

    for g in range(4):  # draft -> proof -> final, and once the other way round
        add(f"10.1/a{g}", day(1), "draft"), add(f"10.1/a{g}", day(2), "proof")
        add(f"10.1/b{g}", day(1), "proof"), add(f"10.1/b{g}", day(2), "final")
    add("10.1/c", day(1), "final"), add("10.1/c", day(2), "draft")
    first = {
        "chain": add("10.2/u", None, "draft"), "beats": add("10.2/v", day(9), "draft"), "stays": add("10.2/w", day(9), "final"), "open": add("10.2/x", day(9), "elsewhere"),
    }
    add("10.2/u", None, "final"), add("10.2/v", None, "final"), add("10.2/w", None, "draft"), add("10.2/x", None, "final")
    got = {r["first_record_id"]: r["value"] for r in representative.current_values(_records(spark, rows), ["journal"]).collect()}
    assert got[first["chain"]] == "final"  # by way of a value that its group doesn't hold
    assert got[first["beats"]] == "final"  # an untimed value that follows a timed one
    assert got[first["stays"]] == "final" and got[first["open"]] == "elsewhere"
    steps = representative.transitions(spark.createDataFrame([("w1", "f", 1, day(1)), ("w1", "f", 2, day(2)), ("w2", "f", 2, day(1)), ("w2", "f", 3, day(2)), ("w3", "f", 3, day(1)), ("w3", "f", 1, day(2))], "work string, field_name string, v bigint, at timestamp"))
    assert steps.count() < 3  # a cycle of three loses a step


def test_bibtex_of_any_depth():
    deep = "@article{a, title={x {y {z {deep {er}}}}}, note = \"q {r}\", year = 2020, empty={ {} }}"
    assert representative.scanned_fields(deep) == 3
    assert representative.scanned_fields(deep[:-1]) is None and representative.scanned_fields(None) is None
    assert representative.scanned_fields("@misc{a, title={x}, ye}") is None


def test_paragraphs_without_the_traces_of_page_and_scan():
    lines = "Results of the tri-\nal were gr0up means\n\fThe running head\n12\nof all sites.\n\nA new paragraph that\ngoes on.".split("\n")
    noise = {0: {"hyphen"}, 1: {"char"}, 2: {"header"}, 3: {"page_number"}}
    got = scans.paragraphs(lines, noise, {1: {"gr0up": "group"}})
    assert got == "Results of the trial were group means of all sites.\n\nA new paragraph that goes on."
    assert scans.paragraphs(["GR0UP"], {}, {0: {"gr0up": "group"}}) == "GROUP" and scans.paragraphs([""], {}, {}) == ""


def test_repaired_keeps_nulls_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, "One line of text that was printed on a page and is long en-\nough to be joined.")]
    got = dict(scans.repaired(spark.createDataFrame(rows, "text_id bigint, content string")).collect())
    assert got[1] is None and got[2] == "" and set(got) == {1, 2, 3}


def test_scorer_agrees_with_predict():
    rng = np.random.default_rng(3)
    x = rng.random((300, 4))
    model = boosting.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float))
    judge = boosting.scorer(model)
    assert [judge(r) for r in x.tolist()] == (boosting.predict(model, x) >= 0.5).tolist()


def test_items_shorter_than_a_window_leak_word_for_word(spark):
    items = spark.createDataFrame([(1, "Why do quolls limp?", None), (2, None, "Zorbax cures gout"), (3, "", None)], "item_id bigint, question string, passage string")
    docs = spark.createDataFrame([(1, "They asked: why do QUOLLS limp? Nobody knew."), (2, "Zorbax, it is said, cures gout."), (3, "It was shown that *Zorbax* cures gout in dogs.")], "doc_id bigint, text string")
    assert {tuple(r) for r in leaks.find(docs, items).collect()} == {(1, 1), (3, 2)}
    assert leaks.samples_for(0.2, 0.999) > leaks.samples_for(0.2, 0.9)


def test_styled_letters_within_words_are_plain():
    assert lookalikes.base_form("𝐂ancer and ᴄell, 𝓶𝓸𝓾𝓼𝓮") == "Cancer and cell, mouse"
    assert lookalikes.base_form("where 𝑥 is in ℝ") == "where 𝑥 is in ℝ"


def test_firms_and_short_surnames_link(spark):
    rows = [("Acme Widgets Ltd", 3), ("ACME Widgets, Inc.", 2), ("Wei Li", 5), ("Wei Lii", 1), ("Wei Lu", 5)]
    got = {tuple(r) for r in names.pairs(spark.createDataFrame(rows, "spelling string, n bigint")).collect()}
    assert got == {("ACME Widgets, Inc.", "Acme Widgets Ltd"), ("Wei Li", "Wei Lii")}

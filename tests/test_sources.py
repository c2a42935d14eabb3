import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evidentia.plans.answering import CANNOT_ANSWER, Session, run_fixed
from evidentia.sources import documents, files, settings
from evidentia.sources.collection import Corpus
from evidentia.sources.index import Index, SearchCursor
from evidentia.streaming.indexing import index_folder


def _docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="u"><w:p><w:t>{text}</w:t></w:p></w:document>')
    return out.getvalue()


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain words")
    (tmp_path / "b.html").write_text("<html><head><title>x</title></head><body><h1>Head</h1><p>Body <b>text</b></p></body></html>")
    (tmp_path / "c.docx").write_bytes(_docx("office words"))
    (tmp_path / "d.md").write_text("one\ntwo")
    (tmp_path / "e.exe").write_text("no")
    found = files.scan(spark, str(tmp_path))
    assert found.count() == 4
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_all(found, {k: v for k, v in documents.reader_registry().items() if k in ("text", "html", "office")}).collect()}
    assert got == {"a.txt": "plain words", "b.html": "# Head\n\nBody **text**", "c.docx": "office words"}
    lines = documents.reader_registry()["code"](found.where("suffix = '.md'"))
    assert sorted(r["text"] for r in lines.collect()) == ["one", "two"]


def test_bad_bytes_keep_lines_together(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\xff\nline")
    got = files.read_text(files.scan(spark, str(tmp_path)), split_lines=True).collect()
    assert [r["text"] for r in got] == ["ok\nline"]


def test_manifest_needs_paths(spark, tmp_path):
    (tmp_path / "m.csv").write_text("doi\n1\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "m.csv"))


def test_index_life(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    assert ix.version() is None
    row = lambda p, h, b: (p, h, p, "2020", b)
    docs = spark.createDataFrame([row("a", "1", "red fox"), row("b", "2", "blue whale song")], "file_location string, file_hash string, title string, year string, body string")
    ix.upsert(docs, failed=spark.createDataFrame([("bad",)], "file_location string"))
    assert {(r["file_location"], r["status"]) for r in ix.table("manifest").collect()} == {("a", "OK"), ("b", "OK"), ("bad", "ERROR")}
    assert [r["file_location"] for r in ix.search("whale*").collect()] == ["b"]
    edited = spark.createDataFrame([row("a", "9", "green whale")], docs.schema)
    ix.sync(edited)
    assert [(r["file_location"], r["file_hash"]) for r in ix.table("manifest").collect()] == [("a", "9")]
    cursor = SearchCursor(ix, 1)
    assert cursor.search("whale").count() == 1
    assert cursor.search("whale").count() == 0
    ix.delete(edited)
    assert ix.table("docs").count() == 0


def test_streaming_is_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("first text")
    ix = Index(spark, str(tmp_path / "ix"))
    run = lambda: index_folder(spark, str(src), ix, str(tmp_path / "cp"))
    assert run() == 1
    (src / "b.txt").write_text("second text")
    (src / "c.txt").write_bytes(b"\xff")
    assert run() == 1
    assert run() == 0
    assert sorted(r["status"] for r in ix.table("manifest").collect()) == ["ERROR", "OK", "OK"]
    assert ix.table("chunks").count() == 2


def test_settings_round_trip(tmp_path):
    s = settings.profile("wikicrow")
    settings.save(s, str(tmp_path / "s.json"))
    assert settings.load(str(tmp_path / "s.json")) == s
    assert s.fingerprint() != settings.profile("fast").fingerprint()


def test_session(spark):
    docs = spark.createDataFrame([("k1", "Doe2020", "Doe, 2020."), ("k2", "Doe2020", "Doe, again.")], "dockey string, docname string, citation string")
    chunks = spark.createDataFrame([("k1", 0, "Doe2020 pages 1-1", "\nred foxes hunt\n"), ("k2", 0, "Doe2020a pages 1-1", "blue whales sing")], "dockey string, chunk_ix int, name string, text string")
    none = Corpus(docs.limit(0), chunks.limit(0), docs.select("dockey").limit(0))
    s = Session(spark, none)
    assert run_fixed(s, "who sings?", lambda q: (docs.limit(0), chunks.limit(0))).startswith(CANNOT_ANSWER)
    s = Session(spark, none, generate=lambda q, ctx: f"Whales do ({ctx.split(':')[0]}, pqac-00000000).")
    got = run_fixed(s, "do blue whales sing?", lambda q: (docs, chunks))
    assert got.startswith("Whales do (Doe2020") and "References" in got and "pqac-" not in got
    assert sorted(r["docname"] for r in s.corpus.docs.collect()) == ["Doe2020", "Doe2020a"]
    assert s.attempts("gather_evidence") == 1 and s.successful
    gone = s.corpus.delete(dockey="k1")
    assert gone.visible().count() == 1
    assert gone.add(docs.where("dockey = 'k1'"), chunks).tombstones.count() == 0
    with pytest.raises(ValueError):
        s.corpus.citation("nothing")


def test_wanted_pages(spark):
    pages = spark.range(1, 6).select(F.col("id").alias("page_no"))
    assert files.page_range(pages, (4, 9)).count() == 2
    assert files.page_range(pages, 3).count() == 1
    assert files.page_range(pages, None).count() == 5

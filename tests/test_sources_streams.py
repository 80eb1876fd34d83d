import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.sources.extract import extract_text, html_text, split_dead_letter
from vellum.sources.files import scan_corpus


def _docx(text: str) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml",
                   '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
                   f"<w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>")
    return buf.getvalue()


def _corpus(root):
    files = {
        "a.txt": b"invoice for the vendor", "sub/B.MD": b"# API documentation",
        "c.csv": b"name,role\nann,employee\nbob,vendor\n",
        "d.html": b"<html><head><title>T</title><script>x()</script></head><body><nav>menu</nav><p>Tax &amp; audit</p></body></html>",
        "e.xml": b"<r><a>contract</a><b>clause</b></r>", "f.json": b'{"k": "budget"}',
        "g.docx": _docx("payroll policy"), "empty.txt": b"", "bad.docx": _docx("x")[:30],
        ".cache.json": b"{}", "prog.exe": b"MZ", ".hidden.txt": b"secret",
    }
    for name, data in files.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as fh:
            fh.write(data)


def test_scan_and_extract(spark, workdir):
    _corpus(workdir)
    files = scan_corpus(spark, workdir)
    names = sorted(os.path.relpath(r.path.replace("file:", ""), workdir) for r in files.select("path").collect())
    # A zero-length file yields no split in Spark's file scan, so it never reaches extraction
    # (the same outcome as "no content": skipped without stopping the batch).
    assert names == ["a.txt", "bad.docx", "c.csv", "d.html", "e.xml", "f.json", "g.docx", "sub/B.MD"]
    parts, dead = split_dead_letter(extract_text(files))
    by = {}
    for r in parts.collect():
        by.setdefault(os.path.basename(r.path), []).append(r.text)
    assert by["a.txt"] == ["invoice for the vendor"]
    assert by["B.MD"] == ["# API documentation"]
    assert by["c.csv"] == ["name: ann\nrole: employee", "name: bob\nrole: vendor"]
    assert by["d.html"] == ["Tax & audit"]
    assert by["e.xml"] == ["contract\nclause"]
    assert by["g.docx"] == ["payroll policy"]
    assert sorted(os.path.basename(r.path) for r in dead.collect()) == ["bad.docx"]


def test_missing_corpus(spark):
    with pytest.raises(FileNotFoundError):
        scan_corpus(spark, "/nonexistent/corpus/dir")


def test_html_text():
    assert html_text("<p>a<br>b</p><style>p{}</style><script>var t='</p>';</script>") == "a\nb"


def test_build_knowledge_base_incremental(spark, workdir):
    from vellum.plans.build import build_knowledge_base
    from vellum.sources.index_store import open_index
    corpus = os.path.join(workdir, "corpus")
    os.makedirs(corpus)
    for n, t in {"a.txt": "invoice " * 600, "b.txt": "employee payroll", "c.txt": "api server"}.items():
        with open(os.path.join(corpus, n), "w") as fh:
            fh.write(t)
    idx, man = os.path.join(workdir, "index"), os.path.join(workdir, "manifest")
    m1 = build_knowledge_base(spark, corpus, idx, man, dim=32)
    first = {r.id: r.text for r in open_index(spark, idx).collect()}
    assert m1["chunks_indexed"] == len(first) and m1["files_failed"] == 0 and m1["seconds"] > 0
    m2 = build_knowledge_base(spark, corpus, idx, man, dim=32)  # unchanged corpus: same index
    assert m2["chunks_indexed"] == 0
    assert {r.id: r.text for r in open_index(spark, idx).collect()} == first
    with open(os.path.join(corpus, "a.txt"), "w") as fh:
        fh.write("invoice short")  # shrink: orphans must go
    os.remove(os.path.join(corpus, "c.txt"))
    build_knowledge_base(spark, corpus, idx, man, dim=32)
    inc = open_index(spark, idx)
    full = os.path.join(workdir, "full")
    build_knowledge_base(spark, corpus, full, os.path.join(workdir, "m2"), dim=32)
    cols = ["id", "source", "text", "file_category"]
    assert sorted(map(tuple, inc.select(*cols).collect())) == sorted(map(tuple, open_index(spark, full).select(*cols).collect()))
    cats = {os.path.basename(r.source): r.file_category for r in inc.collect()}
    assert cats == {"a.txt": "PROCUREMENT", "b.txt": "HR"}


def test_sessions_file_roundtrip(spark, workdir):
    from vellum.sources.sessions_io import load_sessions, read_session_tables, save_sessions
    msg = lambda t, c: {"type": t, "data": {"content": c}}
    new = {"sessions": {"0123456789ab": [msg("human", "hi"), msg("ai", "hello")], "s2": "corrupt"},
           "titles": {"s2": "Tax Plan"}}
    legacy = {"abcdefghijk": [msg("human", "q")]}
    for name, data in (("new.json", new), ("legacy.json", legacy)):
        with open(os.path.join(workdir, name), "w") as fh:
            json.dump(data, fh)
    m, s = load_sessions(spark, os.path.join(workdir, "new.json"))
    assert {r.session_id: r.title for r in s.collect()} == {"0123456789ab": "Session 01234567", "s2": "Tax Plan"}
    assert [(r.turn, r.role, r.content) for r in m.orderBy("turn").collect()] == [(0, "human", "hi"), (1, "ai", "hello")]
    m2, s2 = load_sessions(spark, os.path.join(workdir, "legacy.json"))
    assert [r.title for r in s2.collect()] == ["Session abcdefgh"] and m2.count() == 1
    save_sessions(m, s, os.path.join(workdir, "store"))
    rm, rs = read_session_tables(spark, os.path.join(workdir, "store"))
    assert rm.count() == 2 and rs.count() == 2


def test_stream_build_and_sessions(spark, workdir):
    from vellum.sources.index_store import open_index
    from vellum.streaming.ingest import stream_build
    from vellum.streaming.sessions import read_messages, stream_sessions
    corpus = os.path.join(workdir, "in")
    os.makedirs(corpus)
    with open(os.path.join(corpus, "a.txt"), "w") as fh:
        fh.write("vendor invoice")
    idx = os.path.join(workdir, "idx")
    q = stream_build(spark, corpus, idx, os.path.join(workdir, "ck1"), dim=16)
    q.awaitTermination(120)
    with open(os.path.join(corpus, "b.txt"), "w") as fh:
        fh.write("employee payroll")
    q = stream_build(spark, corpus, idx, os.path.join(workdir, "ck1"), dim=16)
    q.awaitTermination(120)
    assert sorted(os.path.basename(r.source) for r in open_index(spark, idx).collect()) == ["a.txt", "b.txt"]

    incoming = os.path.join(workdir, "msgs")
    rows = [("s", 0, "user", "hi"), ("s", 1, "assistant", "yo")]
    spark.createDataFrame(rows, "session_id string, turn int, role string, content string").write.parquet(incoming + "/b1")
    spark.createDataFrame([("s", 1, "assistant", "yo")], "session_id string, turn int, role string, content string").write.parquet(incoming + "/b2")
    store = os.path.join(workdir, "store")
    q = stream_sessions(spark, incoming + "/*", store, os.path.join(workdir, "ck2"))
    q.awaitTermination(120)
    got = read_messages(spark, store)
    assert sorted((r.turn, r.content) for r in got.collect()) == [(0, "hi"), (1, "yo")]


def test_csv_rows_to_parts(spark, workdir):
    from vellum.sources.extract import csv_rows_to_parts
    p = os.path.join(workdir, "t.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("name,role\nann,employee\nbob,\n")
    got = [(r.part_idx, r.text) for r in csv_rows_to_parts(spark, p).orderBy("part_idx").collect()]
    assert got == [(0, "name: ann\nrole: employee"), (1, "name: bob\nrole: ")]


def test_extractor_hooks_and_dead_letter(spark, workdir):
    for name, data in {"doc.pdf": b"%PDF-1.4 fake", "notes.rtf": b"{\\rtf1 hello}"}.items():
        with open(os.path.join(workdir, name), "wb") as fh:
            fh.write(data)
    files = scan_corpus(spark, workdir)
    parts, dead = split_dead_letter(extract_text(files))
    assert parts.count() == 0
    assert sorted(r.error.split(":")[0] for r in dead.collect()) == ["ValueError", "ValueError"]

    def pdf_pages(data: bytes):
        return [(1, "page one budget"), (2, "page two audit")]
    parts, dead = split_dead_letter(extract_text(files, extractors={".PDF": pdf_pages}))
    assert [(r.page, r.text) for r in parts.orderBy("part_idx").collect()] == [(1, "page one budget"), (2, "page two audit")]
    assert [os.path.basename(r.path) for r in dead.collect()] == ["notes.rtf"]


def test_generator_failures_give_apology(spark):
    from vellum.plans.answer import APOLOGY, generate_column
    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "ok")], "id long, prompt string")

    def gen(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("model down")
        return ["fine" for _ in prompts]
    got = {r.id: r.response for r in generate_column(df, gen, batch_size=1).collect()}
    assert got == {1: "fine", 2: APOLOGY, 3: "fine"}
    assert {r.response for r in generate_column(df, None).collect()} == {None}


def test_stream_build_replay_is_idempotent(spark, workdir):
    from vellum.plans.build import index_rows
    from vellum.sources.index_store import open_index, update_index
    parts = spark.createDataFrame([("f", 0, "1", "vendor invoice " * 300, "txt"), ("g", 0, "1", "api", "txt")],
                                  "source string, part_idx int, page string, text string, file_type string")
    rows = index_rows(parts, dim=16)
    base = os.path.join(workdir, "idx")
    for _ in range(2):  # the same micro-batch delivered twice
        update_index(spark, base, rows, width=16)
    got = open_index(spark, base)
    assert got.count() == rows.count() and got.select("id").distinct().count() == got.count()
    # an update touching only "g" leaves the other buckets' files alone
    before = {os.path.join(dp, f) for dp, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}
    g = index_rows(parts.where("source = 'g'").selectExpr("source", "part_idx", "page", "'server api' as text", "file_type"), dim=16)
    n = update_index(spark, base, g, width=16)
    after = {os.path.join(dp, f) for dp, _, fs in os.walk(base) for f in fs if f.endswith(".parquet")}
    assert n == 1 and len(before & after) >= 1
    assert {r.source: r.text for r in open_index(spark, base).where("source = 'g'").collect()} == {"g": "server api"}


def test_xml_rows_to_parts(spark, workdir):
    from vellum.sources.extract import xml_rows_to_parts
    p = os.path.join(workdir, "t.xml")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("<items><item><name>ann</name><role>employee</role></item><item><name>bob</name><role>vendor</role></item></items>")
    got = [(r.part_idx, r.text) for r in xml_rows_to_parts(spark, p, "item").orderBy("part_idx").collect()]
    assert got == [(0, "name: ann\nrole: employee"), (1, "name: bob\nrole: vendor")]


def test_update_index_empties_a_bucket(spark, workdir):
    from vellum.plans.build import index_rows
    from vellum.sources.index_store import open_index, update_index
    parts = spark.createDataFrame([("only", 0, "1", "vendor", "txt")],
                                  "source string, part_idx int, page string, text string, file_type string")
    base = os.path.join(workdir, "idx")
    update_index(spark, base, index_rows(parts, dim=8), width=8)
    assert open_index(spark, base).count() == 1
    none = index_rows(parts.where("false"), dim=8)
    update_index(spark, base, none, deleted_sources=spark.createDataFrame([("only",)], "source string"), width=8)
    assert open_index(spark, base).count() == 0


def test_invalid_utf8_does_not_fail_the_batch(spark, workdir):
    with open(os.path.join(workdir, "latin.txt"), "wb") as fh:
        fh.write(b"caf\xe9 invoice")
    with open(os.path.join(workdir, "ok.md"), "wb") as fh:
        fh.write(b"vendor")
    parts, dead = split_dead_letter(extract_text(scan_corpus(spark, workdir)))
    got = {os.path.basename(r.path): r.text for r in parts.collect()}
    assert got == {"latin.txt": "caf� invoice", "ok.md": "vendor"} and dead.count() == 0


def test_failed_files_are_tracked(spark, workdir):
    """A file that stops loading loses its chunks, is retried, and is seen as deleted when it goes; only changed
    files are read and classified, each once."""
    from vellum.plans.build import build_knowledge_base
    from vellum.sources.index_store import open_index
    from vellum.sources.manifest import FAILED, read_manifest
    corpus, idx, man = (os.path.join(workdir, x) for x in ("c", "i", "m"))
    os.makedirs(corpus)
    for name, text in (("a.json", '{"x": "vendor"}'), ("b?#[1].txt", "payroll"), ("c.txt", "audit")):
        with open(os.path.join(corpus, name), "w") as fh:
            fh.write(text)
    calls = os.path.join(workdir, "calls")

    def model(prompts):
        with open(calls, "a") as fh:
            fh.write("x" * len(prompts))
        return ['{"category": "LEGAL"}' for _ in prompts]

    run = lambda: build_knowledge_base(spark, corpus, idx, man, dim=16, classify="model", generate=model)
    sources = lambda: sorted(os.path.basename(r.source) for r in open_index(spark, idx).select("source").collect())
    assert run()["files_failed"] == 0 and sources() == ["a.json", "b?#[1].txt", "c.txt"]
    assert os.path.getsize(calls) == 3
    with open(os.path.join(corpus, "a.json"), "w") as fh:
        fh.write("{broken")
    assert run()["files_failed"] == 1 and sources() == ["b?#[1].txt", "c.txt"]
    assert {os.path.basename(r.path): r.md5 == FAILED for r in read_manifest(spark, man).collect()} == {
        "a.json": True, "b?#[1].txt": False, "c.txt": False}
    assert run()["files_failed"] == 1  # retried
    os.remove(os.path.join(corpus, "a.json"))
    with open(os.path.join(corpus, "c.txt"), "w") as fh:
        fh.write("audit and tax")
    run()
    assert sources() == ["b?#[1].txt", "c.txt"] and os.path.getsize(calls) == 4
    assert {os.path.basename(r.path) for r in read_manifest(spark, man).collect()} == {"b?#[1].txt", "c.txt"}


def test_index_keeps_its_layout(spark, workdir):
    """Reopened with another bucket count or width: the recorded ones hold, others are refused."""
    from vellum.plans.build import index_rows
    from vellum.sources.index_store import open_index, update_index, write_index
    parts = spark.createDataFrame([(f"f{k}", 0, "1", "vendor", "txt") for k in range(5)],
                                  "source string, part_idx int, page string, text string, file_type string")
    base = os.path.join(workdir, "idx")
    write_index(index_rows(parts, dim=8), base, 8, buckets=128)
    update_index(spark, base, index_rows(parts.limit(2), dim=8), width=8)
    assert open_index(spark, base).count() == 5
    for wrong in ({"width": 8, "buckets": 64}, {"width": 16}):
        with pytest.raises(ValueError, match="was written with"):
            update_index(spark, base, index_rows(parts, dim=wrong["width"]), **wrong)


def test_stream_manifest_dead_letters_and_duplicate_turns(spark, workdir):
    from vellum.plans.build import build_knowledge_base
    from vellum.sources.index_store import open_index
    from vellum.streaming.ingest import stream_build
    from vellum.streaming.sessions import merge_messages
    corpus, idx, man, dead = (os.path.join(workdir, x) for x in ("c", "i", "m", "dead"))
    os.makedirs(corpus)
    for name, text in (("a.txt", "vendor"), ("bad.json", "{x")):
        with open(os.path.join(corpus, name), "w") as fh:
            fh.write(text)
    stream_build(spark, corpus, idx, os.path.join(workdir, "ck"), man, dead, dim=16).awaitTermination(120)
    assert [os.path.basename(r.path) for r in spark.read.parquet(dead).collect()] == ["bad.json"]
    os.remove(os.path.join(corpus, "a.txt"))
    build_knowledge_base(spark, corpus, idx, man, dim=16)  # the batch build sees the deletion
    assert open_index(spark, idx).count() == 0

    schema = "session_id string, turn int, role string, content string"
    old = spark.createDataFrame([("s", 0, "user", "first"), ("s", 1, "ai", "x")], schema)
    new = spark.createDataFrame([("s", 0, "user", "z", 1), ("s", 0, "user", "b", 2)], schema + ", _seq int")
    assert {(r.turn, r.content) for r in merge_messages(old, new).collect()} == {(0, "b"), (1, "x")}

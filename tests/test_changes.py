"""What an unchanged corpus costs, changes by stream, vectors by content, failing model calls."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.plans.build import build_knowledge_base
from vellum.sources.index_store import open_index


def write(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        path = os.path.join(folder, name.replace("_", "."))
        with open(path, "w") as fh:
            fh.write(text)
        os.utime(path, (1_000_000_000, 1_000_000_000 + len(text)))  # settled long ago


def names(df, column="source"):
    return sorted(os.path.basename(r[0]) for r in df.select(column).collect())


def opened(monkeypatch, log):
    """Counts files opened, from whatever process opens them."""
    from vellum.sources import files

    def reader(path):
        with open(log, "a") as fh:
            fh.write(os.path.basename(path) + "\n")
        return files.open_bytes(path)
    real = files.read_contents
    monkeypatch.setattr(files, "read_contents", lambda rows: real(rows, reader))
    return lambda: sorted(open(log).read().split()) if os.path.exists(log) else []


def test_an_unchanged_corpus_is_listed_not_read(spark, workdir, monkeypatch):
    corpus, idx, man = (os.path.join(workdir, x) for x in ("c", "i", "m"))
    write(corpus, a_txt="vendor", b_json='{"x": 1}', c_html="<p>payroll")
    read = opened(monkeypatch, os.path.join(workdir, "log"))
    build_knowledge_base(spark, corpus, idx, man, dim=8)
    assert read() == ["a.txt", "b.json", "c.html"]  # each once, plain and structured
    assert build_knowledge_base(spark, corpus, idx, man, dim=8)["chunks_indexed"] == 0
    assert len(read()) == 3
    write(corpus, a_txt="vendors")
    os.utime(os.path.join(corpus, "c.html"), (1_100_000_000, 1_100_000_000))  # touched, the same text
    assert build_knowledge_base(spark, corpus, idx, man, dim=8)["chunks_indexed"] == 1
    assert read()[2:] == ["b.json", "c.html", "c.html"] and len(read()) == 5
    build_knowledge_base(spark, corpus, idx, man, dim=8)
    assert len(read()) == 5 and names(open_index(spark, idx)) == ["a.txt", "b.json", "c.html"]


def test_a_file_that_has_not_settled_is_read_again(spark, workdir, monkeypatch):
    """Same length, same time, other text: seen, as its time is too near to the listing."""
    corpus, idx, man = (os.path.join(workdir, x) for x in ("c", "i", "m"))
    write(corpus, a_txt="one")
    path = os.path.join(corpus, "a.txt")
    os.utime(path)
    now = os.stat(path)
    build_knowledge_base(spark, corpus, idx, man, dim=8)
    with open(path, "w") as fh:
        fh.write("two")
    os.utime(path, ns=(now.st_atime_ns, now.st_mtime_ns))
    build_knowledge_base(spark, corpus, idx, man, dim=8)
    assert [r.text for r in open_index(spark, idx).collect()] == ["two"]


def test_listing_reads_no_content(spark, workdir):
    from vellum.sources.files import list_corpus
    write(workdir, a_txt="x")
    plan = list_corpus(spark, workdir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_edits_and_deletions_reach_the_index_by_the_stream_alone(spark, workdir):
    from vellum.sources.manifest import read_manifest
    from vellum.streaming.ingest import stream_build
    corpus, idx, man, ck = (os.path.join(workdir, x) for x in ("c", "i", "m", "ck"))
    write(corpus, a_txt="vendor " * 600, b_txt="payroll", c_txt="audit", d_json='{"x": 1}')
    run = lambda: stream_build(spark, corpus, idx, ck, man, dim=8).awaitTermination(120)
    run()
    assert set(names(open_index(spark, idx))) == {"a.txt", "b.txt", "c.txt", "d.json"}
    write(corpus, a_txt="vendor", e_txt="api", d_json="{broken")
    os.remove(os.path.join(corpus, "b.txt"))
    run()
    assert {os.path.basename(r.source): r.text for r in open_index(spark, idx).collect()} == {
        "a.txt": "vendor", "c.txt": "audit", "e.txt": "api"}
    assert {os.path.basename(r.path): r.md5 == "failed" for r in read_manifest(spark, man).collect()} == {
        "a.txt": False, "c.txt": False, "d.json": True, "e.txt": False}
    assert build_knowledge_base(spark, corpus, idx, man, dim=8)["chunks_indexed"] == 0  # the batch build agrees
    run()  # nothing new: no batch
    for name in os.listdir(corpus):
        os.remove(os.path.join(corpus, name))
    run()
    assert open_index(spark, idx).count() == 0 and read_manifest(spark, man).count() == 0


def test_a_replayed_batch_gets_the_same_changes(workdir):
    from vellum.sources.changes import ChangeReader
    corpus, state = os.path.join(workdir, "c"), os.path.join(workdir, "s")
    write(corpus, a_txt="x", b_md="y", _hidden_txt="n", c_bin="n", d_txt="")
    reader = lambda: ChangeReader({"path": corpus, "state": state, "parts": "3"})
    rows = lambda s, e: sorted((os.path.basename(r[0]), r[4]) for p in reader().partitions(s, e) for r in reader().read(p))
    zero, one = reader().initialOffset(), reader().latestOffset()
    assert reader().latestOffset() == one  # an unchanged folder has the same listing
    assert rows(zero, one) == [("a.txt", "new"), ("b.md", "new")]
    write(corpus, a_txt="xx", e_txt="z")
    os.remove(os.path.join(corpus, "b.md"))
    two = reader().latestOffset()
    write(corpus, f_txt="later")
    want = [("a.txt", "changed"), ("b.md", "deleted"), ("e.txt", "new")]
    assert rows(one, two) == want == rows(one, two)  # the folder's state of now does not matter
    reader().commit(two)
    assert rows(two, reader().latestOffset()) == [("f.txt", "new")]


def test_only_new_chunks_are_embedded(spark, workdir):
    from vellum.operators.embed import model_embedder
    corpus, idx, man, vec = (os.path.join(workdir, x) for x in ("c", "i", "m", "v"))
    calls = os.path.join(workdir, "calls")

    def load():
        def encode(texts):
            with open(calls, "a") as fh:
                fh.write("".join(t + "\n" for t in texts))
            return np.array([[len(t), 1.0] for t in texts])
        return encode

    run = lambda **kw: build_knowledge_base(spark, corpus, idx, man, dim=2, embedder=model_embedder(load), vectors=vec, **{"model": "m1", **kw})
    met = lambda: sorted(open(calls).read().split())
    write(corpus, a_txt="vendor", b_txt="payroll", c_txt="vendor")
    run()
    assert met() == ["payroll", "vendor"] and open_index(spark, idx).count() == 3
    write(corpus, b_txt="vendor", d_txt="audit")
    run()
    assert met() == ["audit", "payroll", "vendor"]
    run(force=True)
    assert met() == ["audit", "payroll", "vendor"] and open_index(spark, idx).count() == 4
    run(force=True, model="m2")  # another model has its own vectors
    assert met() == ["audit", "audit", "payroll", "vendor", "vendor"]


def test_vector_table_is_rewritten_after_many_appends(spark, workdir):
    from vellum.sources import vectors as V
    base = os.path.join(workdir, "v")
    for k in range(5):
        V.append_vectors(spark.createDataFrame([(f"h{k % 3}", [float(k % 3)])], V.SCHEMA), base, max_appends=3)
    assert len(V.current(spark, base).folders) <= 3
    got = {(r.content, r.embedding[0]) for r in V.read_vectors(spark, base).collect()}
    assert got == {("h0", 0.0), ("h1", 1.0), ("h2", 2.0)}
    df = spark.createDataFrame([(None, "t"), ("", "u"), ("x", "v")], "text string, _content string")
    got = V.embed_by_content(df, base, "m", dim=4)
    assert got.columns == ["text", "_content", "embedding"] and got.count() == 3
    assert V.embed_by_content(df.limit(0), base, "m", dim=4).count() == 0


@pytest.mark.parametrize("bad", [[], [5], [0, 63], list(range(64))])
def test_bad_prompts_are_isolated(bad):
    from vellum.operators.calls import call_bisecting
    calls = []

    def model(prompts):
        calls.append(len(prompts))
        if any(p in bad for p in prompts):
            raise RuntimeError("poison")
        return [p * 2 for p in prompts]

    replies, causes, seconds = call_bisecting(model, list(range(64)))
    assert replies == [None if k in bad else 2 * k for k in range(64)]
    assert causes == ["RuntimeError: poison" if k in bad else None for k in range(64)]
    assert len(calls) <= (1 + 12 * len(bad) if len(bad) < 3 else 127) and all(s >= 0 for s in seconds)


def test_retries_pause_and_a_wrong_number_of_replies():
    from vellum.operators.calls import call_bisecting
    pauses, left = [], [2]

    def flaky(prompts):
        if left[0]:
            left[0] -= 1
            raise TimeoutError("busy")
        return prompts

    assert call_bisecting(flaky, ["a"], 3, 0.5, pauses.append)[0] == ["a"] and pauses == [0.5, 1.0]
    replies, causes, _ = call_bisecting(lambda p: p[:1], ["a", "b"])
    assert replies == ["a", "b"] and causes == [None, None]
    assert call_bisecting(lambda p: [], ["a"])[1] == ["ValueError: 0 replies for 1 prompts"]
    assert call_bisecting(flaky, []) == ([], [], [])


def test_failures_have_a_cause_in_answers_categories_and_scores(spark):
    from vellum.operators.calls import split_failed
    from vellum.operators.classify import classify_model
    from vellum.operators.evaluate import evaluate
    from vellum.plans.answer import APOLOGY, generate_column

    def model(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("down")
        return ['{"category": "HR"}'] * len(prompts)
    df = spark.createDataFrame([(k, "boom" if k == 40 else "ok") for k in range(64)], "doc_id long, prompt string").coalesce(1)
    got = generate_column(df, model, batch_size=64, error="error", seconds="s")
    good, dead = split_failed(got)
    assert good.count() == 63 and [(r.doc_id, r.response, r.error) for r in dead.collect()] == [(40, APOLOGY, "RuntimeError: down")]
    cats = classify_model(df.withColumnRenamed("prompt", "text"), model, batch_size=64, error="error").collect()
    assert [(r.doc_id, r.file_category) for r in cats if r.error] == [(40, "GENERAL")] and sum(r.file_category == "HR" for r in cats) == 63
    cases = spark.createDataFrame([(1, "a", "a"), (2, "x", "a"), (3, "boom", "a")], "case_id long, actual_output string, expected_output string")

    def judge(actuals, expecteds):
        return [{"a": 1, "x": "junk"}[a] for a in actuals]
    scored = {r.case_id: (r.score, r.error) for r in evaluate(cases, judge=judge, error="error").collect()}
    assert scored == {1: (1.0, None), 2: (0.0, "no number: 'junk'"), 3: (0.0, "KeyError: 'boom'")}


def test_chunk_texts_are_shuffled_once(spark):
    """After the chunks are saved, one exchange carries their text."""
    import __spark_entry__ as E
    plan = E.queries()["build_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("max_by") >= 1 and "max_by(struct(" in plan.replace("max_by(named_struct(", "max_by(struct(")
    for line in plan.split("\n"):
        if "max_by" in line:
            assert "text" not in line

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.operators.chunk import chunk_fixed, chunk_ids, chunk_recursive, chunk_semantic, dedup_latest, split_recursive


def test_chunk_ids_golden(spark):
    rows = [(0, "a", 1), (1, "a", 1), (2, "a", 2), (3, "a", 1), (4, "b", 1)]
    df = spark.createDataFrame(rows, "seq int, source string, page int")
    got = [r.id for r in chunk_ids(df, "source", "page", ["seq"]).orderBy("seq").collect()]
    assert got == ["a:1:0", "a:1:1", "a:2:0", "a:1:0", "b:1:0"]
    latest = {r.id: r.seq for r in dedup_latest(chunk_ids(df, "source", "page", ["seq"]).select("id", "seq"), "id", "seq").collect()}
    assert latest == {"a:1:0": 3, "a:1:1": 1, "a:2:0": 2, "b:1:0": 4}


def test_chunk_ids_null_page(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None)], "seq int, source string, page int")
    assert [r.id for r in chunk_ids(df, "source", "page", ["seq"]).orderBy("seq").collect()] == ["a::0", "a::1"]


def _check_invariants(text, size, overlap):
    pieces = split_recursive(text, size, overlap)
    last = (-1, -1)
    for start, body in pieces:
        assert 0 < len(body) <= size
        assert text[start:start + len(body)] == body
        assert body == body.strip()
        # Spans move forward: neither end goes back and no span repeats. Starts may be
        # equal: a stripped chunk whose only piece is kept as overlap starts where the next
        # one does ('  ??aa', size 5, overlap 1 -> (2, '?'), (2, '??aa')).
        span = (start, start + len(body))
        assert span[0] >= last[0] and span[1] >= last[1] and span != last
        last = span
    covered = set()
    for start, body in pieces:
        covered.update(range(start, start + len(body)))
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .?!\n", max_size=400), st.integers(5, 60), st.data())
def test_recursive_invariants(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    _check_invariants(text, size, overlap)


def test_recursive_separator_priority():
    text = "para one.\n\npara two is here.\n\nthree"
    assert [b for _, b in split_recursive(text, 20, 0)] == ["para one.", "para two is here.", "three"]
    long = "word " * 1000
    _check_invariants(long, 2000, 500)
    assert split_recursive("", 10, 2) == []


def test_recursive_frame(spark):
    random.seed(1)
    text = " ".join(random.choice(["alpha", "beta.", "gamma?", "delta\n"]) for _ in range(3000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    rows = chunk_recursive(df).orderBy("chunk_index").collect()
    assert {r.doc_id for r in rows} == {1}
    assert [(r.start_index, r.text) for r in rows] == split_recursive(text)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "x" * 4500), (2, "y" * 10), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.chunk_index, r.start_index, len(r.text)) for r in chunk_fixed(df).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, 0, 2000), (1, 1, 1500, 2000), (1, 2, 3000, 1500), (2, 0, 0, 10)]


def test_semantic_chunks_restore_sentences(spark):
    text = ("The cat sat. The cat ran. The cat ate. Stocks fell sharply today! Markets dropped again? "
            "The cat slept.")
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = chunk_semantic(df, k=0.5).orderBy("chunk_index").collect()
    assert " ".join(r.text for r in rows) == text
    assert [r.chunk_index for r in rows] == list(range(len(rows)))


def _ids_brute(rows):
    """W1 in plain Python: rows in (source, seq) order, the index restarts when the page changes."""
    out, last, n = {}, None, 0
    for seq, src, page in sorted(rows, key=lambda r: (r[1], r[0])):
        n = n + 1 if last == (src, page) else 0
        last = (src, page)
        out[seq] = f"{src}:{'' if page is None else page}:{n}"
    return out


def test_chunk_ids_with_a_hot_source(spark):
    random.seed(7)
    rows = []
    for i in range(3000):
        src = "hot" if i % 3 else random.choice(["a", "b", "c"])  # one source holds 2/3
        page = random.choice([1, 1, 1, 2, None])
        rows.append((i, src, page))
    df = spark.createDataFrame(rows, "seq long, source string, page int")
    for parts in (8, 37, 400):
        assert {r.seq: r.id for r in chunk_ids(df, "source", "page", ["seq"], partitions=parts).collect()} == _ids_brute(rows)


def _semantic_brute(text, k=3.0, dim=256):
    import re

    import numpy as np
    import pyarrow as pa

    from vellum.operators.embed import hashed_matrix
    sents = [s.strip() for s in re.split(r"(?<=[.?!])\s+|\n+", text or "") if s.strip()]
    if not sents:
        return []
    ctx = [" ".join(sents[max(0, i - 1):i + 2]) for i in range(len(sents))]
    m = hashed_matrix(pa.array(ctx), dim).astype(np.float64)
    d = [1.0 - float(m[i] @ m[i + 1]) for i in range(len(sents) - 1)]
    thr = (np.mean(d) + k * np.std(d)) if d else 0.0
    chunks, cur = [], [sents[0]]
    for i in range(1, len(sents)):
        if len(sents) >= 3 and d[i - 1] > thr:
            chunks.append(" ".join(cur))
            cur = []
        cur.append(sents[i])
    chunks.append(" ".join(cur))
    return chunks


def test_semantic_matches_brute_force(spark):
    from tests.conftest import SF
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunk_semantic(docs, k=1.0).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.text
    for row in docs.collect():
        want = _semantic_brute(row.text, k=1.0)
        have = [got.get(row.doc_id, {})[i] for i in range(len(got.get(row.doc_id, {})))]
        assert have == want, row.doc_id


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc.", min_size=1, max_size=300), st.integers(2, 40), st.data())
def test_plain_windows_equal_char_packing(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    seps = data.draw(st.sampled_from([[""], [".", ""], ["x", ""]]))
    fast = split_recursive(text, size, overlap, seps, windows_for_plain=True)
    slow = split_recursive(text, size, overlap, seps, windows_for_plain=False)
    assert fast == slow

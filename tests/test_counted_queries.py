"""Queries that are counts of words: sums of the index's columns instead of products, and vectors that travel compressed."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from vellum.operators import embed as E
from vellum.operators import packed as P
from vellum.operators import search as S
from vellum.operators import tiles as T


def counts(rng, rows, width, words):
    m = np.zeros((rows, width), np.float32)
    for x in m:
        np.add.at(x, (rng.zipf(1.3, size=words) - 1) % width, 1)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def brute(m, q, k, threshold, mode):
    a, b = m.astype(float), q.astype(float)
    size = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    s = np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0)
    s = np.round((1 + s) / 2 if mode == "unit" else s, S.ROUND)
    out = []
    for c in range(len(q)):
        live = [r for r in range(len(m)) if a[r].any() and s[r, c] >= threshold]
        out += [(c, r, s[r, c]) for r in sorted(live, key=lambda r: (-s[r, c], r))[:k]]
    return pd.DataFrame(out, columns=["query_id", "id", "score"])


def scored(m, q, k, threshold, mode, prune=500):
    class Sent:
        value = q

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(m))), pa.array(list(m), pa.list_(pa.float32()))], names=["id", "v"])
    got = pd.concat(b.to_pandas() for b in S._scorer(np.arange(len(q)), Sent, k, threshold, mode, "id", "v", "query_id", prune)([batch]))
    return got.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).reset_index(drop=True)


@pytest.mark.parametrize("mode,threshold", [("cosine", 0.3), ("unit", 0.6), ("cosine", -1.0)])
def test_sums_find_what_products_find(monkeypatch, mode, threshold):
    """Short and long queries, one word many times, ties beyond k, zero rows, index rows with negative entries, arbitrary queries."""
    monkeypatch.setattr(S.Contest, "ROWS", 64)
    monkeypatch.setattr(S.Contest, "GROUP", 16)
    rng = np.random.default_rng(4)
    m = counts(rng, 700, 40, 60)
    m[100:130] = m[3]
    m[7] = 0
    m[200:220] = rng.normal(size=(20, 40))
    q = np.vstack([*(counts(rng, 15, 40, n) for n in (1, 5, 30, 64, 90)), m[3:4], np.zeros((1, 40), np.float32), rng.normal(size=(9, 40)).astype(np.float32)])
    q[0] = 0
    q[0, 5] = 7
    contest = S.Contest(q, 5, threshold, mode)
    assert len(contest.counted) >= 60 and len(contest.dense) >= 11  # both ways are taken
    pd.testing.assert_frame_equal(scored(m, q, 5, threshold, mode), brute(m, q, 5, threshold, mode))


def test_floors_rise_with_the_best_seen(monkeypatch):
    """Rows that ``k`` rows of earlier slices beat get no exact score: work does not grow by k pairs a query and slice."""
    pairs, einsum = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, *a, **kw: (pairs.append(len(a[0])) if how == "ij,ij->i" else None) or einsum(how, *a, **kw))
    rng = np.random.default_rng(6)
    m, q = counts(rng, 16384, 32, 40), counts(rng, 50, 32, 12)
    got = scored(m, q, 10, 0.3, "cosine")
    assert sum(pairs) < 100 * len(q)  # 16 slices of 1024 rows, at ten each, are 160
    pd.testing.assert_frame_equal(got, brute(m, q, 10, 0.3, "cosine"))


def test_blocks_travel_compressed_and_whole(spark):
    rng = np.random.default_rng(8)
    m = counts(rng, 900, 256, 25)
    df = spark.createDataFrame([(f"r{k}", x.tolist()) for k, x in enumerate(m)], "id string, embedding array<float>")
    rows = T.blocks(df, "id", "embedding", 256, S.unit_rows(rng.normal(size=(3, 256))), 900, 200).collect()
    assert sum(len(r.vecs) for r in rows) < m.nbytes / 3
    found = {i: x for r in rows for i, x in zip(r.ids, P.unsqueeze(bytes(r.vecs), "<f4", len(r.ids) * 256).reshape(-1, 256), strict=True)}
    assert len(found) == 900 and all(np.array_equal(found[f"r{k}"], m[k]) for k in range(900))


def test_query_blocks_with_the_same_tiles_are_scored_together(monkeypatch):
    """An index block is opened once for them; with other tiles, or beyond the bound, queries are scored apart."""
    rng = np.random.default_rng(9)
    m, q = counts(rng, 60, 16, 9), counts(rng, 30, 16, 5)
    made, contest = [], T.Contest
    monkeypatch.setattr(T, "Contest", lambda queries, *a: made.append(len(queries)) or contest(queries, *a))

    def shelf(meets, most=1 << 20):
        made.clear()
        monkeypatch.setattr(T, "ASKED_BYTES", most)
        own = T._Shelf(16, 4, 0.2, "cosine", "<f4", "<f4")
        for b in range(3):
            own.lay((b,), pa.array(range(20 * b, 20 * b + 20)), P.squeeze(m[20 * b:20 * b + 20]))
        out = [x for b in range(3) for x in own.ask(meets[b], pa.array(range(10 * b, 10 * b + 10)), P.squeeze(q[10 * b:10 * b + 10]))]
        got = pd.concat(x.to_pandas() for x in [*out, *own.answer()]).rename(columns={"query": "query_id"})
        return got.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).reset_index(drop=True)

    every = [(0,), (1,), (2,)]
    want = brute(m, q, 4, 0.2, "cosine")
    pd.testing.assert_frame_equal(shelf([every] * 3), want)
    assert made == [30]
    pd.testing.assert_frame_equal(shelf([every] * 3, 16 * 4 * 25), want)
    assert made == [20, 10]
    got = shelf([every, every[:1], every])
    assert made == [10, 10, 10] and set(got["id"][got["query_id"].between(10, 19)]) <= set(range(20))


def test_embedding_is_packed_in_its_own_worker(spark):
    """No plain vector passes through the JVM: one Python node embeds and packs."""
    df = spark.createDataFrame([(1, "a b b"), (2, None)], "id long, text string")
    rows = P.packed(E.embed(df, "text", "embedding", dim=8), "id", "embedding")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert P.counted(rows) == (2, 8)
    got = {i: x for b in rows.toArrow().to_batches() for ids, m in P.opened(b, "<f4", 8) for i, x in zip(ids.to_pylist(), m, strict=True)}
    assert np.array_equal(got[1], E.hashed_vector("a b b", 8)) and not got[2].any()


def test_tokens_are_those_of_the_pattern():
    """Cut from bytes, texts that end within a word, accents, other scripts, signs of up to four bytes."""
    texts = ["", "Ab cd", "ef-9 É,ß", "中文。a", "😀x😀", " x ", "½ Ⅷ_a", "İI K", "\U00010400a b", "a", "b"]
    tokens, n = E._tokens(pa.compute.utf8_lower(pa.array(texts)))
    want = [[w for w in pa.compute.split_pattern_regex(pa.compute.utf8_lower(pa.scalar(t)), pattern=E.TOKEN_PATTERN).as_py() if w] for t in texts]
    assert tokens.to_pylist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert not any(re.search(r"[\s,_-]", w) for w in tokens.to_pylist())


def test_a_shelf_is_bounded_by_its_bytes_as_they_lie(spark, monkeypatch):
    """Compressed vectors fill a shelf, so that queries travel to few; what was saved on the way is gone afterwards."""
    rng = np.random.default_rng(10)
    m, q = counts(rng, 1200, 256, 25), counts(rng, 40, 256, 8)
    frame = lambda x, key: spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{key} long, embedding array<float>")
    rows, gone, shelves, drop = [], [], T.shelves, T.drop_saved
    monkeypatch.setattr(T, "shelves", lambda blocks, n: rows.append(n) or shelves(blocks, n))
    monkeypatch.setattr(T, "drop_saved", lambda *x: gone.extend(x) or drop(*x))
    got = T.topk_join(frame(m, "id"), frame(q, "query_id"), 5, 0.3, tile_bytes=256 * 8 * 50, shelf_bytes=30_000)
    assert len(rows) == 1 and 30_000 / (256 * 4) * 3 < rows[0] < 1200  # a third of the width or less, and several shelves
    want = brute(m, q, 5, 0.3, "cosine")
    assert sorted((r.query_id, r.id, r.score) for r in got.collect()) == sorted(want.itertuples(index=False, name=None))
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = [path(x._jdf.queryExecution().logical().rdd().getCheckpointFile().get()) for x in gone]
    assert len(files) == 6 and not any(f.getFileSystem(spark._jsc.hadoopConfiguration()).exists(f) for f in files)


def test_histories_of_asked_turns(spark):
    """Those turns' rows as they were, also where a turn has messages of two roles or is missing."""
    from vellum.operators.sessions import chat_role, history_upto

    rows = [(1, 0, "user", "a"), (1, 1, "ai", "b"), (1, 2, "human", "c"), (1, 2, "ai", "d"), (2, 0, "ai", None), (2, None, "user", "x"), (None, 1, "user", "y"), (3, 1, None, "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    every = [tuple(r) for r in history_upto(df).collect()]
    got = [tuple(r) for r in history_upto(df, asked=chat_role("role") == "user").collect()]
    turns = {(1, 0), (1, 2), (2, None), (None, 1)}
    assert sorted(got, key=str) == sorted((r for r in every if r[:2] in turns), key=str) and len(got) == 5

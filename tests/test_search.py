import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum import config
from vellum.operators.search import (centroid_queries, context_assembly, retrieval_confidence,
                                     lsh_candidates, topk_similarity, topk_similarity_lsh)


def test_confidence_and_context_golden(spark):
    hits = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 2, 0.7)],
                                 "query_id int, id string, rank int, score double")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    docs = spark.createDataFrame([("a", "s1", "first"), ("b", None, "second")],
                                 "id string, source string, text string")
    conf = {r.query_id: r.confidence for r in retrieval_confidence(hits, queries).collect()}
    assert conf == {1: 0.8, 2: 0.0}
    ctx = {r.query_id: r for r in context_assembly(hits, docs, queries, with_confidence=True).collect()}
    assert ctx[1].context == "first" + config.CONTEXT_SEPARATOR + "second"
    assert ctx[1].sources == ["Unknown", "s1"] and ctx[1].num_sources == 2
    assert ctx[2].context == config.NO_CONTEXT and ctx[2].sources == [] and ctx[2].num_sources == 0


def test_threshold_golden(spark):
    # scores 0.9, 0.7, 0.4 against threshold 0.5 -> two hits, confidence 0.8
    q = np.array([1.0, 0.0])
    vecs = {"a": [0.9, np.sqrt(1 - 0.81)], "b": [0.7, np.sqrt(1 - 0.49)], "c": [0.4, np.sqrt(1 - 0.16)]}
    index = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vecs.items()], "id string, embedding array<float>")
    queries = spark.createDataFrame([(1, q.tolist())], "query_id int, embedding array<double>")
    hits = topk_similarity(index, queries, k=10, threshold=0.5).orderBy("rank").collect()
    assert [h.id for h in hits] == ["a", "b"]
    assert round(retrieval_confidence(topk_similarity(index, queries, threshold=0.5), queries).first().confidence, 6) == 0.8


def _brute(index_rows, query_rows, k, t):
    out = {}
    for qid, qv in query_rows:
        qv = np.asarray(qv, float)
        sc = []
        for iid, v in index_rows:
            v = np.asarray(v, float)
            d = np.linalg.norm(v) * np.linalg.norm(qv)
            s = round(float(v @ qv / d) if d > 0 else 0.0, 6)
            if s >= t:
                sc.append((-s, iid))
        out[qid] = [iid for _, iid in sorted(sc)[:k]]
    return out


def test_topk_matches_brute_force_and_blocks(spark):
    rng = np.random.default_rng(3)
    index_rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    index_rows += [(1000, index_rows[0][1]), (1001, [0.0] * 16)]  # exact tie, zero vector
    query_rows = [(q, rng.normal(size=16).tolist()) for q in range(23)]
    index = spark.createDataFrame(index_rows, "id long, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(query_rows, "query_id int, embedding array<double>")
    want = _brute(index_rows, query_rows, 7, 0.1)
    for max_bytes in (64 << 20, 2000):  # queries broadcast; joined tile by tile
        got = {}
        for r in topk_similarity(index, queries, k=7, threshold=0.1, max_broadcast_bytes=max_bytes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert {q: got.get(q, []) for q in want} == want


def test_lsh_precision_and_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(10, 16))
    rows = []
    for i in range(300):
        v = base[i % 10] + 0.3 * rng.normal(size=16)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    index = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = spark.createDataFrame([(q, (base[q] / np.linalg.norm(base[q])).tolist()) for q in range(10)],
                                    "query_id int, embedding array<double>")
    exact = {(r.query_id, r.id): r.score for r in topk_similarity(index, queries, k=5, threshold=0.6).collect()}
    approx = {(r.query_id, r.id): r.score for r in topk_similarity_lsh(index, queries, k=5, threshold=0.6, tables=12, bits=8).collect()}
    assert all(abs(exact.get(p, s) - s) < 1e-9 for p, s in approx.items())  # re-scored exactly
    assert len(set(approx) & set(exact)) / max(1, len(exact)) >= 0.9  # recall
    pairs = lsh_candidates(index, queries, "id", "embedding", "query_id", "embedding", 12, 8, 16)
    assert pairs.count() < 0.35 * 300 * 10  # well below all pairs


def test_vectors_of_another_width_raise(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    with pytest.raises(Exception, match="vectors must have 2 entries"):
        topk_similarity(index, q, threshold=0.0).collect()
    got = topk_similarity(index.where("id != 2"), q, threshold=0.0).collect()
    assert [r.id for r in got] == [1]  # a missing vector is no hit


def test_centroid_queries_unit(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0])], "label int, embedding array<float>")
    got = {r.query_id: r.embedding for r in centroid_queries(df).collect()}
    assert np.allclose(got[0], [2 ** -0.5, 2 ** -0.5]) and np.allclose(got[1], [1.0, 0.0])


@pytest.mark.parametrize("mode,threshold", [("cosine", 0.3), ("unit", 0.6), ("cosine", -1.0)])
def test_scores_are_made_in_bounded_products(monkeypatch, mode, threshold):
    """Whatever the batch and the number of queries, no product has more than ROWS by COLUMNS entries; the best are those
    of the whole product, ties by id."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    from vellum.operators import search as S

    monkeypatch.setattr(S.Contest, "ROWS", 64)
    monkeypatch.setattr(S.Contest, "COLUMNS", 16)
    sizes, nonzero = [], np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: sizes.append(x.shape) or nonzero(x))
    rng = np.random.default_rng(2)
    m = rng.normal(size=(1000, 6)).astype(np.float32)
    m[500:520] = m[3]  # ties beyond k
    m[7] = 0
    q = np.vstack([rng.normal(size=(48, 6)), m[3], np.zeros(6)])

    class Sent:
        value = q

    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(list(m), pa.list_(pa.float32()))], names=["id", "v"])
    out = pd.concat(b.to_pandas() for b in S._scorer(np.arange(50), Sent, 5, threshold, mode, "id", "v", "query_id", 300)([batch]))
    assert all(r <= 64 and c <= 16 for r, c in (s for s in sizes if len(s) == 2))
    size = np.outer(np.linalg.norm(m.astype(float), axis=1), np.linalg.norm(q, axis=1))
    s = np.divide(m.astype(float) @ q.T, size, out=np.zeros_like(size), where=size > 0)
    s = np.round((1 + s) / 2 if mode == "unit" else s, S.ROUND)
    want = [(c, r, s[r, c]) for c in range(50) for r in sorted(range(1000), key=lambda r: (-s[r, c], r)) if r != 7 and s[r, c] >= threshold]
    want = pd.DataFrame(want, columns=["query_id", "id", "score"]).groupby("query_id").head(5)
    pd.testing.assert_frame_equal(out.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).reset_index(drop=True), want.reset_index(drop=True))


def test_a_batch_is_embedded_in_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from vellum.operators import embed as E

    seen, whole = [], E.hashed_matrix
    monkeypatch.setattr(E, "hashed_matrix", lambda t, *a: seen.append(len(t)) or whole(t, *a))
    texts = pa.array([None, "", *(f"word{k % 7} other{k}" for k in range(1500))])
    out = E.hashed_slices(texts, 64, {})
    assert max(seen) <= E.SLICE and sum(seen) == len(texts)
    assert np.array_equal(out, whole(texts, 64))


def test_search_and_embedding_cap_arrow_batches(spark):
    from vellum.operators.embed import embed
    from vellum.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        one = spark.createDataFrame([(1, "a b", [1.0, 0.0])], "id long, text string, embedding array<float>")
        for call in (lambda: embed(one, "text", "v"), lambda: topk_similarity(one, one.selectExpr("id AS query_id", "embedding"))):
            spark.conf.set(key, str(64 << 20))
            call()
            assert int(spark.conf.get(key).rstrip("bB")) == BATCH_BYTES
        spark.conf.set(key, "1000")
        embed(one, "text", "v")
        assert spark.conf.get(key).rstrip("bB") == "1000"
    finally:
        spark.conf.set(key, before)

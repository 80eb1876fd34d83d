"""The inverted file of product codes against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import ivf as I
from vellum.operators.search import topk_similarity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def index(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").repartition(4).cache()


@pytest.fixture(scope="module")
def model(index):
    return I.fit_ivf(index)


def test_codes_are_the_nearest_words_and_scores_are_their_products():
    rng = np.random.default_rng(1)
    x, books = rng.normal(size=(50, 10)), rng.normal(size=(3, I.WORDS, I.GROUP))
    codes = I.encode(x, books)
    padded = np.pad(x, ((0, 0), (0, 2)))
    for row, code in zip(padded, codes, strict=True):
        for g in range(3):
            d = ((books[g] - row[g * 4:g * 4 + 4]) ** 2).sum(axis=1)
            assert d[code[g]] <= d.min() + 1e-12
    q, base = rng.normal(size=(5, 10)), rng.normal(size=5)
    decoded = np.concatenate([books[g][codes[:, g]] for g in range(3)], axis=1)[:, :10]
    assert np.allclose(I.code_scores(q, base, codes, books), base[:, None] + q @ decoded.T)


def test_cells_grow_with_the_square_root(index, model):
    assert I.cell_count(10_000, 64) == 100 and I.cell_count(0, 64) == 1 and I.cell_count(10 ** 10, 1024) == 8192
    assert model.centroids.shape == (45, 64) and 1 <= model.probes <= 45


def test_recall_and_pairs(index, model):
    """Every twentieth row asks; neighbours at a cosine of 0.35 without near directions: the hard case."""
    queries = index.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    codes = I.encode_ivf(index, model)
    assert codes.count() == index.count()
    want = {(r.query_id, r.id): r.score for r in topk_similarity(index, queries, 10, -1.0).collect()}
    got = {(r.query_id, r.id): r.score for r in I.search_ivf(codes, model, index, queries, 10, -1.0).collect()}
    assert len(got) == 10 * queries.count() and len(set(want) & set(got)) / len(want) >= 0.9
    assert all(abs(want[p] - s) < 1e-9 for p, s in got.items() if p in want)  # scored exactly
    pairs = I.candidates_ivf(codes, model, queries, 160, model.probes)
    n = pairs.count()
    assert n == pairs.distinct().count() and n <= 0.1 * index.count() * queries.count()


def test_near_directions_need_few_cells(spark):
    """A cluster per direction and a third of all rows the same vector."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 16))
    rows = [(i, (base[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(600)] + [(600 + i, base[3].tolist()) for i in range(300)]
    index = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3).cache()
    model = I.fit_ivf(index, k=5)
    assert model.probes <= 10
    queries = spark.createDataFrame([(f"q{i}", b.tolist()) for i, b in enumerate(base)], "query_id string, embedding array<double>")
    codes = I.encode_ivf(index, model)
    want = {(r.query_id, r.id) for r in topk_similarity(index, queries, 5, 0.5).collect()}
    got = {(r.query_id, r.id) for r in I.search_ivf(codes, model, index, queries, 5, 0.5, rerank=400).collect()}
    assert len(want & got) / len(want) >= 0.9
    assert {(q, i) for q, i in got if q == "q3"} == {("q3", 600 + i) for i in range(5)}  # ties go to the least id


def test_cases(spark):
    """Nulls, zero vectors, other key types, one row, no row, no query."""
    schema = "name string, v array<float>"
    index = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [0.6, 0.8]), ("d", [0.6, 0.8])], schema)
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0])], "q int, v array<float>")
    run = lambda i, q: sorted((r.q, r["name"], r["rank"], r.score) for r in I.topk_similarity_ivf(
        i, q, 3, 0.1, index_key="name", index_vec="v", query_key="q", query_vec="v").collect())
    got = run(index.limit(4), queries)
    assert [(q, n, k) for q, n, k, _ in got] == [(1, "a", 1), (1, "d", 2)] and abs(got[1][3] - 0.6) < 1e-6
    assert run(index.limit(1), queries) == [(1, "a", 1, 1.0)]
    assert run(index.limit(0), queries) == [] and run(index, queries.limit(0)) == [] and run(index.where("name = 'b'"), queries) == []


def test_store_keeps_model_and_codes_together(spark, index, workdir, monkeypatch):
    from vellum.sources import commits as C
    base = os.path.join(workdir, "ivf")
    model = I.write_ivf(index, base)
    codes, again = I.read_ivf(spark, base)
    assert np.array_equal(model.centroids, again.centroids) and np.array_equal(model.books, again.books) and again.probes == model.probes
    assert codes.count() == index.count() and codes.select("cell").distinct().count() <= len(model.centroids)
    queries = index.where("id < 3").select(F.col("id").alias("query_id"), "embedding")
    found = I.search_ivf(codes, again, index, queries, 1, 0.9)
    assert sorted((r.query_id, r.id) for r in found.collect()) == [(0, 0), (1, 1), (2, 2)]
    with monkeypatch.context() as m:  # a rebuild that dies leaves the pair before it
        m.setattr(C, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            I.write_ivf(index.where("id < 100"), base)
    assert I.read_ivf(spark, base)[0].count() == index.count()
    I.write_ivf(index.limit(0), base)
    assert I.read_ivf(spark, base) is None

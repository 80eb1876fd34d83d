import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import tiles as T
from vellum.operators.search import topk_similarity


def frame(spark, rows, key, kind="float"):
    return spark.createDataFrame([(k, None if v is None else [float(x) for x in v]) for k, v in rows], f"{key} long, embedding array<{kind}>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("mode,threshold", [("cosine", 0.2), ("unit", 0.55), ("cosine", -1.0)])
def test_equal_to_the_block_form(spark, mode, threshold):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    index = [(i, np.float32(base[i % 6] + 0.4 * rng.normal(size=8))) for i in range(600)]
    index += [(1000, index[0][1]), (1001, np.zeros(8)), (1002, None)]  # a tie, no direction, no vector
    queries = [(q, base[q % 6] + 0.4 * rng.normal(size=8)) for q in range(90)] + [(500, np.zeros(8))]
    i, q = frame(spark, index, "id"), frame(spark, queries, "query_id", "double")
    want = rows_of(topk_similarity(i.where("embedding IS NOT NULL"), q, 7, threshold, mode))
    assert want and rows_of(T.topk_join(i, q, 7, threshold, mode)) == want
    assert rows_of(T.topk_join(i, q, 7, threshold, mode, tile_bytes=64 * 20)) == want  # blocks of 20 rows


def test_tiles_are_pruned_without_loss(spark):
    """Blocks around opposite directions do not meet; every pair over the threshold lies in a kept tile."""
    rng = np.random.default_rng(5)
    base = np.eye(8)
    rows = [(i, base[i % 8] + 0.05 * rng.normal(size=8)) for i in range(800)]
    df = frame(spark, rows, "id")
    directions = T.unit_rows(base)
    a = T.blocks(df, "id", "embedding", 8, directions, 800, 40)
    kept = {(tuple(r.left), tuple(r.right)) for r in T.tiles(a, a, 0.7).collect()}
    blocks = a.collect()
    assert len(kept) < 0.3 * len(blocks) ** 2
    home = {k: tuple(b.block) for b in blocks for k in b.ids}
    u = T.unit_rows(np.array([v for _, v in rows]))
    assert sorted(home) == list(range(800))
    assert all((home[x], home[y]) in kept for x, y in zip(*np.nonzero(u @ u.T >= 0.7), strict=True))


def test_a_crowded_direction_is_split(spark):
    """Half of the rows have one direction, all with the same vector: blocks stay near their size."""
    rows = [(i, [1.0, 0.0]) for i in range(1000)] + [(i, [np.cos(i), np.sin(i)]) for i in range(1000, 2000)]
    a = T.blocks(frame(spark, rows, "id"), "id", "embedding", 2, T.unit_rows(np.array([[1.0, 0], [0, 1], [-1, 0]])), 2000, 100)
    sizes = [len(r.ids) for r in a.collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200


def test_no_query_passes_through_the_driver(spark, monkeypatch):
    """Only the sampled directions are collected, whatever the number of queries; both joins are on block keys."""
    seen = []
    whole = type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: seen.append(t := whole(self)) or t)
    rng = np.random.default_rng(7)
    i, q = (frame(spark, [(k, rng.normal(size=4)) for k in range(3000)], key) for key in ("id", "query_id"))
    out = T.topk_join(i, q, 3, 0.9, tile_bytes=4 * 8 * 100)
    assert [t.num_rows for t in seen] == [max(1, 3000 // T.DIRECTION_ROWS)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert out.groupBy("query_id").count().where("count > 3").isEmpty()


def test_empty_sides_and_other_widths(spark):
    none = frame(spark, [], "id")
    q = frame(spark, [(0, [1.0, 0.0])], "query_id")
    assert T.topk_join(none, q, threshold=0.0).collect() == []
    assert T.topk_join(frame(spark, [(1, [1.0, 0.0])], "id"), q.where(F.lit(False)), threshold=0.0).collect() == []
    with pytest.raises(Exception, match="vectors must have 2 entries"):
        T.topk_join(frame(spark, [(1, [1.0, 0.0, 0.0])], "id"), q, threshold=0.0).collect()


def test_a_shelf_takes_several_blocks_and_equal_rows_are_cut(spark, monkeypatch):
    """Query blocks travel to shelves, not to every index block; 700 equal rows make no block beyond its bound."""
    rng = np.random.default_rng(11)
    rows = [(k, np.float32(rng.normal(size=8))) for k in range(1500)] + [(5000, np.float32(np.ones(8)))] * 700
    i, q = frame(spark, rows, "id"), frame(spark, [(k, rng.normal(size=8)) for k in range(300)], "query_id", "double")
    cut = T.blocks(i, "id", "embedding", 8, T.unit_rows(np.eye(8)), 2200, 50)
    assert max(len(r.ids) for r in cut.collect()) <= 100
    on = {tuple(r.block): r.shelf for r in T.shelves(cut, 800).collect()}
    assert len(on) > 20 and len(set(on.values())) == 3
    want = rows_of(topk_similarity(i, q, 5, 0.1))
    assert want and rows_of(T.topk_join(i, q, 5, 0.1, tile_bytes=64 * 20, shelf_bytes=32 * 300)) == want

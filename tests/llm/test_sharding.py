import zlib

import numpy as np

from vellum.llm import sharding

SF = "/root/testdata/sf0.001"


def check(out, rows, shards):
    """Whole rows, right figures, gapless slots."""
    key = lambda d, t: (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == sorted(key(d, t) for d, t in rows)
    for s in range(shards):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards for r in out)


def test_place_against_the_definition():
    rng = np.random.default_rng(3)
    v = rng.integers(1, 100, (60, 3)).astype(float)
    got, w = sharding.place(v, 5), np.array([4.0, 1.0, 1.0])
    part, residual = v / (v.sum(axis=0) / 5), np.ones((5, 3))
    for k in sorted(range(60), key=lambda k: (-(part[k] * w).sum(), k)):
        dots = [(residual[s] * part[k] * w).sum() for s in range(5)]
        assert got[k] == max(range(5), key=lambda s: (round(dots[s], 12), -s))
        residual[got[k]] -= part[k]


def test_given_documents(spark, documents):
    out = sharding.shard_documents(documents).collect()
    check(out, [(r.doc_id, r.text) for r in documents.collect()], 24)
    q = sharding.op4_sharding(spark, SF)
    assert q.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_balance_with_a_hot_group(docs):
    """A third of the rows share one text: it is split, all three dimensions stay balanced. Other copies stay together."""
    texts = ["hot text of a few words here " * 4] * 2000 + [f"doc {k} " + "word " * (k % 40) for k in range(4000)] + ["twin text"] * 3
    out = sharding.shard_documents(docs(texts), shards=6).collect()
    check(out, list(enumerate(texts)), 6)
    for f in (lambda r: r.size, lambda r: r.n_tokens, lambda r: 1):
        load = np.bincount([r.shard for r in out], [f(r) for r in out], minlength=6)
        assert load.max() / load.mean() < 1.02 and load.min() / load.mean() > 0.98
    assert len({r.shard for r in out if r.doc_id >= 6000}) == 1


def test_small_and_odd_tables(docs):
    """Nulls, empty and very long texts, repeated rows, an empty table."""
    assert sharding.shard_documents(docs([])).collect() == []
    texts = [None, "", "x" * 2_000_000, "a b", "a b", None]
    ids = [1, 2, 3, 4, 4, None]
    check(sharding.shard_documents(docs(texts, ids)).collect(), list(zip(ids, texts, strict=True)), 24)


def test_identical_rows_are_split_too(docs):
    """3000 rows that are equal in every column beside 3000 others: the law holds."""
    texts = ["the same text in every row of them " * 4] * 3000 + [f"doc {k} " + "word " * (k % 40) for k in range(3000)]
    ids = [7] * 3000 + list(range(100, 3100))
    out = sharding.shard_documents(docs(texts, ids), shards=6).collect()
    check(out, list(zip(ids, texts, strict=True)), 6)
    for f in (lambda r: r.size, lambda r: 1):
        load = np.bincount([r.shard for r in out], [f(r) for r in out], minlength=6)
        assert load.max() / load.mean() < 1.02 and load.min() / load.mean() > 0.98

"""The commit log and the bucketed tables on it."""

import os

import pytest
from pyspark.sql import functions as F

from vellum.sources import buckets as B
from vellum.sources import commits as C

SCHEMA = "k STRING, v INT"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def put(spark, base, *pairs, **kw):
    batch = rows(spark, *pairs)
    return B.replace_buckets(spark, base, SCHEMA, "k", batch.select("k"),
                             lambda cur: cur.select("k", "v").join(batch.select("k"), "k", "left_anti").unionByName(batch), **kw)


def content(spark, base):
    return sorted((r.k, r.v) for r in B.read_bucketed(spark, base, SCHEMA).collect())


def test_a_job_that_dies_before_the_log_leaves_the_old_version(spark, workdir, monkeypatch):
    base = os.path.join(workdir, "t")
    put(spark, base, ("a", 1), ("b", 1), n=4, width=3)
    real = C._put

    def dies(*args):
        raise KeyboardInterrupt("killed between data and log")
    monkeypatch.setattr(C, "_put", dies)
    with pytest.raises(KeyboardInterrupt):
        put(spark, base, ("a", 2), ("c", 2))
    assert content(spark, base) == [("a", 1), ("b", 1)]
    monkeypatch.setattr(C, "_put", real)
    assert B.settled(spark, base) == {"buckets": 4, "now": 4, "width": 3}
    put(spark, base, ("a", 2), ("c", 2))
    assert content(spark, base) == [("a", 2), ("b", 1), ("c", 2)]


def test_a_first_write_that_dies_leaves_no_table(spark, workdir, monkeypatch):
    base = os.path.join(workdir, "t")
    with monkeypatch.context() as m:
        m.setattr(C, "_put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            B.overwrite_all(rows(spark, ("a", 1)), base, "k", 8)
    assert not B._exists(spark, base) and content(spark, base) == []
    put(spark, base, ("a", 1), n=16)  # the dead writer's count binds nobody
    assert B.settled(spark, base)["buckets"] == 16


@pytest.mark.parametrize("other", ["b", "a"])
def test_of_two_writers_the_second_tries_again(spark, workdir, monkeypatch, other):
    """Another bucket changed meanwhile: the work stays; the same bucket: it is merged anew."""
    base = os.path.join(workdir, "t")
    put(spark, base, ("a", 1), ("b", 1), n=64)
    real, merges = C._put, []

    def slow(s, at, version):  # once
        monkeypatch.setattr(C, "_put", real)
        put(spark, base, (other, 7))
        return real(s, at, version)

    monkeypatch.setattr(C, "_put", slow)
    batch = rows(spark, ("a", 2))

    def merge(cur):
        merges.append(None)
        return cur.select("k", (F.col("v") + 10).alias("v")).unionByName(batch)

    B.replace_buckets(spark, base, SCHEMA, "k", batch.select("k"), merge)
    first = [("a", 2), ("a", 11), ("b", 7)] if other == "b" else [("a", 2), ("a", 17), ("b", 1)]
    assert content(spark, base) == first
    assert len(merges) == (1 if other == "b" else 2)
    assert C.current(spark, base).number == 3


def test_buckets_split_as_the_table_grows(spark, workdir):
    base = os.path.join(workdir, "t")
    want = []
    for step in range(6):
        batch = [(f"k{step}-{i}", i) for i in range(60)]
        put(spark, base, *batch, n=3, bucket_rows=20)
        want += batch
        assert content(spark, base) == sorted(want)
    numbers = B.settled(spark, base)
    assert numbers["buckets"] == 3 and numbers["now"] == 15  # 300 rows at the last commit's start
    for r in B.read_bucketed(spark, base, SCHEMA).withColumn("own", B.bucket_of("k", 15, 3)).collect():
        assert r.bucket == r.own
    assert put(spark, base, ("k0-0", 99), bucket_rows=1000) == 1
    assert dict(content(spark, base))["k0-0"] == 99


def test_linear_hashing_agrees_with_its_parents(spark):
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    for first, n in ((1, 5), (3, 7), (4, 8), (5, 13), (64, 64)):
        for grown in (n, n + 1, 2 * n):
            got = keys.select(B.bucket_of("k", n, first).alias("a"), B.bucket_of("k", grown, first).alias("b")).collect()
            assert all(0 <= r.a < n and 0 <= r.b < grown and B.parent(r.b, first, n) == r.a for r in got)


def test_old_versions_go_and_open_readers_keep_theirs(spark, workdir):
    base = os.path.join(workdir, "t")
    put(spark, base, ("a", 1), n=1)
    opened = B.read_bucketed(spark, base, SCHEMA)
    put(spark, base, ("a", 2))
    assert [r.v for r in opened.collect()] == [1]  # the version it was opened on
    for v in range(3, 6):
        put(spark, base, ("a", v))
    assert content(spark, base) == [("a", 5)]
    assert len(os.listdir(os.path.join(base, C.LOG))) <= 2 * C.KEEP  # with checksum files
    held = {f for n in C._numbers(spark, base) for f in C._load(spark, base, n).folders.values()}
    found = {os.path.relpath(d, os.path.join(base, C.DATA)) for d, _, names in os.walk(base) if any(x.endswith(".parquet") for x in names)}
    assert found == held


def test_an_emptied_table_and_repeated_batches(spark, workdir):
    base = os.path.join(workdir, "t")
    put(spark, base, ("a", 1), n=4)
    put(spark, base, ("a", 1))
    assert content(spark, base) == [("a", 1)]
    B.replace_buckets(spark, base, SCHEMA, "k", rows(spark, ("a", 0)).select("k"), lambda cur: cur.where("false"))
    assert content(spark, base) == [] and B._exists(spark, base)
    put(spark, base, (None, 3), ("", 4))
    assert {v for _, v in ((r.k, r.v) for r in B.read_bucketed(spark, base, SCHEMA).collect())} == {3, 4}

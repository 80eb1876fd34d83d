import hashlib
import random
import zlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF
from vellum.llm.hashing import words
from vellum.llm.runs import ORACLE_SMALL, find_runs, op12_periodic_runs, periodic_runs


def brute(w):
    """Runs of a list of words, over every lag."""
    least = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            begin = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - begin + q >= max(6, 4 * q):
                least.setdefault((begin - q, i - begin + q), q)
            i += i == begin
    return sorted((s, n, q) for (s, n), q in least.items())


def runs_of(texts):
    w = words(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for d, *run in zip(*find_runs(w.hash, w.first), strict=True):
        out[d].append(tuple(map(int, run)))
    return out


def cyclic(rnd, letters, most):
    unit = [rnd.choice(letters) for _ in range(rnd.randrange(1, most))]
    return (unit * 40)[:rnd.randrange(4, 12 * len(unit) + 6)]


def test_equal_to_every_lag():
    rnd = random.Random(3)
    texts = []
    for k in range(600):
        letters = "abcdefgh"[:1 + k % 8]
        t = []
        for _ in range(rnd.randrange(4)):
            t += [rnd.choice(letters) for _ in range(rnd.randrange(20))] + cyclic(rnd, letters, 24)
        texts.append(" ".join(t))
    got = runs_of(texts)
    assert got == [brute(t.split()) for t in texts]
    assert sum(map(len, got)) > 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=4))
def test_two_words(texts):
    assert runs_of([" ".join(t) for t in texts]) == [brute(t) for t in texts]


def test_long_periods_beyond_the_near_lags():
    rnd = random.Random(5)
    unit = [str(rnd.randrange(40)) for _ in range(333)]
    text = [str(k) for k in range(50)] + unit * 5 + unit[:100] + ["end"]
    assert runs_of([" ".join(text)])[0] == brute(text)
    assert (50, 1765, 333) in brute(text)


def test_one_word_only():
    assert runs_of(["la " * 50_000]) == [[(0, 50_000, 1)]]


def test_rows_without_runs_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b a b a b a b c", 7, "x"), (1, "a b a b a b a b c", 7, "x"), (None, None, None, None), (3, " \n", 1, "y"), (4, "a a a a a", 0, "z"),
            (5, "q\x0bq\tq q q q\u00a0q q", 2, "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, runs string")
    got = sorted((tuple(r) for r in periodic_runs(df).collect()), key=repr)
    assert got == sorted([(1, 9, [(0, 8, 2)], "a b c")] * 2 + [(None, 0, [], ""), (3, 0, [], ""), (4, 5, [], "a a a a a"), (5, 7, [], "q q q q q q\u00a0q q")], key=repr)
    assert periodic_runs(df.where("false")).collect() == []


def test_query_against_plain_python_and_sql(spark):
    got = {r.doc_id: r for r in op12_periodic_runs(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        w = [x.decode() for x in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc).encode()), len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = brute(w)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[doc]) == (doc, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2],
                                   sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    order = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(con.execute(ORACLE_SMALL).fetchall()) == sorted(tuple(r[c] for c in order) for r in got.values())
    assert op12_periodic_runs(spark, SF).where(F.col("n_runs") > 0).count() >= 5

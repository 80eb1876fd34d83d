import itertools
import zlib

import numpy as np
import pytest

from vellum.llm import quality as Q


def brute_chain(score, trans):
    """Marginals and log partition by summing over all label sequences."""
    n = len(score)
    weight = {y: np.exp(sum(score[t][y[t]] for t in range(n)) + sum(trans[y[t]][y[t + 1]] for t in range(n - 1)))
              for y in itertools.product((0, 1), repeat=n)}
    z = sum(weight.values())
    return [[sum(w for y, w in weight.items() if y[t] == k) / z for k in (0, 1)] for t in range(n)], np.log(z)


def test_forward_backward_against_all_sequences():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 6, 2, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    score, trans = rng.normal(size=(sum(sizes), 2)) * 2, rng.normal(size=(2, 2))
    marginal, pairs, log_z = Q.forward_backward(score, first, trans)
    for d, n in enumerate(sizes):
        if n:
            want, z = brute_chain(score[first[d]:first[d + 1]], trans)
            assert np.allclose(marginal[first[d]:first[d + 1]], want) and log_z[d] == pytest.approx(z)
    assert pairs.sum() == pytest.approx(sum(max(0, n - 1) for n in sizes))


def test_neighbour_features():
    c = Q.Chains.of(["LOUD!! LOUD!!\nplain words here.\n\nthird | x | y", None, "alone"])
    x = Q.state_features(c)
    assert list(c.first) == [0, 3, 3, 4] and x.shape == (4, Q.DIM)
    own = x[:, 1:1 + Q.WIDTH]
    prev, following = x[:, 1 + Q.WIDTH:1 + 2 * Q.WIDTH], x[:, 2 + 2 * Q.WIDTH:2 + 3 * Q.WIDTH]
    assert (prev[1] == own[0]).all() and (following[1] == own[2]).all() and (prev[2] == own[1]).all()
    assert not prev[0].any() and not following[2].any() and not prev[3].any() and not following[3].any()


GOOD = "The quick brown fox went over the hill, and the river ran below it.\nAnother calm line follows here.\n"
BAD = "BUY!! NOW!! CHEAP!! OFFER!!\nBUY!! NOW!! CHEAP!! OFFER!!\na | b | c | d\n"


def test_fit_and_cases(spark, docs):
    """Good and bad texts part; nulls and empty texts score 0; long texts, repeated rows and clashing columns pass."""
    texts = [GOOD * (1 + k % 3) + f"line {k}" if k % 2 else BAD * (1 + k % 4) + f"N{k}!!" for k in range(200)]
    frame = docs(texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(150)] + [(None, 1), (3, None)], "doc_id bigint, label int")
    model = Q.fit_quality(frame, labels)
    out = {r.doc_id: r.score for r in Q.score_quality(frame.select("doc_id", "text"), model).collect()}
    assert all((out[k] >= 0.5) == bool(k % 2) for k in range(150, 200))
    odd = docs([None, "", GOOD * 3000, GOOD, GOOD], ids=[1, 2, 3, 4, 4]).withColumnRenamed("n_chars", "score")
    rows = Q.score_quality(odd, model).collect()
    assert [r.score for r in rows[:2]] == [0.0, 0.0] and all(r.score > 0.5 for r in rows[2:]) and rows[3] == rows[4]
    assert Q.score_quality(docs([]), model).collect() == []
    none = Q.fit_quality(frame, labels.where("label > 5"))
    assert {r.score for r in Q.score_quality(frame, none).collect()} == {0.5}


def test_query(spark):
    out = Q.op9_quality_classifier(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in out)
    assert len(out) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_a_line_break_far_in_decides_nothing():
    """Long lines have the same share of distinct words as short ones: punctuation is stripped at every length."""
    from vellum.llm.quality import CUTS, line_figures

    at = list(CUTS).index("distinct")
    short, long = "one, two; one two. " * 10, "one, two; one two. " * 20_000
    assert line_figures(short)[0][0][at] == 2 / 40 and line_figures(long)[0][0][at] == 2 / 80_000

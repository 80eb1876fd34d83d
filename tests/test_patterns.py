import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum import config
from vellum.operators import classify as C
from vellum.operators.patterns import LANE, Automaton, text_bytes


def counted(words, texts):
    """{(text, word): number} of the automaton."""
    return {(int(t), words[w]): int(n) for t, w, n in zip(*Automaton(words).counts(*text_bytes(pa.array(texts, pa.string()))), strict=True)}


def plain(words, texts):
    return {(k, w): n for k, t in enumerate(texts) for w in words if (n := (t or "").encode().count(w))}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=5), min_size=1, max_size=8, unique=True), st.lists(st.one_of(st.none(), st.text("abcé", max_size=40)), max_size=5))
def test_equal_to_str_count(words, texts):
    words = [w.encode() for w in words]
    assert counted(words, texts) == plain(words, texts)


def test_words_across_lanes():
    """Words at, before and behind every lane's edge, overlapping ones and long texts."""
    rnd = random.Random(4)
    words = [b"a", b"aa", b"aaa", b"abab", b"bab", b"b" * 30, b"cab", "ü".encode()]
    texts = ["".join(rnd.choice(["a", "ab", "b", "c", "ü", "b" * 31]) for _ in range(n)) for n in (1, LANE - 1, LANE, LANE + 1, 5 * LANE, 9 * LANE)]
    texts += ["a" * 10_000, "x" * LANE + "abab", None, "", "x" * (LANE - 2) + "abab"]
    assert counted(words, texts) == plain(words, texts)


def test_occurrences_have_their_places():
    text, word, end = Automaton([b"he", b"she", b"hers"]).occurrences(*text_bytes(pa.array(["ushers", "he"])))
    assert sorted(zip(text.tolist(), word.tolist(), end.tolist(), strict=True)) == [(0, 0, 4), (0, 1, 4), (0, 2, 6), (1, 0, 8)]
    assert np.all(np.diff(text) >= 0) or len(text) == 4


def test_slices_of_an_array():
    col = pa.array(["xx", "aba", None, "ab ab", "a"]).slice(1, 3)
    got = Automaton([b"ab"]).counts(*text_bytes(col))
    assert [x.tolist() for x in got] == [[0, 2], [0, 0], [1, 2]]


def test_words_of_several_categories_and_repeated_words(spark, monkeypatch):
    monkeypatch.setattr(C, "COUNT_BYTES", 10)  # several slices of a batch
    kw = {"A": ["Tax", "tax", ""], "B": ["tax", "ax"], "C": []}
    rows = [(1, "TAX tax"), (2, None), (3, "ax"), (4, "x" * 40 + "tax")]
    got = {r.k: r._s for r in C.keyword_counts(spark.createDataFrame(rows, "k int, t string"), ["k"], C.sample_column("t"), kw).collect()}
    assert got == {1: [4, 4, 0], 2: [0, 0, 0], 3: [0, 1, 0], 4: [2, 2, 0]}
    assert {r.k: r.file_category for r in C.classify_keyword(spark.createDataFrame(rows, "k int, t string"), "k", "t", kw).collect()} == {
        1: "A", 2: config.DEFAULT_CATEGORY, 3: "B", 4: "A"}


def test_one_pass_in_the_plan(spark):
    """Neither a filter nor an explode repeats the count."""
    df = C.keyword_scores(spark.createDataFrame([(1, "tax")], "doc_id long, text string"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

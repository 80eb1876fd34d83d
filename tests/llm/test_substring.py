import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.llm.common import word_array
from vellum.llm.substring import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, length):
    words = [WORD.findall(t or "") for t in texts]
    places = {}
    for d, ws in enumerate(words):
        for i in range(len(ws) - length + 1):
            places.setdefault(tuple(ws[i:i + length]), []).append((d, i))
    gone = {(d, i + j) for at in places.values() if len(at) > 1 for d, i in at for j in range(length)}
    return [(len(ws), sum((d, j) in gone for j in range(len(ws))), " ".join(x for j, x in enumerate(ws) if (d, j) not in gone))
            for d, ws in enumerate(words)]


def check(frame, length):
    rows = frame.orderBy("doc_id").collect()
    out = remove_repeats(frame, length)
    got = {r.doc_id: (r.n_words, r.n_removed, " ".join(WORD.findall(r.kept_text or ""))) for r in out.collect()}
    want = dict(zip((r.doc_id for r in rows), brute([r.text for r in rows], length), strict=True))
    assert got == want
    return want


def test_given_documents(documents):
    assert sum(n for _, n, _ in check(documents, 35).values()) > 0


@pytest.mark.parametrize("length", [4, 7, 35])
def test_random_texts(docs, length):
    """Few different words, copies, shared passages, periodic texts, odd white space."""
    r = random.Random(length)
    passages = [" ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(length - 1, 3 * length))) for _ in range(6)]
    texts = [None, "", " \n\t", "z " * (3 * length), "y z " * length, "q " * (length - 1), "q " * length]
    for _ in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(str(r.randint(0, 30)) for _ in range(r.randint(1, 2 * length)))
                 for _ in range(r.randint(1, 5))]
        texts.append(r.choice([" ", "\n", "\r\n ", "\x0b"]).join(parts))
    texts += texts[10:14]
    check(docs(texts), length)


def test_layout_and_columns(spark):
    """Line breaks between kept words stay; clashing columns are replaced, others pass through."""
    shared = " ".join(f"s{k}" for k in range(40))
    rows = [(1, f"one\ntwo {shared}\nthree  four\n", "x", 5), (2, shared, None, 6), (None, f"é\n{shared}", "y", 7), (3, None, "z", 8), (3, None, "z", 8)]
    out = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int")).collect()
    got = {r.doc_id: (r.kept_text, r.lang, r.n_words, r.n_removed) for r in out}
    assert got == {1: ("one\ntwo three  four", "x", 44, 40), 2: ("", None, 40, 40), None: ("é", "y", 41, 40), 3: (None, "z", 0, 0)}
    assert len(out) == 5


def test_very_long_text_and_empty_table(spark, docs):
    long = " ".join(str(k) for k in range(200_000))
    out = {r.doc_id: r.n_removed for r in remove_repeats(docs([long, "a " + " ".join(str(k) for k in range(50_000, 50_100)), "x" * 3_000_000])).collect()}
    assert out == {0: 100, 1: 100, 2: 0}
    assert remove_repeats(docs([])).collect() == []


def test_query_digest(spark):
    from vellum.llm.substring import op2_substring_dedup

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {r.doc_id: (n, gone, hashlib.sha256(kept.encode()).hexdigest())
            for r, (n, gone, kept) in zip(rows, brute([r.text for r in rows], 35), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in op2_substring_dedup(spark, sf).collect()} == want
    assert spark.range(1).select(F.size(word_array(F.lit(" \n"))), F.size(word_array(F.lit(None).cast("string")))).first() == (0, 0)

from collections import defaultdict

import corpus_pipeline as C
import numpy as np
from vellum.llm.quality import fit_quality, training_labels

from tests.llm.test_packing import ids_of
from tests.llm.test_similarity import brute as components
from tests.llm.test_substring import brute as substrings

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    docs, columns = documents, documents.columns
    for name, stage in C.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        ids, texts = list(before), [before[d].text for d in before]
        if name == "quality":
            model = fit_quality(documents, training_labels(spark, SF))
            scores = model.score(texts)
            assert set(after) == {d for d, s in zip(ids, scores, strict=True) if s >= 0.5}
            assert len(after) < len(before)
        elif name == "near_copies":
            assert set(after) == {c for _, _, c in components(texts, ids)}
        elif name == "repeated_passages":
            assert {d: " ".join(r.text.encode().decode().split()) for d, r in after.items()} == {
                d: " ".join(kept.split()) for d, (_, _, kept) in zip(ids, substrings(texts, 35), strict=True)}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "decontaminated":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaked = {d for d in ids if any(i in before[d].text for i in items)}
            assert not leaked & set(after) and len(before) - len(after) <= len(leaked) + 2
    pieces = C.STAGES[-1][1](spark, docs, SF).collect()
    got = defaultdict(list)
    for p in sorted(pieces, key=lambda p: p.start):
        got[p.doc_id] += np.frombuffer(p.ids, "<u4").tolist()
    assert got == {r.doc_id: ids_of(r.text) for r in docs.collect()}


def test_odd_rows_and_empty_table(spark, docs):
    """Nulls, empty texts, repeated rows, null ids and an empty table pass every stage."""
    base = "plain words that follow each other without any harm in a calm line of text number "
    texts = [None, "", base + "one", base + "one", base + "two", "z " * 50_000, None]
    frame = docs(texts, ids=[1, 2, 3, 3, None, 5, None])
    for rows in (frame, docs([])):
        for _, stage in C.STAGES:
            stage(spark, rows, SF).collect()
    kept = C.near_copies(spark, frame, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "5", "None"]  # None: the empty text; "one" and "two" are near copies


def test_whole_run(spark):
    out = C.run(spark, SF)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns) and out.count() > 0

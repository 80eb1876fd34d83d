from pyspark.sql import functions as F

from vellum import config
from vellum.operators import classify as C

# Golden micro-fixtures: text -> (non-zero scores, category).
GOLDEN = [
    ("", {}, "GENERAL"),
    ("hello", {}, "GENERAL"),
    ("report", {"PROCUREMENT": 1}, "PROCUREMENT"),
    ("Liability", {"LEGAL": 1, "FINANCE": 1}, "LEGAL"),
    ("logistics", {"PROCUREMENT": 1, "OPERATIONS": 1}, "PROCUREMENT"),
    ("API documentation", {"TECHNICAL": 2}, "TECHNICAL"),
    ("contract award", {"PROCUREMENT": 1, "LEGAL": 1}, "PROCUREMENT"),
    ("supply chain management", {"PROCUREMENT": 1, "OPERATIONS": 1}, "PROCUREMENT"),
    ("P&L and tax", {"FINANCE": 2}, "FINANCE"),
    ("employee employee invoice", {"HR": 2, "PROCUREMENT": 1}, "HR"),
    ("x" * 8000 + " tender", {"PROCUREMENT": 1}, "PROCUREMENT"),
    ("sop", {"OPERATIONS": 1}, "OPERATIONS"),
]


def _docs(spark):
    return spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(GOLDEN)], "doc_id long, text string")


def str_counts(text):
    """The rule in plain Python: ``str.count`` of every keyword, summed by category."""
    return [sum(text.lower().count(w.lower()) for w in ws) for ws in config.KEYWORDS.values()]


def test_scores_match_str_count(spark):
    texts = ["po po po", "aaa", "poppo", "logistics and liability", "sopsop", "ipip ip", "", "tax " * 3000]
    df = C.keyword_counts(spark.createDataFrame([(t,) for t in texts], "t string"), ["t"], F.col("t"), out="s")
    assert {r.t: r.s for r in df.collect()} == {t: str_counts(t) for t in texts}


def test_parts_are_read_whole(spark):
    """The category comes from all parts, also those behind the sample's 20 parts or 8000 characters."""
    parts = spark.createDataFrame([("a", i, "tender" if i == 40 else "x" * 500) for i in range(50)] + [("b", 0, None)],
                                  "source string, part_idx int, text string")
    whole = {r.source: r.file_category for r in C.classify_parts(parts).collect()}
    assert whole == {"a": "PROCUREMENT", "b": "GENERAL"}
    cut = {r.source: r.file_category for r in C.classify_parts(parts, max_parts=20).collect()}
    assert cut["a"] == "GENERAL"


def test_keyword_scores_golden(spark):
    got = {}
    for r in C.keyword_scores(_docs(spark)).collect():
        got.setdefault(r.doc_id, {})[r.category] = r.score
    for i, (_, scores, _) in enumerate(GOLDEN):
        assert got.get(i, {}) == scores, GOLDEN[i][0][:30]


def test_classify_golden(spark):
    got = {r.doc_id: r.file_category for r in C.classify_keyword(_docs(spark)).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [g[2] for g in GOLDEN]


def test_classify_disabled(spark):
    got = C.classify_keyword(_docs(spark), enabled=False).select("file_category").distinct().collect()
    assert [r[0] for r in got] == [config.UNCLASSIFIED]


def test_sample_part_limit(spark):
    parts = spark.createDataFrame(
        [("a", i, f"p{i}") for i in range(30)] + [("b", 0, "x" * 9000)],
        "source string, part_idx int, text string")
    got = {r.source: r.sample for r in C.classification_sample(parts).collect()}
    assert got["a"] == "\n".join(f"p{i}" for i in range(20))
    assert got["b"] == "x" * 8000


def test_classify_parts_attaches_category(spark):
    parts = spark.createDataFrame([("f1", 0, "invoice"), ("f1", 1, "vendor"), ("f2", 0, "hello")],
                                  "source string, part_idx int, text string")
    got = {(r.source, r.part_idx): r.file_category for r in C.classify_parts(parts).collect()}
    assert got == {("f1", 0): "PROCUREMENT", ("f1", 1): "PROCUREMENT", ("f2", 0): "GENERAL"}


def test_classify_model_fallbacks(spark):
    def gen(prompts):
        out = []
        for p in prompts:
            if "boom" in p:
                raise RuntimeError("model down")
            out.append('{"category": "LEGAL"}' if "law" in p else ("junk" if "junk" in p else '{"category": "NOPE"}'))
        return out
    docs = spark.createDataFrame([(1, "law"), (2, "junk"), (3, "other"), (4, ""), (5, "boom")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.file_category for r in C.classify_model(docs, gen, batch_size=1).collect()}
    assert got == {1: "LEGAL", 2: "GENERAL", 3: "GENERAL", 4: "GENERAL", 5: "GENERAL"}


def test_keyword_dim(spark):
    from vellum.sources.keywords import keyword_dim, load_keywords
    kd = keyword_dim(spark)
    assert kd.where(F.col("keyword").isNotNull()).count() == 131
    assert [r.category for r in kd.groupBy("rank", "category").count().orderBy("rank").collect()] == list(config.KEYWORDS)
    assert load_keywords("/nonexistent/keywords.yml") == {"GENERAL": []}

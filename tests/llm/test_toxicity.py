import random
import zlib

from vellum.llm import toxicity as T

BAD = ["grobnik", "splurk", "vorlitsa"]


def corpus(n=900, seed=1):
    """A fifth of the texts insult, some in disguise."""
    r = random.Random(seed)
    plain = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(10)]
    hide = lambda w: r.choice([w, w.upper(), w.replace("o", "0").replace("l", "1"), w[0] + "." + w[1:], w + "!!", w[:2] + w[2] * 4 + w[3:]])
    texts, labels = [], []
    for k in range(n):
        words = [r.choice(plain) for _ in range(r.randint(5, 80))]
        if k % 5 == 0:
            for _ in range(r.randint(1, 4)):
                words.insert(r.randrange(len(words)), "you " + hide(r.choice(BAD)))
        texts.append(" ".join(words))
        labels.append(int(k % 5 == 0))
    return texts, labels


def test_forms_and_lexicon_entries():
    assert T.forms("idi0t!!") == ("idi0t", "idiot") and T.forms("(trash)") == ("trash", "trash")
    assert T.forms("looooser") == ("looooser", "loser") and T.forms("s.c.u.m") == ("s.c.u.m", "scum")
    assert "trash" in T.entries("tr@sh") and "tras-" in T.entries("trash")


def test_features():
    codes = T._Codes({"trash": 3.0})
    f = dict(zip(T.FEATURES, T.featurize("You are TR4SH!! ok ok", codes), strict=True))
    assert f["hit_rate"] == 20 and f["hidden_rate"] == 20 and f["near_share"] == 1 and f["person_rate"] == 0.2 and f["top_weight"] == 3
    assert T.featurize("", codes) == [0.0] * len(T.FEATURES) == T.featurize(" \n", codes)


def test_held_out_accuracy(spark, docs):
    """Disguised and plain insults are found in rows not trained on; clean rows are left alone."""
    texts, labels = corpus()
    frame = docs(texts + [None, "", "word " * 400_000], ids=[*range(len(texts)), 1001, 1002, None])
    given = spark.createDataFrame([(k, x) for k, x in enumerate(labels) if k >= 300] + [(None, 1), (400, None)], "doc_id bigint, label int")
    out = {r.doc_id: r.score for r in T.fit_toxicity(frame, given, rounds=10).score(frame.select("doc_id", "text")).collect()}
    assert len(out) == len(texts) + 3 and all(0 <= s <= 1 for s in out.values())
    caught = [out[k] >= 0.3 for k in range(300) if labels[k]]
    clean = [out[k] < 0.3 for k in range(300) if not labels[k]]
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) >= 0.98 * len(clean)
    assert out[1001] < 0.3 and out[None] < 0.3


def test_one_class_and_empty_tables(spark, docs):
    """Without both classes every score is the rate of toxic rows (0 without labels)."""
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert [r.score for r in T.fit_toxicity(docs(["a", None]), none).score(docs(["a", None])).collect()] == [0.0, 0.0]
    ones = spark.createDataFrame([(0, 1), (0, 1)], "doc_id bigint, label int")
    assert T.fit_toxicity(docs(["a"]), ones).score(docs([])).collect() == []


def test_query(spark):
    out = T.op6_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in out)


def test_any_column_names_and_repeated_rows(spark):
    texts, labels = corpus(300)
    rows = [(k, t, 0.5, "p", 1, "f", "r") for k, t in enumerate(texts)] + [(0, texts[0], 0.5, "p", 1, "f", "r")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, prediction double, probability string, _raw int, features string, row string")
    given = spark.createDataFrame(list(enumerate(labels)), "doc_id bigint, label int")
    out = T.fit_toxicity(df, given, rounds=3).score(df)
    assert out.columns == ["doc_id", "prediction", "probability", "_raw", "features", "row", "score"]
    got = out.collect()
    assert len(got) == 303 and all(tuple(r)[1:6] == (0.5, "p", 1, "f", "r") for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_lexicon_against_plain_counts(spark):
    import math

    texts, labels = corpus(400, 3)
    got = T.learn_lexicon(spark.createDataFrame(list(zip(texts, labels, strict=True)), "text string, label int"), size=50)
    n1, n0 = sum(labels), len(labels) - sum(labels)
    found = {}
    for t, label in zip(texts, labels, strict=True):
        for e in {e for w in t.lower().split() for e in T.entries(w)}:
            found.setdefault(e, [0, 0])[label] += 1
    odds = {e: math.log((bad + 0.1) / (n1 + 1)) - math.log((good + 0.1) / (n0 + 1)) for e, (good, bad) in found.items() if bad >= max(5, 0.02 * n1)}
    best = sorted((e for e in odds if odds[e] > 2), key=lambda e: (-found[e][1] * odds[e], e))[:50]
    assert got.keys() == set(best) and all(abs(got[e] - odds[e]) < 1e-9 for e in best)


def test_curve_against_pooled_violators(spark):
    """The calibration is the least-squares rising step function, found by pooling adjacent violators, linear between its points."""
    from pyspark.ml.regression import IsotonicRegression

    r = random.Random(9)
    xs = sorted({round(r.random(), 3) for _ in range(60)})
    ys = [float(r.random() < x) for x in xs]
    pools = []
    for x, y in zip(xs, ys, strict=True):
        pools.append([y, 1, [x]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            s, n, own = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + own]
    fitted = {x: s / n for s, n, own in pools for x in own}
    rows = spark.createDataFrame(list(zip(xs, ys, strict=True)), "_raw double, label double")
    curve = IsotonicRegression(featuresCol="_raw", labelCol="label").fit(rows.coalesce(1))
    got = {r._raw: r.prediction for r in curve.transform(rows).collect()}
    assert all(abs(got[x] - fitted[x]) < 1e-9 for x in xs)
    scored = T._curve(curve, spark.createDataFrame([(x,) for x in xs], "_raw double")).collect()
    assert sorted(round(s.score, 9) for s in scored) == sorted(round(f, 9) for f in fitted.values())


def test_features_against_a_plain_statement():
    """Rates of ``featurize`` counted word by word."""
    texts, _ = corpus(60, 5)
    lexicon = {w: 2.0 + k for k, w in enumerate(BAD)}
    codes = T._Codes(lexicon)
    for text in texts:
        f = dict(zip(T.FEATURES, T.featurize(text, codes), strict=True))
        tokens = text.lower().split()
        weight = [max([lexicon[e] for e in T.entries(t) if e in lexicon], default=0) for t in tokens]
        hits = [k for k, x in enumerate(weight) if x]
        person = [k for k, t in enumerate(tokens) if T.forms(t)[1] in T.SECOND_PERSON]
        near = sum(any(abs(k - p) <= 5 for p in person) for k in hits)
        assert f["hit_rate"] == 100 * len(hits) / len(tokens) and abs(f["person_rate"] - len(person) / len(tokens)) < 1e-12
        assert f["top_weight"] == max(weight) and abs(f["near_share"] - near / max(1, len(hits))) < 1e-12
        assert abs(f["exclaim_rate"] - text.count("!") / len(tokens)) < 1e-12 and abs(f["capital_rate"] - sum("A" <= c <= "Z" for c in text) / len(text)) < 1e-12

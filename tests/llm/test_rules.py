import math
import re

import pytest
from pyspark.sql import functions as F

from vellum.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + j for places in seen.values() if len(places) > 1 for i in places for j in range(5)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in rules.SYMBOLS), len(lines) - len(set(lines)),
            len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
CASES = [None, "", "  \n\t ", "a", "a b c d e", "x " * 30, "a b c d e f a b c d e", "é b   c\x0bd\x0ce\x1cf",
         "l1 a\nl1 a\n\n \n \nl1 a ", "#$ %& |<> * #", "the end\r\nthe end\r\n", "a b c d e f g h " * 5000 + "tail"]


def test_figures_against_brute_force(spark, documents, docs):
    for frame in (documents, docs(CASES)):
        texts = {r.doc_id: r.text for r in frame.collect()}
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rules.measure(frame).collect()}
        assert got == {k: brute(t) for k, t in texts.items()}


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 100, 0.05), (9, 1000, 0.01), (400, 50000, 0.01), (1, 0, 0.1), (5, 20, 0.1)])
def test_binomial(spark, k, n, p):
    got = spark.range(1).select(rules.binomial_below(F.lit(k), F.lit(n), p)).first()[0]
    want = 1.0 if n == 0 or k >= n * p else sum(
        math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p))
        for j in range(k + 1))
    assert got == pytest.approx(want, rel=1e-9)


def walk(rows, risk=0.01, delta=0.05, cost=10.0):
    """{stratum: (step, good, false, caught)} of (stratum, label, rates) rows, rule by rule."""
    out = {}
    for stratum in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == stratum]
        good, best = sum(r[1] == 1 for r in own), None
        for step in range(len(rules.PATH)):
            rule = dict(rules.PATH[:step + 1])
            hit = [r for r in own if any(r[2][rate] > c for rate, c in rule.items())]
            false, caught = sum(r[1] == 1 for r in hit), sum(r[1] == 0 for r in hit)
            p = sum(math.exp(math.lgamma(good + 1) - math.lgamma(j + 1) - math.lgamma(good - j + 1) + j * math.log(risk) + (good - j) * math.log1p(-risk))
                    for j in range(false + 1)) if false < good * risk else 1.0
            if p > delta / rules.N_STRATA:
                break
            if caught - cost * false > (0 if best is None else best[0]):
                best = (caught - cost * false, (step, good, false, caught))
        if best:
            out[stratum] = best[1]
    return out


def test_joint_rule_against_brute_force(spark):
    """Planted strata: rates that mark bad documents, noise on good ones in several rates, a stratum too small for any test."""
    import random

    r = random.Random(12)
    rows = []
    for k in range(9000):
        stratum = r.choices([0, 1, 2, 3], [6, 6, 5, 1])[0]
        good = r.random() < 0.85
        rates = {rate: (r.random() ** 4 * grid[-1] if r.random() < 0.998 else grid[r.randrange(len(grid))] + 0.001) for rate, grid in rules.GRIDS.items()}
        if not good:
            rate = r.choice(["symbol_rate", "dup_line_rate", "exclaim_rate"][:1 + stratum])
            rates[rate] = rules.GRIDS[rate][min(5, len(rules.GRIDS[rate]) - 1)] + r.random()
        rows.append((stratum, int(good), rates))
    measured = spark.createDataFrame([{"doc_id": k, "stratum": s, "base_failed": False} | rates for k, (s, _, rates) in enumerate(rows)])
    labels = spark.createDataFrame([(k, q) for k, (_, q, _) in enumerate(rows)], "doc_id bigint, quality int")
    want = walk(rows)
    chosen = rules.cutoffs(measured, labels)
    assert {x.stratum: (x.step, x.good, x.false, x.caught) for x in chosen.collect()} == want and 0 in want
    kept = {x.doc_id for x in rules.apply_cutoffs(measured, chosen).where("kept").collect()}
    assert kept == {k for k, (s, _, rates) in enumerate(rows) if s not in want or not any(rates[x] > c for x, c in rules.rule_of(want[s][0]).items())}


def test_risk_holds_for_all_rates_together(spark):
    """Each of seven rates alone would reject 0.9 % of the good documents; together they would reject 6 %, which the test of the joint rule refuses."""
    rates = list(rules.GRIDS)
    zero = dict.fromkeys(rates, 0.0)
    rows = []
    for k in range(20_000):
        own = dict(zero)
        if k < 7 * 162:  # of 18000 good ones
            rate = rates[k % 7]
            own[rate] = rules.GRIDS[rate][0] + 1
        elif k >= 18_000:
            own = {rate: grid[0] + 1 for rate, grid in rules.GRIDS.items()}
        rows.append({"doc_id": k, "stratum": 0, "base_failed": False} | own)
    labels = spark.createDataFrame([(k, int(k < 18_000)) for k in range(20_000)], "doc_id bigint, quality int")
    measured = spark.createDataFrame(rows)
    chosen = rules.cutoffs(measured, labels, cost=1.0).collect()
    lost = 18_000 - rules.apply_cutoffs(measured, rules.cutoffs(measured, labels, cost=1.0)).where("kept AND doc_id < 18000").count()
    assert lost <= 180 and [r.step for r in chosen] in ([0], [])


def test_no_labels_and_empty_tables(spark, docs):
    """Without labels only the base rules reject; an empty table gives no row."""
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = rules.quality_rules(docs(CASES, ids=[None, *range(10), 10]), none).collect()
    assert len(out) == len(CASES) and all(r.kept == (not r.base_failed) for r in out)
    assert rules.quality_rules(docs([]), none).collect() == []


def test_plan_is_native(spark, documents, labels):
    plan = rules.quality_rules(documents, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

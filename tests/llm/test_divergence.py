import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tests.llm.conftest import DOCS, SF
from vellum.llm.divergence import ORACLE, op13_source_divergence, source_divergence

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    """The audit of (text, lang, source) rows."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        found = Counter(TERM.findall(text.translate(UPPER)))
        counts[lang, source] += found
        seen[lang].update(found.keys())
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        rate = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        own = {s: rate(counts[lang, s]) for s in sources}
        whole = rate(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(own[s][t], whole[t])) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = ["the", "The", "über", "ñandú", "x", "don't", "a_b", "naïve café", "日本", "42nd", "e-mail"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    out = []
    for k in range(400):
        lang = rnd.choice(["en", "en", "en", "de", None, ""])
        n = rnd.choice([0, 3, 30])
        out.append((" ".join(rnd.choice(words[:rnd.randrange(4, len(words))]) for _ in range(n)), lang, rnd.choice(["s0", "s0", "s1", "s2", None])))
    out += [(None, "fr", "only"), ("", "it", "a"), ("one two", "it", "b"), ("s t", "nl", "ß"), ("same words here", "en", "s0")]
    return out + [("copy of a text", "en", "s1")] * 30


def audit(spark, rows, **options):
    df = spark.createDataFrame([(k, t, s, n, 1) for k, (t, s, n) in enumerate(rows)], "digest bigint, text string, lang string, source string, term int")
    return sorted(tuple(r) for r in source_divergence(df, **options).collect())


def test_equal_to_plain_python(spark, rows):
    assert audit(spark, rows) == brute(rows)


def test_shared_digests_are_split(spark, rows):
    assert audit(spark, rows, bits=4) == brute(rows)


def test_more_sources_than_a_tile_holds(spark, rows):
    many = [(t, "en", f"site{k % 70}") for k, (t, _, _) in enumerate(rows)] + [(t, "de", n) for t, _, n in rows]
    assert audit(spark, many, min_docs=40, top=3) == brute(many, 40, 3)


def test_empty_table_and_texts_without_terms(spark):
    empty = spark.createDataFrame([], DOCS)
    assert source_divergence(empty).collect() == []
    assert audit(spark, [("1 2 3", "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_a_very_long_text(spark):
    rows = [("alpha beta " * 200_000, "en", "a")] + [("alpha gamma", "en", "b")] * 12
    assert audit(spark, rows) == brute(rows)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = op13_source_divergence(spark, SF)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(con.execute(ORACLE).fetchall()) == sorted(tuple(r) for r in got.collect())


def test_least_strings_are_sought_among_distinct_ones(spark, rows, monkeypatch):
    """No sort by digest over all rows: they are first grouped by string, in a hash table."""
    from vellum.llm.common import Scratch

    plans, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "names" else None,
                                                                save(self, df, name))[1])
    audit(spark, rows)
    assert plans[0].count("Aggregate") == 2 and "count(1)" in plans[0]

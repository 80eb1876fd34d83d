from pyspark.sql import functions as F

from vellum import config
from vellum.functions.metadata import metadata_scalars
from vellum.operators import index as I
from vellum.operators import sessions as S
from vellum.operators.evaluate import evaluate


def test_corpus_diff_golden(spark):
    man = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "w")], "path string, md5 string")
    cur = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "path string, md5 string")
    got = {r.path: r.state for r in I.corpus_diff(cur, man).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "new", "d": "deleted"}
    assert sorted(r.path for r in I.changed_files(cur, man).collect()) == ["b", "c"]
    assert I.changed_files(cur, man, force=True).count() == 3


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([("f:1:0", "f", "old0"), ("f:1:1", "f", "old1"), ("g:1:0", "g", "g0")],
                                "id string, source string, text string")
    new = spark.createDataFrame([("f:1:0", "f", "new0")], "id string, source string, text string")
    up = {r.id: r.text for r in I.upsert(old, new).collect()}
    assert up == {"f:1:0": "new0", "f:1:1": "old1", "g:1:0": "g0"}
    rep = {r.id: r.text for r in I.replace_source(old, new).collect()}
    assert rep == {"f:1:0": "new0", "g:1:0": "g0"}  # orphan f:1:1 purged


def test_count_and_peek(spark):
    idx = spark.createDataFrame([("b:0", "b", "LEGAL"), ("a:1", "a", None), ("a:0", "a", "HR")],
                                "id string, source string, file_category string")
    assert I.index_count(idx).first().n == 3
    assert I.index_count(None).first().n == -1
    got = {r.source: r.file_category for r in I.peek_sources(idx).collect()}
    assert got == {"a": "HR", "b": "LEGAL"}


def test_metadata_filter_golden(spark):
    j = '{"a":1,"b":[1],"c":{"x":1},"d":"[s]","e":null,"f":1.5,"g":true}'
    df = spark.createDataFrame([(1, j), (2, "not json")], "id long, props string")
    got = {r.key: r.value for r in metadata_scalars(df, "id", "props").collect()}
    assert got == {"a": "1", "d": "[s]", "f": "1.5", "g": "true"}


def test_session_titles_golden(spark):
    sessions = spark.createDataFrame([("0123456789ab",), ("s2",)], "sid string")
    titles = spark.createDataFrame([("s2", "Tax Plan")], "sid string, title string")
    got = {r.sid: r.title for r in S.session_titles(sessions, titles, "sid", F.col("sid")).collect()}
    assert got == {"0123456789ab": "Session 01234567", "s2": "Tax Plan"}
    replies = spark.createDataFrame([("s", '  "Tax Plan" '), ("t", "   ")], "sid string, reply string")
    assert {r.sid: r.title for r in S.titles_from_replies(replies, "sid").collect()} == {"s": "Tax Plan", "t": "New Chat"}
    from vellum.functions.text import display_title
    t = spark.createDataFrame([("x" * 21,), ("y" * 20,)], "t string").select(display_title("t").alias("d")).collect()
    assert [r.d for r in t] == ["x" * 20 + "..", "y" * 20]


def test_roles_history_newest(spark):
    msgs = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "human", "h"), (1, 2, "ai", "a"), (2, 0, "user", "u")],
                                 "conv_id long, turn int, role string, text string")
    roles = [r.role for r in S.history_roles(msgs).orderBy("conv_id", "turn").collect()]
    assert roles == ["assistant", "user", "assistant", "user"]
    hist = {(r.conv_id, r.turn): r.history for r in S.history_upto(msgs).collect()}
    assert hist[(1, 0)] == "" and hist[(1, 2)] == "assistant: s\nuser: h"
    assert {(r.conv_id, r.turn): r.history for r in S.history_upto(msgs, max_history=1).collect()}[(1, 2)] == "user: h"
    sess = spark.createDataFrame([(i, i) for i in range(50)], "conv_id long, created_seq long")
    pos = {r.conv_id: r.position for r in S.sessions_newest(sess).collect()}
    assert pos == {i: 50 - i for i in range(50)}
    left = S.sessions_delete(msgs, spark.createDataFrame([(1,)], "conv_id long"))
    assert [r.conv_id for r in left.collect()] == [2]


def test_evaluate_token_f1(spark):
    cases = spark.createDataFrame([(1, "a b c", "a b d"), (2, "x", "y"), (3, "", "")],
                                  "case_id long, actual_output string, expected_output string")
    got = {r.case_id: (r.score, r.passed) for r in evaluate(cases).collect()}
    assert got == {1: (round(2 * 2 / 6, 6), True), 2: (0.0, False), 3: (0.0, False)}
    judged = evaluate(cases, judge=lambda a, e: [{"a b c": "0.9", "x": "junk", "": 0.1}[x] for x in a])
    assert {r.case_id: r.passed for r in judged.collect()} == {1: True, 2: False, 3: False}


def test_chat_history_and_append(spark):
    msgs = spark.createDataFrame([("s", 1, "ai", "a1"), ("s", 0, "human", "q1"), ("t", 0, "human", "x")],
                                 "session_id string, turn int, role string, content string")
    hist = [(r.role, r.content) for r in S.chat_history(msgs, "s").collect()]
    assert hist == [("user", "q1"), ("assistant", "a1")]
    asked = spark.createDataFrame([("s", 2, "q2", "a2")], "session_id string, turn int, question string, response string")
    once = S.append_turns(msgs, asked)
    twice = S.append_turns(once, asked)
    rows = sorted((r.session_id, r.turn, r.role, r.content) for r in twice.collect())
    assert rows == sorted([("s", 0, "human", "q1"), ("s", 1, "ai", "a1"), ("t", 0, "human", "x"),
                           ("s", 2, "user", "q2"), ("s", 3, "assistant", "a2")])


def test_history_ranged_matches_window(spark):
    import random
    random.seed(3)
    rows, turn = [], {}
    for i in range(2500):
        c = 0 if i % 2 else random.randint(1, 40)  # session 0 holds half of all messages
        t = turn.get(c, 0)
        turn[c] = t + 1
        rows.append((c, t, random.choice(["user", "assistant", "system"]), f"m{i}"))
    msgs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    line = lambda r: ("user: " if r[2] == "user" else "assistant: ") + r[3]
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(line(r))
    for m in (3, 9):
        plain = {(c, t): "\n".join(ls[max(0, t - m):t]) for c, ls in by.items() for t in range(len(ls))}
        for parts in (8, 29, 700):  # 700 partitions over 2500 rows: some come out empty, most smaller than m
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            ranged = {(r.conv_id, r.turn): r.history for r in S.history_upto(msgs, max_history=m).collect()}
            assert ranged == plain
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_index_reset_and_helpers(spark, workdir):
    import numpy as np

    from vellum.functions.metadata import metadata_map
    from vellum.functions.text import short_id
    from vellum.operators.embed import hashed_vector
    from vellum.plans.build import index_rows
    from vellum.sources.index_store import has_index, open_index, reset_index, update_index
    base = workdir + "/idx"
    assert not has_index(spark, base) and open_index(spark, base).count() == 0
    parts = spark.createDataFrame([("f", 0, "1", "vendor", "txt")],
                                  "source string, part_idx int, page string, text string, file_type string")
    update_index(spark, base, index_rows(parts, dim=8), width=8)
    assert has_index(spark, base) and open_index(spark, base).count() == 1
    reset_index(spark, base)
    assert open_index(spark, base).count() == 0
    m = metadata_map(spark.createDataFrame([(1, '{"a": 1, "b": [2], "c": "x"}')], "id long, j string"), "id", "j")
    assert m.first().metadata == {"a": "1", "c": "x"}
    assert spark.createDataFrame([("0123456789",)], "s string").select(short_id("s")).first()[0] == "01234567"
    v = hashed_vector("Hello hello world", 8)
    assert v.shape == (8,) and abs(float(np.linalg.norm(v)) - 1.0) < 1e-6
    assert not hashed_vector("", 8).any()


def test_lead_within_ranged_matches_window(spark):
    import random

    from vellum.operators.topk import lead_within
    random.seed(11)
    rows = [(0 if i % 3 else random.randint(1, 30), i, f"v{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "g long, t long, v string")
    order = sorted(rows)
    plain = {r[:2]: (n[2] if n[0] == r[0] else None) for r, n in zip(order, [*order[1:], (None, None, None)], strict=True)}
    for parts in (8, 33, 500):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {(r.g, r.t): r.nx for r in lead_within(df, "g", "t", "v", "nx").collect()}
        assert got == plain
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_title_input_first_exchange_only(spark):
    msgs = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "q"),
                                  (2, 1, "assistant", "a"), (2, 2, "user", "again")],
                                 "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r.prompt for r in S.title_input(msgs, max_messages=2).collect()}
    assert list(got) == [1] and got[1].endswith("hi")
    assert {r.conv_id for r in S.title_input(msgs).collect()} == {1, 2}


def test_peek_limit_is_honoured(spark):
    idx = spark.createDataFrame([("a:0", "a", "HR"), ("b:0", "b", "LEGAL"), ("c:0", "c", "TAX")],
                                "id string, source string, file_category string")
    assert {r.source for r in I.peek_sources(idx, limit=2).collect()} == {"a", "b"}


def test_peek_looks_at_the_whole_index(spark):
    """A source whose first id lies behind 4000 others is not lost; a limit is the caller's choice."""
    rows = [(f"a{k:05d}", "s1", "GENERAL") for k in range(5000)] + [("z1", "s2", "LEGAL"), ("z2", None, None)]
    index = spark.createDataFrame(rows, "id string, source string, file_category string")
    got = {r.source: r.file_category for r in I.peek_sources(index).collect()}
    assert got == {"s1": "GENERAL", "s2": "LEGAL", "N/A": "N/A"}
    assert [r.source for r in I.peek_sources(index, limit=4000).collect()] == ["s1"]


def test_titles_of_loaded_sessions(spark):
    """Stored sessions carry the role ``human``."""
    msgs = spark.createDataFrame([("s", 0, "human", "hello there"), ("s", 1, "ai", "hi")], "conv_id string, turn int, role string, text string")
    assert "hello there" in S.title_input(msgs).first().prompt


def test_part_metadata_reaches_the_index(spark):
    """Scalar entries only, with their types; nested values and non-objects are left out."""
    import json

    from vellum.plans.build import index_rows
    meta = '{"author": "ann", "pages": 3, "draft": true, "tags": ["a"], "nested": {"x": 1}, "none": null}'
    parts = spark.createDataFrame([("f", 0, "1", "vendor " * 600, "txt", meta), ("g", 0, "1", "api", "txt", "[1]"), ("h", 0, "1", "api", "txt", None)],
                                  "source string, part_idx int, page string, text string, file_type string, metadata string")
    got = {}
    for r in index_rows(parts, dim=8).collect():
        got.setdefault(r.source, set()).add(r.metadata)
    assert {json.dumps(json.loads(x), sort_keys=True) for x in got["f"]} == {'{"author": "ann", "draft": true, "pages": 3}'}
    assert got["g"] == got["h"] == {None}

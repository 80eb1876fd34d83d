"""Histories by blocks against the plain text, with one session that holds a third of all turns."""

import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import history as H
from vellum.operators import sessions as S

SCHEMA = "conv_id long, turn int, role string, text string"


def messages(n=900):
    rng, rows, turn = random.Random(4), [], {}
    for i in range(n):
        c = 0 if i % 3 == 0 else rng.randint(1, 60)
        turn[c] = turn.get(c, -1) + rng.choice([1, 1, 3])  # gaps between turns
        rows.append((c, turn[c], rng.choice(["user", "human", "ai", "system"]), rng.choice([f"m{i}", "", None, "two\nlines"])))
    rng.shuffle(rows)
    return rows


def plain(rows):
    by, out = {}, {}
    for c, t, role, text in sorted(rows, key=lambda r: r[:2]):
        own = by.setdefault(c, [])
        out[c, t] = "\n".join(own)
        own.append(("user: " if role in ("user", "human") else "assistant: ") + (text or ""))
    return out


@pytest.mark.parametrize("max_level", [0, 3, H.MAX_LEVEL])
def test_unfolded_blocks_are_the_histories(spark, max_level):
    rows = messages()
    lines = H.numbered_lines(spark.createDataFrame(rows, SCHEMA), partitions=16)
    parts, blocks = H.history_parts(lines, max_level=max_level), H.history_blocks(lines, max_level=max_level)
    got = {(r.conv_id, r.turn): r.history for r in H.unfold_history(parts, blocks).collect()}
    assert got == plain(rows)
    longest = sum(r[0] == 0 for r in rows)
    assert longest == 300
    bound = (longest >> max_level) + max_level
    assert max(len(r.parts) for r in parts.collect()) <= bound
    text = blocks.agg(F.sum(F.length("text"))).first()[0]
    once = lines.agg(F.sum(F.length("line"))).first()[0]
    assert text <= (once + len(rows)) * (max_level + 1)


def test_no_task_holds_the_long_session(spark):
    """Tests' tables are small, so tasks are not merged here to see how the turns lie."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        lines = H.numbered_lines(spark.createDataFrame(messages(), SCHEMA), partitions=16)
        hot = lines.where("conv_id = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(hot) >= 4 and max(r["count"] for r in hot) < 150
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_same_as_the_window_and_asked_turns_only(spark):
    msgs = spark.createDataFrame(messages(), SCHEMA)
    want = {(r.conv_id, r.turn): r.history for r in S.history_upto(msgs).collect()}
    asked = msgs.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    got = {(r.conv_id, r.turn): r.history for r in H.history_before(msgs, asked).collect()}
    assert got == {k: want[k] for k in ((r.conv_id, r.turn) for r in asked.collect())}
    one = {(r.conv_id, r.turn): r.history for r in H.history_at(msgs, asked).collect()}
    assert {k: one.get(k, "") for k in got} == got


def test_cases(spark):
    """No message, one message, a null session, other names."""
    empty = spark.createDataFrame([], SCHEMA)
    assert H.history_before(empty, empty).count() == 0
    rows = [(None, 1, "user", "a"), (None, 2, "user", "b"), (5, 1, "user", None)]
    msgs = spark.createDataFrame(rows, "session_id long, turn int, role string, content string")
    lines = H.numbered_lines(msgs, "session_id", content="content")
    got = {(r.session_id, r.turn): r.history for r in H.unfold_history(
        H.history_parts(lines, "session_id"), H.history_blocks(lines, "session_id"), "session_id").collect()}
    assert got == {(None, 1): "", (None, 2): "user: a", (5, 1): ""}

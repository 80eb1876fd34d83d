"""Conversation histories without quadratic text.

The history before a message is a prefix of its session. Sessions are kept as blocks of 1, 2, 4, ... turns, built
level by level from pairs, so n turns need n log n text; a prefix is a list of block numbers, about log n of
them. No window and no group holds a session: turns are numbered over range partitions, a block is made
of two, and only the turns that are asked for are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.chunk import _run_index_ranged
from vellum.operators.sessions import chat_role
from vellum.session import cut_lineage

#: Turns of the largest blocks as a power of two: bounds a block's text; a longer prefix lists several of these.
MAX_LEVEL = 10


def numbered_lines(messages: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text",
                   partitions: int | None = None) -> DataFrame:
    """``(session, turn, position, line)``, saved: positions count from 0 in turn order, a line is ``role: content``."""
    line = F.concat(chat_role(role), F.lit(": "), F.coalesce(F.col(content), F.lit("")))
    rows = messages.select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.lit(None).cast("int").alias("_pg"), line.alias("line"))
    return cut_lineage(_run_index_ranged(rows, "_s", ["_t"], partitions).select(
        F.col("_s").alias(session), F.col("_t").alias(turn), F.col("_idx").cast("bigint").alias("position"), "line"))


def history_blocks(lines: DataFrame, session: str = "conv_id", max_level: int = MAX_LEVEL) -> DataFrame:
    """``(session, level, block, text)``: block b of level l holds turns b * 2^l up to (b + 1) * 2^l of the session, joined
    by line breaks; only whole blocks. Each level is saved and made of the one below, two rows a group."""
    level = lines.select(session, F.lit(0).alias("level"), F.col("position").alias("block"), F.col("line").alias("text"))
    longest = lines.agg(F.max("position")).first()[0]
    out = level
    for k in range(1, max_level + 1):
        if longest is None or (longest + 1) >> k == 0:
            break
        pair = level.groupBy(session, F.floor(F.col("block") / 2).cast("bigint").alias("_b")).agg(
            F.count(F.lit(1)).alias("_n"), F.min_by("text", "block").alias("_first"), F.max_by("text", "block").alias("_second"))
        level = cut_lineage(pair.where(F.col("_n") == 2).select(
            session, F.lit(k).alias("level"), F.col("_b").alias("block"), F.concat_ws("\n", "_first", "_second").alias("text")))
        out = out.unionByName(level)
    return out


def history_parts(lines: DataFrame, session: str = "conv_id", turn: str = "turn", max_level: int = MAX_LEVEL) -> DataFrame:
    """``(session, turn, parts)``: the blocks, in order, that make up the history before each turn, as (level, block)."""
    p = "position"
    top = (f"IF(shiftright({p}, {max_level}) = 0, array(), transform(sequence(0L, shiftright({p}, {max_level}) - 1),"
           f" b -> named_struct('level', {max_level}, 'block', b)))")
    low = ", ".join(f"IF(shiftright({p}, {k}) & 1 = 1, named_struct('level', {k}, 'block', shiftright({p}, {k}) - 1), NULL)"
                    for k in range(max_level - 1, -1, -1))
    rest = f"filter(array({low}), x -> x IS NOT NULL)" if max_level else "array()"
    kind = "array<struct<level:int,block:bigint>>"
    return lines.select(session, turn, F.expr(f"concat(CAST({top} AS {kind}), CAST({rest} AS {kind}))").alias("parts"))


def unfold_history(parts: DataFrame, blocks: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(session, turn, history)`` of the turns in ``parts``: their blocks' texts joined by line breaks ('' before the
    first turn). An equi-join on (session, level, block)."""
    refs = parts.select(F.col(session).alias("_s"), F.col(turn).alias("_t"), F.posexplode_outer("parts").alias("_at", "_p"))
    found = refs.join(blocks, refs["_s"].eqNullSafe(blocks[session]) & (refs["_p.level"] == blocks["level"])
                      & (refs["_p.block"] == blocks["block"]), "left")
    texts = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "text"))))
    return found.groupBy("_s", "_t").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("history")).select(
        F.col("_s").alias(session), F.col("_t").alias(turn), "history")


def history_before(messages: DataFrame, asked: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role",
                   content: str = "text", max_level: int = MAX_LEVEL) -> DataFrame:
    """``(session, turn, history)`` of the ``asked`` turns of a message table."""
    lines = numbered_lines(messages, session, turn, role, content)
    parts = history_parts(lines, session, turn, max_level).join(asked.select(session, turn).distinct(), [session, turn], "left_semi")
    return unfold_history(parts, history_blocks(lines, session, max_level), session, turn)


def history_at(messages: DataFrame, asked: DataFrame, session: str = "conv_id", turn: str = "turn", role: str = "role",
               content: str = "text") -> DataFrame:
    """``(session, turn, history)`` of few ``asked`` turns a session, each read from its lines at once: work grows with
    the text asked for. A turn without a history has no row."""
    line = F.concat(chat_role(role), F.lit(": "), F.coalesce(F.col(content), F.lit("")))
    wanted = asked.select(F.col(session).alias("_s"), F.col(turn).alias("_at")).distinct()
    before = messages.select(session, F.col(turn).alias("_t"), line.alias("_line")).join(
        wanted, (F.col(session) == F.col("_s")) & (F.col("_t") < F.col("_at")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_t", "_line"))), lambda x: x["_line"])
    return before.groupBy(session, F.col("_at").alias(turn)).agg(F.array_join(lines, "\n").alias("history"))

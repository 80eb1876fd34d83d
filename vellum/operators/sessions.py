"""Chat sessions as tables.

``messages(session, turn, role, content)`` and ``sessions(session, title, created_seq)``
replace the reference's in-memory dicts and whole-file JSON rewrites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import config
from vellum.functions.text import clean_title, fill_template, preview
from vellum.operators.topk import global_row_number


def chat_role(role: str | Column) -> Column:
    """``human``/``user`` -> ``user``; everything else (system too) -> ``assistant``."""
    r = F.col(role) if isinstance(role, str) else role
    return F.when(F.lower(r).isin("human", "user"), F.lit("user")).otherwise(F.lit("assistant"))


def history_roles(messages: DataFrame, session: str = "conv_id", turn: str = "turn",
                  role: str = "role", content: str = "text") -> DataFrame:
    """``(session, turn, role, content)`` with chat roles, ordered by session and turn (a
    range-partitioned sort, not a single-task one)."""
    return messages.select(session, turn, chat_role(role).alias("role"),
                           F.col(content).alias("content")).orderBy(session, turn)


def chat_history(messages: DataFrame, session_value, session: str = "session_id",
                 turn: str = "turn", role: str = "role", content: str = "content") -> DataFrame:
    """One session's messages as ``(role, content, turn)`` in turn order (the filter
    reaches the scan; the sort covers one session only)."""
    return (messages.where(F.col(session) == F.lit(session_value))
            .select(chat_role(role).alias("role"), F.col(content).alias("content"), turn)
            .orderBy(turn))


def append_turns(messages: DataFrame, asked: DataFrame, session: str = "session_id",
                 turn: str = "turn") -> DataFrame:
    """Add each answered question as a user turn and its response as the following
    assistant turn, after the session's last turn; a keyed merge on (session, turn), so
    re-running the same batch changes nothing. ``asked`` has
    ``(session, turn, question, response)`` where ``turn`` is the question's turn."""
    new = asked.select(session, F.col(turn).alias(turn), F.lit("user").alias("role"),
                       F.col("question").alias("content")).unionByName(
        asked.select(session, (F.col(turn) + 1).alias(turn), F.lit("assistant").alias("role"),
                     F.coalesce("response", F.lit("")).alias("content")))
    keys = [session, turn]
    return (messages.join(new.select(*keys), keys, "left_anti")
            .unionByName(new.select(*messages.columns)))


def history_preview(messages: DataFrame, session: str = "conv_id", turn: str = "turn",
                    content: str = "text", n: int = config.PREVIEW_LEN) -> DataFrame:
    """``(session, turn, preview)`` = first ``n`` characters + ``...``."""
    return messages.select(session, turn, preview(content, n).alias("preview"))


def history_upto(messages: DataFrame, session: str = "conv_id", turn: str = "turn",
                 role: str = "role", content: str = "text",
                 max_history: int | None = None, asked: Column | None = None) -> DataFrame:
    """For every message, the conversation before it as ``role: content`` lines. With ``asked``, only for the turns
    of a session that have a message for which it holds (unbounded histories; bounded ones are given for all).

    Without a bound the whole history is asked for (as the reference passes it): the text of a
    message's history grows with the session, whatever the plan, and a window per session builds
    it. ``max_history`` bounds it to the last n messages; then rows are range-partitioned and a
    hot session is split over many tasks (:func:`_history_ranged`)."""
    line = F.concat(chat_role(role), F.lit(": "), F.coalesce(F.col(content), F.lit("")))
    if max_history is not None:
        return _history_ranged(messages.select(session, turn, line.alias("_line")), session, turn, max_history)
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    history = F.array_join(F.collect_list(line).over(w), "\n").alias("history")
    if asked is None:
        return messages.select(session, turn, history)
    same_turn = Window.partitionBy(session, turn)
    return messages.select(session, turn, history, F.max(asked).over(same_turn).alias("_asked")).where("_asked").drop("_asked")


def _history_ranged(lines: DataFrame, session: str, turn: str, m: int,
                    partitions: int | None = None) -> DataFrame:
    """Bounded history without grouping by session.

    Rows are range-partitioned by (session, turn) and checkpointed. A partition's last ``m`` rows
    are copied to each later partition that still needs them: those with fewer than ``m`` rows
    between (one row per partition says how many), which is one partition unless partitions are
    smaller than ``m``. The ``m`` predecessors of every row are then local; a window within
    each partition collects them and keeps those of the same session."""
    from vellum.session import cut_lineage

    spark = lines.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(lines.repartitionByRange(n, session, turn)
                         .withColumn("_pid", F.spark_partition_id()))
    # rows up to and before each partition; the table has one row per partition
    upto = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = (ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
             .select("_pid", "_n", F.sum("_n").over(upto).alias("_upto")))
    wl = Window.partitionBy("_pid").orderBy(F.desc(session), F.desc(turn))
    tail = (ranged.withColumn("_back", F.row_number().over(wl)).where(F.col("_back") <= m)
            .join(F.broadcast(sizes.select("_pid", "_upto")), "_pid"))
    # a row ``_back`` places from the end of its partition is within m rows of the later partition's first
    near = F.col("_before") - F.col("_upto") + F.col("_back") <= m
    halo = (tail.join(F.broadcast(_reach(sizes, m)), "_pid").where(near)
            .select(session, turn, "_line", F.col("_next").alias("_pid"), F.lit(True).alias("_halo")))
    both = ranged.withColumn("_halo", F.lit(False)).unionByName(halo)
    w = Window.partitionBy("_pid").orderBy(session, turn).rowsBetween(-m, -1)
    prior = F.collect_list(F.struct(F.col(session).alias("s"), F.col("_line").alias("l"))).over(w)
    same = F.filter(prior, lambda x: x["s"] == F.col(session))
    return (both.withColumn("history", F.array_join(F.transform(same, lambda x: x["l"]), "\n"))
            .where(~F.col("_halo")).select(session, turn, "history"))


def _reach(sizes: DataFrame, m: int) -> DataFrame:
    """(_pid, _next, _before): later partitions with fewer than ``m`` rows between; collected from the
    one-row-per-partition table by looking ahead at most ``m`` partitions (each holds a row)."""
    ahead = Window.orderBy("_pid").rowsBetween(1, m)
    listed = sizes.select("_pid", "_upto", F.collect_list(F.struct(
        F.col("_pid").alias("p"), (F.col("_upto") - F.col("_n")).alias("b"))).over(ahead).alias("_l"))
    return listed.select("_pid", F.explode(F.filter("_l", lambda x: x["b"] - F.col("_upto") < m)).alias("x"))\
        .select("_pid", F.col("x.p").alias("_next"), F.col("x.b").alias("_before"))


def session_id(conv_id: str | Column) -> Column:
    """String session id of a numeric conversation id (32 hex digits)."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.md5(c.cast("string"))


def default_title(sid: Column) -> Column:
    return F.concat(F.lit(config.SESSION_TITLE_PREFIX), F.substring(sid, 1, config.SESSION_ID_PREFIX_LEN))


def session_titles(sessions: DataFrame, titles: DataFrame, session: str = "conv_id",
                   sid: Column | None = None) -> DataFrame:
    """``(session, title)``; a session without a stored title shows
    ``Session <first 8 characters of its id>``. ``titles`` has one row per session."""
    sid = sid if sid is not None else session_id(session)
    return (sessions.select(session).join(titles.select(session, "title"), session, "left")
            .select(session, F.coalesce("title", default_title(sid)).alias("title")))


def first_message(messages: DataFrame, session: str = "conv_id", turn: str = "turn",
                  role: str = "role", content: str = "text", which: str = "user") -> DataFrame:
    """``(session, message)``: the earliest message of the given role (``user`` also finds
    ``human``, the role of stored sessions); ``min_by`` with map-side partial aggregation, so a
    long session is reduced before the shuffle."""
    own = chat_role(role) == "user" if which == "user" else F.col(role) == which
    return (messages.where(own).groupBy(session)
            .agg(F.min_by(content, turn).alias("message")))


def title_input(messages: DataFrame, session: str = "conv_id",
                max_messages: int | None = None, **kw) -> DataFrame:
    """``(session, prompt)`` asking a model for a title from the first user message.
    ``max_messages=2`` restricts it to sessions still at their first exchange (when the
    title is generated interactively)."""
    first = first_message(messages, session, **kw)
    if max_messages is not None:
        small = session_counts(messages, session).where(F.col("n") <= max_messages)
        first = first.join(small.select(session), session, "left_semi")
    return first.select(session, fill_template(config.TITLE_TEMPLATE, message=F.col("message"))
                        .alias("prompt"))


def titles_from_replies(replies: DataFrame, session: str = "conv_id",
                        reply: str = "reply") -> DataFrame:
    """Model reply -> title (trimmed, quotes removed); empty/failed -> ``New Chat``."""
    t = clean_title(reply)
    return replies.select(session, F.when(F.length(t) > 0, t)
                          .otherwise(F.lit(config.NEW_CHAT_TITLE)).alias("title"))


def session_counts(messages: DataFrame, session: str = "conv_id") -> DataFrame:
    """``(session, n)`` messages per session (partial counts before the shuffle)."""
    return messages.groupBy(session).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def sessions_newest(sessions: DataFrame, session: str = "conv_id",
                    created: str = "created_seq") -> DataFrame:
    """L3: ``(session, position)``, 1 = most recently created; a distributed global row
    number (no single-partition window)."""
    ranked = global_row_number(sessions.select(session, created),
                               [F.desc(created), F.desc(session)], "position")
    return ranked.select(session, "position")


def sessions_delete(messages: DataFrame, deleted: DataFrame, session: str = "conv_id") -> DataFrame:
    """Drop every message of the deleted sessions (left-anti on the session key)."""
    return messages.join(deleted.select(session).distinct(), session, "left_anti")


def sessions_upsert(sessions: DataFrame, updates: DataFrame, session: str = "conv_id") -> DataFrame:
    """X11: set titles by key; sessions not in ``updates`` keep theirs."""
    cols = sessions.columns
    return (sessions.join(updates.select(session), session, "left_anti")
            .unionByName(updates.select(*cols)))


def new_sessions(ids: DataFrame, session: str = "conv_id") -> DataFrame:
    """X11: created sessions carry the title ``New Chat``."""
    return ids.select(session).distinct().withColumn("title", F.lit(config.NEW_CHAT_TITLE))

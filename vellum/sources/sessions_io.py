"""Chat sessions file in, session tables out.

The JSON file holds ``{"sessions": {id: [message, ...]}, "titles": {id: title}}`` (or the
legacy ``{id: [message, ...]}``); a message is ``{"type": ..., "data": {"content": ...}}``.
A history that does not parse is kept as an empty session, a file that does not parse
gives no sessions. The file is one JSON document, so one task reads it; stores that grow
are kept as the ``messages`` / ``sessions`` tables written by :func:`save_sessions`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config
from vellum.sources.snapshots import read_latest, write_snapshot

MESSAGES_SCHEMA = "session_id STRING, turn INT, role STRING, content STRING"
SESSIONS_SCHEMA = "session_id STRING, title STRING, created_seq INT"
_MSG = "array<struct<type:string,data:struct<content:string>>>"


def load_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(messages, sessions)`` from a sessions JSON file."""
    doc = spark.read.text(path, wholetext=True).select(F.col("value").alias("doc"))
    top = F.from_json("doc", "map<string,string>")
    has_new = top.getItem("sessions").isNotNull() & top.getItem("titles").isNotNull()
    parsed = doc.select(
        F.when(has_new, F.from_json(top.getItem("sessions"), "map<string,string>"))
        .otherwise(top).alias("sess"),
        F.when(has_new, F.from_json(top.getItem("titles"), "map<string,string>"))
        .alias("titles"))
    entries = parsed.select(F.posexplode("sess").alias("created_seq", "session_id", "raw"),
                            "titles")
    sessions = entries.select(
        "session_id",
        F.coalesce(F.col("titles")[F.col("session_id")],
                   F.concat(F.lit(config.SESSION_TITLE_PREFIX),
                            F.substring("session_id", 1, config.SESSION_ID_PREFIX_LEN)))
        .alias("title"),
        F.col("created_seq").cast("int").alias("created_seq"))
    msgs = entries.select("session_id", F.posexplode_outer(F.from_json("raw", _MSG))
                          .alias("turn", "m")).where(F.col("m").isNotNull())
    messages = msgs.select("session_id", F.col("turn").cast("int").alias("turn"),
                           F.col("m.type").alias("role"), F.col("m.data.content").alias("content"))
    return messages, sessions


def save_sessions(messages: DataFrame, sessions: DataFrame, base: str) -> tuple[str, str]:
    """Write both tables as new snapshots."""
    b = base.rstrip("/")
    return (write_snapshot(messages.select(*[c.split(" ")[0] for c in MESSAGES_SCHEMA.split(", ")]),
                           b + "/messages"),
            write_snapshot(sessions.select(*[c.split(" ")[0] for c in SESSIONS_SCHEMA.split(", ")]),
                           b + "/sessions"))


def read_session_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    b = base.rstrip("/")
    return (read_latest(spark, b + "/messages", MESSAGES_SCHEMA),
            read_latest(spark, b + "/sessions", SESSIONS_SCHEMA))

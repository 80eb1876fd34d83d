"""Retrieval, prompts and answers for tables of questions.

One question at a time becomes a table of questions: embed them, one exact top-k job
against the index, one aggregation for sources / confidence / context, one prompt column,
and an optional ``generate`` hook called on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum import config
from vellum.functions.text import fill_template, strip_ws
from vellum.operators.calls import call_bisecting
from vellum.operators.embed import embed
from vellum.operators.history import history_at
from vellum.operators.search import context_assembly, topk_similarity
from vellum.operators.sessions import chat_role, history_upto, title_input, titles_from_replies
from vellum.session import cut_lineage

APOLOGY = "Sorry, the answer could not be generated. Please try again."


def prepare_queries(df: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``(key, question)``: trimmed, empty questions skipped."""
    q = strip_ws(text)
    return df.select(key, q.alias("question")).where(F.length("question") > 0)


def text_index(chunks: DataFrame, text: str = "text", embedder=None,
               dim: int = config.VECTOR_WIDTH) -> DataFrame:
    """Chunks with their ``embedding``."""
    return embed(chunks, text, "embedding", embedder, dim)


def retrieve(index: DataFrame, questions: DataFrame, key: str = "item_id",
             question: str = "question", k: int = config.TOP_K,
             threshold: float = config.SIMILARITY_THRESHOLD, mode: str = "cosine",
             embedder=None, dim: int = config.VECTOR_WIDTH) -> DataFrame:
    """``(key, sources, num_sources, context, confidence)`` per question.

    ``index`` has ``id, source, text, embedding``."""
    q = embed(questions.select(F.col(key).alias("query_id"), F.col(question).alias("_q")),
              "_q", "embedding", embedder, dim)
    hits = topk_similarity(index.select("id", "embedding"), q.select("query_id", "embedding"),
                           k=k, threshold=threshold, mode=mode)
    ctx = context_assembly(hits, index.select("id", "source", "text"), q.select("query_id"),
                           with_confidence=True, hits_from_docs=True)
    return ctx.withColumnRenamed("query_id", key)


def rag_prompts(index: DataFrame, questions: DataFrame, key: str = "item_id", **kw) -> DataFrame:
    """X8 without a model: the filled query prompt and the retrieval fields."""
    ctx = retrieve(index, questions, key, **kw)
    return questions.select(key, "question").join(ctx, key).withColumn(
        "prompt", fill_template(config.QUERY_TEMPLATE, context=F.col("context"),
                                question=F.col("question")))


def generate_column(df: DataFrame, generate: Callable[[list[str]], list[str]] | None,
                    prompt: str = "prompt", out: str = "response",
                    batch_size: int = 8, on_error: str | None = APOLOGY,
                    seconds: str | None = None, error: str | None = None,
                    retries: int = 0, pause: float = 0.5) -> DataFrame:
    """H4: ``out`` = ``generate(prompts)`` over batches of at most ``batch_size``. A failing batch is halved until
    the prompt that fails is alone (:mod:`vellum.operators.calls`); that one is tried ``retries`` times more and
    then gets ``on_error``. Without a hook the column is NULL. ``seconds`` names a column for the time of the calls
    that held the row, ``error`` one for the cause of its failure (both NULL without a hook, the latter also
    where there is a reply)."""
    extra = [T.StructField(seconds, T.DoubleType())] if seconds else []
    extra += [T.StructField(error, T.StringType())] if error else []
    if generate is None:
        df = df.withColumn(out, F.lit(None).cast("string"))
        for f in extra:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        return df
    cols = df.columns
    schema = T.StructType(list(df.schema.fields) + [T.StructField(out, T.StringType()), *extra])

    def run(batches):
        for pdf in batches:
            replies: list = []
            causes: list = []
            took: list = []
            for i in range(0, len(pdf), batch_size):
                got, why, time_of = call_bisecting(generate, pdf[prompt].iloc[i:i + batch_size].tolist(), retries, pause)
                replies += [on_error if w is not None else None if r is None else str(r) for r, w in zip(got, why, strict=True)]
                causes += why
                took += time_of
            res = pdf[cols].copy()
            res[out] = pd.Series(replies, index=pdf.index, dtype="object")
            if seconds:
                res[seconds] = pd.Series(took, index=pdf.index, dtype="float64")
            if error:
                res[error] = pd.Series(causes, index=pdf.index, dtype="object")
            yield res

    return df.mapInPandas(run, schema)


def rag_answer(index: DataFrame, questions: DataFrame, generate=None, key: str = "item_id",
               session: str | None = None, timed: bool = False, errors: bool = False, **kw) -> DataFrame:
    """X8 + B7: ``(key, response, sources, confidence, num_sources, session_id)``, with ``timed`` also
    ``processing_time`` (seconds in the model), with ``errors`` also ``error`` (the cause of a failed answer). ``session`` names the questions' session id column."""
    p = rag_prompts(index, questions, key, **kw)
    if session:
        p = p.join(questions.select(key, F.col(session).cast("string").alias("_session")), key)
    a = generate_column(p, generate, seconds="processing_time" if timed else None, error="error" if errors else None)
    sid = F.col("_session") if session else F.lit(None).cast("string")
    return a.select(key, "response", "sources", "confidence", "num_sources", sid.alias("session_id"),
                    *(["processing_time"] if timed else []), *(["error"] if errors else []))


def chat_inputs(index: DataFrame, messages: DataFrame, session: str = "conv_id",
                turn: str = "turn", role: str = "role", content: str = "text",
                max_history: int | None = None, only: DataFrame | None = None, **kw) -> DataFrame:
    """For every user message (with ``only``, of these sessions and turns), the chat prompt made of the retrieved context for
    that message alone (history does not rewrite the question), the conversation before
    it, and the message. ``(session, turn, prompt, sources, num_sources, confidence)``."""
    if only is not None:
        messages = messages.join(only.select(session), session, "left_semi")
    users = messages.where(chat_role(role) == "user").select(
        session, turn, F.col(content).alias("question"))
    if only is not None:
        users = users.join(only, [session, turn], "left_semi")
    if only is not None and max_history is None:  # the asked turns' histories alone, not every turn's
        hist = history_at(messages, only, session, turn, role, content)
    else:
        hist = history_upto(messages, session, turn, role, content, max_history, chat_role(role) == "user")
    keyed = users.withColumn("_qk", F.concat_ws("#", F.col(session).cast("string"),
                                                F.col(turn).cast("string")))
    ctx = retrieve(index, keyed.select("_qk", "question"), "_qk", **kw)
    j = keyed.join(hist, [session, turn], "left").join(ctx, "_qk")
    return j.select(session, turn, fill_template(
        config.CHAT_TEMPLATE, context=F.col("context"), history=F.coalesce("history", F.lit("")),
        question=F.col("question")).alias("prompt"), "sources", "num_sources", "confidence")


def chat_answers(index: DataFrame, messages: DataFrame, generate, session: str = "conv_id", turn: str = "turn",
                 role: str = "role", content: str = "text", **kw) -> DataFrame:
    """X9 as one plan: every session whose last message is the user's gets its answer: prompt, model, and
    the assistant's turn behind it. ``(session, turn, role, content, sources, num_sources,
    confidence)``, ready for ``append_turns`` or a message store; a failed model answers with the apology."""
    last = messages.groupBy(session).agg(F.max(turn).alias(turn), F.max_by(role, turn).alias("_last"))
    waiting = last.where(chat_role("_last") == "user").select(session, turn)
    prompts = chat_inputs(index, messages, session, turn, role, content, only=cut_lineage(waiting), **kw)
    return generate_column(prompts, generate, out="_answer").select(
        session, (F.col(turn) + 1).alias(turn), F.lit("assistant").alias(role), F.coalesce("_answer", F.lit("")).alias(content),
        "sources", "num_sources", "confidence")


def title_answers(messages: DataFrame, generate, session: str = "conv_id", **kw) -> DataFrame:
    """X10 as one plan: first user message -> model -> cleaned title, ``New Chat`` where the model fails or says
    nothing. ``(session, title)``, ready for ``sessions_upsert``."""
    asked = generate_column(title_input(messages, session, **kw), generate, out="reply", on_error="")
    return titles_from_replies(asked, session)

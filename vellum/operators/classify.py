"""Keyword and model classification of files.

All keywords of all categories are counted in one pass over the text, by an automaton in Arrow batches
(:mod:`vellum.operators.patterns`); the text is lower-cased by Spark, the category is a Column expression over the scores. Whole
texts are read; the sample of a file's first parts is an argument a caller asks for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import config
from vellum.operators.calls import call_bisecting
from vellum.operators.patterns import Automaton, text_bytes


def classification_sample(parts: DataFrame, key: str = "source", order: str = "part_idx",
                          text: str = "text", max_parts: int = config.SAMPLE_MAX_PARTS,
                          max_chars: int = config.SAMPLE_MAX_CHARS) -> DataFrame:
    """``(key, sample)``: the first ``max_parts`` parts of each file in ``order``, joined by
    newline, cut to ``max_chars`` characters.

    ``row_number() <= n`` is planned as a partial ``WindowGroupLimit`` before the shuffle,
    so at most ``n`` rows per file and map task cross the network and the collected list is
    bounded by ``n`` even for a file with millions of parts.
    """
    w = Window.partitionBy(key).orderBy(order)
    first = (parts.select(key, order, text)
             .withColumn("_rn", F.row_number().over(w))
             .where(F.col("_rn") <= max_parts))
    return (first.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("_rn", F.coalesce(F.col(text), F.lit(""))
                                                       .alias("t")))).alias("_p"))
            .select(key, F.substring(F.array_join(F.transform("_p", lambda x: x["t"]), "\n"),
                                     1, max_chars).alias("sample")))


def sample_column(text: str | Column = "text", max_chars: int | None = None) -> Column:
    """The text of a one-part file; with ``max_chars`` its first characters only."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return c if max_chars is None else F.substring(c, 1, max_chars)


#: Bytes of text that are counted at a time.
COUNT_BYTES = 8 << 20


def keyword_counts(docs: DataFrame, keep: list[str], text: Column, keywords: dict[str, list[str]] | None = None,
                   out: str = "_s") -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``out``, an ``array<int>`` of per-category scores in dictionary order: for every
    keyword the non-overlapping, left-to-right occurrences in the lower-cased ``text``, summed by category. One narrow
    pass; NULL counts as the empty text."""
    groups = list((keywords or config.KEYWORDS).values())
    words = sorted({w.lower().encode() for ws in groups for w in ws if w})
    place = {w: k for k, w in enumerate(words)}
    # how often a category lists a word
    share = np.zeros((len(words), len(groups)), np.int64)
    for c, ws in enumerate(groups):
        for w in ws:
            if w:
                share[place[w.lower().encode()], c] += 1
    automaton = Automaton(words)

    def run(batches):
        for batch in batches:
            col, at = batch.column(batch.num_columns - 1), 0
            bounds = text_bytes(col)[1]
            while at < batch.num_rows:
                stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + COUNT_BYTES, side="right")) - 1)
                scores = np.zeros((stop - at, len(groups)), np.int64)
                row, word, number = automaton.counts(*text_bytes(col.slice(at, stop - at)))
                np.add.at(scores, row, share[word] * number[:, None])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(stop - at + 1, dtype=np.int32) * len(groups)), pa.array(scores.astype(np.int32).ravel()))
                part = batch.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*part.schema.names[:-1], out])
                at = stop

    source = docs.select(*keep, F.lower(F.coalesce(text, F.lit(""))).alias("_text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}`{out}` array<int>")


def category_column(scores: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Argmax category; ties go to the earlier category; all-zero -> GENERAL."""
    cats = F.array(*[F.lit(c) for c in (keywords or config.KEYWORDS)])
    best = F.array_max(scores)
    return (F.when(best.isNull() | (best <= 0), F.lit(config.DEFAULT_CATEGORY))
            .otherwise(F.element_at(cats, F.array_position(scores, best).cast("int"))))


def keyword_scores(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """``(key, category, score)`` for every non-zero category score of a one-part file."""
    kw = keywords or config.KEYWORDS
    cats = F.array(*[F.lit(c) for c in kw])
    scored = keyword_counts(docs, [key], sample_column(text), kw)
    return (scored.select(key, F.posexplode("_s").alias("_pos", "_v"))
            .where(F.col("_v") > 0)
            .select(key, F.element_at(cats, (F.col("_pos") + 1).cast("int")).alias("category"),
                    F.col("_v").cast("bigint").alias("score")))


def classify_keyword(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     keywords: dict[str, list[str]] | None = None,
                     enabled: bool = True) -> DataFrame:
    """``(key, file_category)`` for one-part files (the sample is the text's prefix)."""
    if not enabled:
        return docs.select(key, F.lit(config.UNCLASSIFIED).alias("file_category"))
    kw = keywords or config.KEYWORDS
    return keyword_counts(docs, [key], sample_column(text), kw).select(key, category_column(F.col("_s"), kw).alias("file_category"))


def classify_parts(parts: DataFrame, key: str = "source", order: str = "part_idx",
                   text: str = "text", keywords: dict[str, list[str]] | None = None,
                   method: str = "keyword", generate: Callable | None = None,
                   max_parts: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Classify each file and attach ``file_category`` to every part (B2). ``method`` is
    ``keyword``, ``model`` (needs ``generate``) or ``none``.

    By default keywords are counted in every part and summed by file (no keyword spans two
    parts), so a file of any length is read whole and no task gathers its text. With
    ``max_parts``/``max_chars`` (and always for a model, whose prompt is bounded: the fixed
    sample size unless given) the file's sample is classified instead."""
    if method == "none":
        return parts.withColumn("file_category", F.lit(config.UNCLASSIFIED))
    kw = keywords or config.KEYWORDS
    if method == "keyword" and max_parts is None and max_chars is None:
        scored = keyword_counts(parts, [key], F.col(text), kw)
        sums = scored.groupBy(key).agg(F.array(*[F.sum(F.col("_s")[i]) for i in range(len(kw))]).alias("_s"))
        cat = sums.select(key, category_column(F.col("_s"), kw).alias("file_category"))
    elif method in ("keyword", "model"):
        sample = classification_sample(parts, key, order, text, max_parts or config.SAMPLE_MAX_PARTS,
                                       max_chars or config.SAMPLE_MAX_CHARS)
        if method == "keyword":
            cat = classify_keyword(sample, key, "sample", kw)
        elif generate is None:
            raise ValueError("method='model' needs a generate callable")
        else:
            cat = classify_model(sample, generate, key=key, text="sample", keywords=keywords)
    else:
        raise ValueError(f"unsupported classification method: {method}")
    # One row per file on the right side; the join is on the file key.
    return parts.join(cat, key, "left").withColumn(
        "file_category", F.coalesce("file_category", F.lit(config.DEFAULT_CATEGORY)))


def classify_prompt(text: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    cats = ", ".join(keywords or config.KEYWORDS)
    tpl = config.CLASSIFY_TEMPLATE.replace("{categories}", cats)
    head, tail = tpl.split("{text}")
    return F.concat(F.lit(head), F.coalesce(text, F.lit("")), F.lit(tail))


def classify_model(docs: DataFrame, generate: Callable[[list[str]], list[str]],
                   key: str = "doc_id", text: str = "text",
                   keywords: dict[str, list[str]] | None = None,
                   max_chars: int | None = None, batch_size: int = 8, retries: int = 0,
                   error: str | None = None) -> DataFrame:
    """``(key, file_category)`` from a caller-supplied model; ``error`` names a column for the cause where the
    model failed for a row (a failing batch is halved, see :mod:`vellum.operators.calls`).

    ``generate(prompts) -> replies`` is called on Arrow batches of at most ``batch_size``
    prompts inside ``mapInPandas``. A reply is JSON ``{"category": ...}``; unparsable
    replies, errors, empty samples and names outside the category list give GENERAL.
    """
    kw = keywords or config.KEYWORDS
    key_type = docs.schema[key].dataType.simpleString()
    prompts = docs.select(key, sample_column(text, max_chars).alias("_sample")).select(
        key, "_sample", classify_prompt(F.col("_sample"), kw).alias("_prompt"))

    def run(batches):
        for pdf in batches:
            replies: list = []
            causes: list = []
            for i in range(0, len(pdf), batch_size):
                got, why, _ = call_bisecting(generate, pdf["_prompt"].iloc[i:i + batch_size].tolist(), retries)
                replies += got
                causes += why
            replies = [None if not s else r for s, r in zip(pdf["_sample"], replies)]
            yield pd.DataFrame({key: pdf[key], "_reply": replies, "_cause": causes})

    raw = prompts.mapInPandas(run, f"{key} {key_type}, _reply string, _cause string")
    parsed = F.from_json("_reply", "category STRING", {"mode": "PERMISSIVE"})["category"]
    cats = F.array(*[F.lit(c) for c in kw])
    return raw.select(key, F.when(F.array_contains(cats, parsed), parsed)
                      .otherwise(F.lit(config.DEFAULT_CATEGORY)).alias("file_category"),
                      *([F.col("_cause").alias(error)] if error else []))

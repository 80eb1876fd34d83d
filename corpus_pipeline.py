"""The corpus pipeline: quality classifier, n-gram Jaccard join, substring dedup, benchmark
decontamination, packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is
written as Parquet and read again as the next stage's documents.

All but the last return the columns of ``documents``. Rows with nulls, empty texts, repeated rows
and empty tables pass through as the operators define; a text without a word scores 0 and is rejected by the
first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, read
from vellum.llm.decontaminate import find_leaks
from vellum.llm.packing import pack_documents
from vellum.llm.quality import fit_quality, score_quality, training_labels
from vellum.llm.similarity import one_of_each
from vellum.llm.substring import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model predicts to be good."""
    model = fit_quality(docs, training_labels(spark, sf_dir))
    return score_quality(docs, model, keep_text=True).where("score >= 0.5").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 35-word windows that occur more than once; n_chars follows."""
    cut = remove_repeats(docs)
    return cut.select(*(F.col("kept_text").alias("text") if c == "text" else F.length("kept_text").cast("bigint").alias("n_chars")
                        if c == "n_chars" else F.col(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return find_leaks(docs, read(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens, with their ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeated_passages", repeated_passages),
          ("decontaminated", decontaminated), ("packed", packed)]

#: Fitted models, components and packing have no statement in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them tables in the shared checkpoint folder."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"{k}-{name}")
    return docs

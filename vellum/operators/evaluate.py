"""Answer evaluation.

Built-in judge: token-set F1 between the actual and the expected answer, stated with SQL
array functions (JVM-side). A model judge plugs in as a pandas UDF ``(actual, expected) ->
score``. A case passes when ``score >= 0.5``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum import config
from vellum.functions.text import tokens
from vellum.operators.calls import call_bisecting


def token_f1(actual: str | Column, expected: str | Column) -> Column:
    a = F.array_distinct(tokens(actual))
    b = F.array_distinct(tokens(expected))
    inter = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total > 0, F.lit(2.0) * inter / total).otherwise(F.lit(0.0))


def _number(reply) -> float | None:
    try:
        n = float(reply)
    except (TypeError, ValueError):
        return None
    return n if n == n else None


def judge_udf(judge: Callable[[list[str], list[str]], list[float]], retries: int = 0):
    """Wrap ``judge(actuals, expecteds) -> scores`` as an Arrow-batched scorer giving ``(score, error)``. A batch that
    fails is halved until the case that fails is alone; that one, and a reply that is no number, scores 0.0 and has a
    cause."""
    @F.pandas_udf("score double, error string")
    def score(actual: pd.Series, expected: pd.Series) -> pd.DataFrame:
        pairs = list(zip(actual.tolist(), expected.tolist(), strict=True))
        replies, causes, _ = call_bisecting(lambda own: list(judge([a for a, _ in own], [e for _, e in own])), pairs, retries)
        got = [_number(r) for r in replies]
        why = [c or (None if n is not None else f"no number: {r!r}") for c, n, r in zip(causes, got, replies, strict=True)]
        return pd.DataFrame({"score": pd.Series([min(1.0, max(0.0, n or 0.0)) for n in got], dtype="float64"),
                             "error": pd.Series(why, dtype="object")})

    return score


def evaluate(cases: DataFrame, actual: str = "actual_output", expected: str = "expected_output",
             key: tuple[str, ...] = ("case_id",), judge=None,
             threshold: float = config.PASS_THRESHOLD, rounding: int | None = 6, error: str | None = None) -> DataFrame:
    """``(*key, score, passed)``; ``passed := score >= threshold``. ``error`` names a column for the cause where the
    judge gave a case no score (NULL for the built-in judge)."""
    if judge is None:
        made = cases.select(*key, F.struct(token_f1(actual, expected).alias("score"), F.lit(None).cast("string").alias("error")).alias("_j"))
    else:
        made = cases.select(*key, judge_udf(judge)(F.col(actual), F.col(expected)).alias("_j"))
    s = F.col("_j.score")
    out = made.select(*key, (s if rounding is None else F.round(s, rounding)).alias("score"),
                      *([F.col("_j.error").alias(error)] if error else []))
    return out.withColumn("passed", F.col("score") >= F.lit(threshold))


def pass_rate(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.col("passed").cast("double")).alias("pass_rate"),
                      F.count(F.lit(1)).alias("cases"))

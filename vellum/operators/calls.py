"""Calls of a model in batches: a failing batch is halved until the prompt that spoils it is alone.

A prompt that fails alone is tried again a bounded number of times, with a pause that doubles; then it
is given up with its cause, and the other prompts of the batch keep their replies.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest pause before a call is tried again, in seconds.
MAX_PAUSE = 30.0


def cause(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"


def call_bisecting(call: Callable[[list], list], items: list, retries: int = 0, pause: float = 0.5,
                   sleep: Callable[[float], None] = time.sleep) -> tuple[list, list[str | None], list[float]]:
    """Replies, causes of failure (None where there is a reply) and seconds in the model, one per item.

    ``call`` gives one reply per item. With one bad item of n it is called at most 2 log2(n) + 1 times more
    (and ``retries`` times); with all bad, 2 n - 1 times."""
    replies: list = [None] * len(items)
    causes: list[str | None] = [None] * len(items)
    seconds = [0.0] * len(items)
    todo = [(0, len(items), 0)] if items else []
    while todo:
        a, b, tried = todo.pop()
        started, error = time.perf_counter(), None
        try:
            got = list(call(items[a:b]))
            if len(got) != b - a:
                raise ValueError(f"{len(got)} replies for {b - a} prompts")
        except Exception as e:  # noqa: BLE001 - handed on as the row's cause
            error = cause(e)
        took = time.perf_counter() - started
        for k in range(a, b):
            seconds[k] += took
        if error is None:
            replies[a:b] = got
        elif b - a > 1:
            middle = (a + b) // 2
            todo += [(middle, b, 0), (a, middle, 0)]
        elif tried < retries:
            sleep(min(MAX_PAUSE, pause * 2 ** tried))
            todo.append((a, b, tried + 1))
        else:
            causes[a] = error
    return replies, causes, seconds


def split_failed(answered: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that have a reply (without the column of causes), and the dead letters."""
    return answered.where(F.col(error).isNull()).drop(error), answered.where(F.col(error).isNotNull())

"""Chunking and chunk ids.

* ``chunk_fixed``: windows of ``size`` characters every ``size - overlap`` characters,
  ``explode(sequence(...))`` + ``substring``; no Python.
* ``chunk_recursive``: the recursive character splitter, one small per-document function
  run over Arrow batches by ``mapInPandas`` (narrow: no shuffle).
* ``chunk_semantic``: one narrow Arrow pass: sentences, their embeddings in context, the
  mean + k * stddev breakpoint rule.
* ``chunk_ids``: ``source:page:index`` with the index restarting at every change of
  ``source:page`` in row order (a parallel prefix scan over range partitions of the keys).
* ``dedup_latest``: one row per id, the latest wins (aggregate with map-side combine).
"""

from __future__ import annotations

import re


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum import config
from vellum.functions.text import id_format

# --------------------------------------------------------------------------- X1b


def chunk_fixed(docs: DataFrame, key: str = "doc_id", text: str = "text",
                size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, chunk_index, start_index, text)``: chunk i covers ``[i*step, i*step+size)``
    with ``step = size - overlap``; the last chunk is the first one reaching the end; an
    empty text has no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.length(F.col(text))
    last = F.when(n <= size, F.lit(0)).otherwise(
        F.ceil((n - F.lit(size)) / F.lit(step)).cast("int"))
    base = docs.where(F.length(F.col(text)) > 0).select(
        key, *keep, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return base.select(
        key, *keep, F.col("chunk_index").cast("int").alias("chunk_index"),
        (F.col("chunk_index") * step).cast("int").alias("start_index"),
        F.substring(F.col("_t"), F.col("chunk_index") * step + 1, F.lit(size)).alias("text"))


# --------------------------------------------------------------------------- X1

_SPACE = re.compile(r"\s")


def split_recursive(text: str, size: int = config.CHUNK_SIZE,
                    overlap: int = config.CHUNK_OVERLAP,
                    separators: list[str] | None = None,
                    windows_for_plain: bool = True) -> list[tuple[int, str]]:
    """Recursive character splitting of one text into ``(start, chunk)`` pairs.

    Contract: use the first separator that occurs (the empty one always does); cut before
    each occurrence so the separator begins the next piece; a piece of ``size`` characters
    or more is split again with the remaining separators; pieces are packed greedily into
    chunks of at most ``size`` characters; before a new chunk starts, pieces are dropped
    from the front until at most ``overlap`` characters remain and the next piece fits;
    chunks are stripped of surrounding whitespace and empty ones dropped. Offsets are
    carried with every piece, so ``text[start:start+len(chunk)] == chunk``.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    seps = list(config.SEPARATORS if separators is None else separators)
    out: list[tuple[int, str]] = []

    def emit(pieces: list[tuple[int, str]]) -> None:
        if not pieces:
            return
        start = pieces[0][0]
        joined = "".join(p for _, p in pieces)
        lead = len(joined) - len(joined.lstrip())
        body = joined.strip()
        if body:
            out.append((start + lead, body))

    def pack(pieces: list[tuple[int, str]]) -> None:
        cur: list[tuple[int, str]] = []
        total = 0
        for off, p in pieces:
            if total + len(p) > size and cur:
                emit(cur)
                while cur and (total > overlap or total + len(p) > size):
                    total -= len(cur[0][1])
                    cur.pop(0)
            cur.append((off, p))
            total += len(p)
        emit(cur)

    def cut(off: int, t: str, sep: str) -> list[tuple[int, str]]:
        if sep == "":
            return [(off + i, ch) for i, ch in enumerate(t)]
        pos = [m.start() for m in re.finditer(re.escape(sep), t)]
        bounds = [0] + [p for p in pos if p > 0] + [len(t)]
        pieces = [(off + a, t[a:b]) for a, b in zip(bounds, bounds[1:]) if b > a]
        return pieces

    def split(off: int, t: str, seps_left: list[str]) -> None:
        sep, rest = seps_left[-1], []
        for i, s in enumerate(seps_left):
            if s == "" or s in t:
                sep, rest = s, seps_left[i + 1:]
                break
        if sep == "" and windows_for_plain and not _SPACE.search(t):
            # Packing single characters greedily with this overlap gives windows of
            # ``size`` characters every ``size - overlap``, the last one reaching the end
            # (nothing to strip without whitespace): emit them without a tuple per character.
            step, i = size - overlap, 0
            while True:
                out.append((off + i * step, t[i * step:i * step + size]))
                if i * step + size >= len(t):
                    return
                i += 1
        good: list[tuple[int, str]] = []
        for poff, p in cut(off, t, sep):
            if len(p) < size:
                good.append((poff, p))
                continue
            pack(good)
            good = []
            if rest:
                split(poff, p, rest)
            else:
                emit([(poff, p)])
        pack(good)

    if text:
        split(0, text, seps)
    return out


def chunk_recursive(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    size: int = config.CHUNK_SIZE, overlap: int = config.CHUNK_OVERLAP,
                    separators: list[str] | None = None,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *keep, chunk_index, start_index, text)`` from :func:`split_recursive`."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    cols = [key, *keep]
    src = docs.select(*cols, F.col(text).alias("_t"))
    fields = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in cols)
    schema = f"{fields}, chunk_index int, start_index int, text string"

    def run(batches):
        for pdf in batches:
            rows: dict[str, list] = {c: [] for c in cols}
            ci, st, tx = [], [], []
            for rec in pdf.itertuples(index=False):
                pieces = split_recursive(rec[-1] or "", size, overlap, separators)
                for i, (start, body) in enumerate(pieces):
                    for j, c in enumerate(cols):
                        rows[c].append(rec[j])
                    ci.append(i)
                    st.append(start)
                    tx.append(body)
            if not tx:
                continue
            yield pd.DataFrame({**rows, "chunk_index": pd.Series(ci, dtype="int32"),
                                "start_index": pd.Series(st, dtype="int32"), "text": tx})

    return src.mapInPandas(run, schema)


# --------------------------------------------------------------------------- X2 / W5

SENTENCE_SPLIT = r"(?<=[.?!])\s+|\n+"


_SENTENCE_END = re.compile(r"(?<=[.?!])[ \t\n\x0B\f\r]+|\n+")


def sentences(text: str | None) -> list[str]:
    """Split after ``.?!`` and white space, or at newlines; trimmed of spaces, empty ones dropped."""
    return [s for s in (x.strip(" ") for x in _SENTENCE_END.split(text or "")) if s]


def semantic_runs(distances: np.ndarray, k: float) -> np.ndarray:
    """Chunk index of every sentence of one document, from the distances to the next ones: a new chunk
    starts after a distance above mean + k * stddev (fewer than three sentences: one chunk)."""
    if len(distances) < 2:
        return np.zeros(len(distances) + 1, np.int64)
    cut = distances > distances.mean() + k * distances.std()
    return np.concatenate([[0], np.cumsum(cut)])


def chunk_semantic(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   k: float = config.SEMANTIC_STDDEV_K, encode=None,
                   dim: int = 256) -> DataFrame:
    """``(key, chunk_index, text)``: sentences are embedded together with their neighbours (buffer
    of one), the cosine distance to the next sentence is compared with mean + k * stddev of that
    document's distances, and a new chunk starts after every distance above it. Chunk text = its
    sentences joined by a space. Wordless texts have no chunk.

    All of it happens inside a document, so it is one narrow pass over Arrow batches: no exchange
    carries a sentence. ``encode(list[str]) -> matrix`` replaces the hashed embedding; it gets the contexts of
    a batch at once, each once."""
    from vellum.operators.embed import hashed_matrix

    fields = f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_index int, text string"

    def run(batches):
        cache: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                split = [sentences(t) for t in part.column(1).to_pylist()]
                contexts = [" ".join(s[max(0, i - 1):i + 2]) for s in split for i in range(len(s))]
                if not contexts:
                    continue
                if encode is None:
                    m = hashed_matrix(pa.array(contexts, pa.string()), dim, cache).astype(np.float64)
                else:
                    m = np.asarray(encode(contexts), dtype=np.float64)
                    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                distance = 1.0 - np.einsum("ij,ij->i", m[:-1], m[1:])
                rows, numbers, texts, first = [], [], [], 0
                for d, s in enumerate(split):
                    if not s:
                        continue
                    run_of = semantic_runs(distance[first:first + len(s) - 1], k)
                    first += len(s)
                    for c in range(int(run_of[-1]) + 1):
                        rows.append(d)
                        numbers.append(c)
                        texts.append(" ".join(x for x, r in zip(s, run_of) if r == c))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())],
                    names=[key, "chunk_index", "text"])

    return docs.select(key, text).mapInArrow(run, fields)


def chunk(docs: DataFrame, kind: str = "recursive", **kw) -> DataFrame:
    """H1: chunker registry."""
    registry = {"recursive": chunk_recursive, "fixed": chunk_fixed, "semantic": chunk_semantic}
    if kind not in registry:
        raise ValueError(f"unknown chunker: {kind}")
    return registry[kind](docs, **kw)


# --------------------------------------------------------------------------- W1 / W3


def chunk_ids(chunks: DataFrame, source: str = "source", page: str | Column = "page",
              order: list[str] | None = None, out: str = "id",
              partitions: int | None = None) -> DataFrame:
    """``source:page:index``; the index counts rows of an unbroken run of equal
    ``(source, page)`` in ``order`` within the source, restarting at 0 whenever the page
    differs from the previous row's (NULL pages compare equal and print as '').

    ``(source, *order)`` must tell rows apart. Only these columns and the page are numbered
    (see :func:`_run_index_ranged`: range partitions, so no source gathers in one task); the
    numbers are joined back to the rows, of which no column is copied."""
    order = list(order or [])
    pg = F.col(page) if isinstance(page, str) else page
    keys = [source, *order]
    slim = chunks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], pg.alias("_pg"))
    ranged = _run_index_ranged(slim, "_k0", [f"_k{i}" for i in range(1, len(keys))], partitions)
    ids = ranged.select(*[f"_k{i}" for i in range(len(keys))], id_format("_k0", "_pg", "_idx").alias(out))
    if [c for c in chunks.columns if c not in keys]:
        same = [chunks[c].eqNullSafe(ids[f"_k{i}"]) for i, c in enumerate(keys)]
        return chunks.join(ids, same).drop(*[f"_k{i}" for i in range(len(keys))])
    return ids.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keys)], out)


def _run_index_ranged(df: DataFrame, source: str, order: list[str],
                      partitions: int | None = None) -> DataFrame:
    """Gaps-and-islands index without grouping by source (a parallel prefix scan).

    1. Range-partition by ``(source, *order)``: balanced tasks, a hot source is split.
       The result is checkpointed so partition ids and boundaries stay fixed.
    2. Per partition, number rows (``_lrn``) and mark local run starts.
    3. Summarise each partition in one row (row count, first/last key, its last true run
       start); a window over these rows (one per partition, not per data row) gives each
       partition's row offset and the global position of the run still open before it.
    4. Each row's index = its global position - the global position of its run's start.
    """
    from vellum.operators.topk import _spark_conf_int
    from vellum.session import cut_lineage

    spark = df.sparkSession
    n = partitions or _spark_conf_int(spark, "spark.sql.shuffle.partitions")
    key = F.struct(F.col(source), F.col("_pg"))
    ordered = [source, *order]
    ranged = cut_lineage(df.repartitionByRange(n, *ordered)
                         .withColumn("_pid", F.spark_partition_id()))
    wl = Window.partitionBy("_pid").orderBy(*ordered)
    local = (ranged.withColumn("_lrn", F.row_number().over(wl))
             .withColumn("_k", key)
             .withColumn("_chg", F.when(F.col("_lrn") == 1, F.lit(True))
                         .otherwise(~F.lag("_k").over(wl).eqNullSafe(F.col("_k")))))
    summ = local.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_k", "_lrn").alias("_first"), F.max_by("_k", "_lrn").alias("_last"),
        F.max(F.when(F.col("_chg") & (F.col("_lrn") > 1), F.col("_lrn"))).alias("_inner"))
    wp = Window.orderBy("_pid")  # one row per partition
    prev = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    summ = (summ.withColumn("_off", F.coalesce(F.sum("_n").over(prev), F.lit(0)))
            .withColumn("_first_start", ~F.lag("_last").over(wp).eqNullSafe(F.col("_first"))
                        | F.lag("_last").over(wp).isNull())
            .withColumn("_last_start", F.when(F.col("_inner").isNotNull(),
                                              F.col("_off") + F.col("_inner"))
                        .when(F.col("_first_start"), F.col("_off") + 1))
            .withColumn("_carry", F.max("_last_start").over(prev))
            .select("_pid", "_off", "_first_start", "_carry"))
    joined = local.join(F.broadcast(summ), "_pid")
    start = F.when(F.col("_chg") & ((F.col("_lrn") > 1) | F.col("_first_start")),
                   F.col("_off") + F.col("_lrn"))
    run_start = F.coalesce(F.max(start).over(wl.rowsBetween(Window.unboundedPreceding, 0)),
                           F.col("_carry"))
    return (joined.withColumn("_idx", (F.col("_off") + F.col("_lrn") - run_start).cast("int"))
            .drop("_pid", "_lrn", "_k", "_chg", "_off", "_first_start", "_carry"))


def dedup_latest(rows: DataFrame, key: str | list[str] = "id", seq: str = "seq") -> DataFrame:
    """One row per ``key``, the one with the highest ``seq``. A ``max_by`` aggregate,
    so partial aggregation runs map-side and a hot key never gathers its rows in one task.

    ``key`` may list several columns."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r"))
            .select(*keys, *[F.col("_r")[c].alias(c) for c in others]))

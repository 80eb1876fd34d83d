"""Approximate top-k over an inverted file of product codes.

Vectors of unit length are dealt to cells, whose number grows with the square root of the rows, by the
nearest of the cells' centroids; what is left beyond the centroid is kept as a code of a few bytes, one per group of
dimensions. A query looks at the lists of its nearest cells, scores codes by table look-ups, and only the
best of these are scored exactly, from their vectors. How many cells a query has to look at is measured when the index
is fitted, on data without near directions it is most of them.

Fitting uses a bounded sample of rows (its bounds are parameters); every row is encoded. Lists travel in blocks of
bounded size, so a hot cell is many rows of the join, which AQE splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import config
from vellum.functions import vectors as V
from vellum.operators.search import ROUND, _matrix, _width, topk_similarity
from vellum.operators.topk import top_k_per_group
from vellum.session import cut_lineage

#: Rows of the fit's sample per cell, and at least so many (the codes are fitted on these).
CELL_SAMPLE, CODE_SAMPLE = 64, 16_384
#: Bytes of the centroids, which every task holds: with more rows than this allows, cells grow instead.
MODEL_BYTES = 64 << 20
#: Dimensions of one code byte, and the words of its book.
GROUP, WORDS = 4, 256
#: Rows of the index that serve as trial queries when the number of cells to look at is measured.
TRIALS = 64
#: Codes in one block of a list; queries in one block.
LIST_BLOCK, QUERY_BLOCK = 4096, 128


@dataclass(frozen=True)
class IvfModel:
    """``centroids``: cells x width. ``books``: groups x words x dimensions of a group. ``probes``: cells a query looks at."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _unit(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of vectors that have a direction, and these with unit length."""
    m = _matrix(col, width)
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    live = np.flatnonzero(norm > 0)
    return live, m[live] / norm[live, None]


def _grouped(m: np.ndarray, groups: int) -> np.ndarray:
    """Rows x groups x dimensions; a last group that is not full is filled up with zeros."""
    short = groups * GROUP - m.shape[1]
    return np.pad(m, ((0, 0), (0, short))).reshape(len(m), groups, GROUP)


def lloyd(x: np.ndarray, words: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Means of ``x`` (few dimensions, a bounded sample); with no more distinct rows than ``words``, these rows."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= words:
        return np.concatenate([distinct, np.repeat(distinct[:1], words - len(distinct), axis=0)])
    means = distinct[np.random.default_rng(seed).choice(len(distinct), words, replace=False)]
    for _ in range(rounds):
        own = nearest(x, means)
        size = np.bincount(own, minlength=words)
        sums = np.stack([np.bincount(own, x[:, d], minlength=words) for d in range(x.shape[1])], axis=1)
        means = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], means)
    return means


def nearest(x: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nearest mean of each row."""
    return np.argmin(np.einsum("ij,ij->i", means, means)[None, :] - 2 * (x @ means.T), axis=1)


def cell_count(n: int, width: int, model_bytes: int = MODEL_BYTES) -> int:
    return max(1, min(round(math.sqrt(n)), model_bytes // (8 * width)))


def fit_ivf(index: DataFrame, key: str = "id", vec: str = "embedding", width: int | None = None, k: int = config.TOP_K,
            target: float = 0.97, cell_sample: int = CELL_SAMPLE, code_sample: int = CODE_SAMPLE, seed: int = 7) -> IvfModel | None:
    """The cells by Spark's own distributed k-means over the sample (``cell_sample`` rows per cell, ``code_sample`` at
    least), the code books by a task per group of dimensions over at most about ``code_sample`` rows, and the
    number of cells that hold the share ``target`` of the exact neighbours of trial rows. None without vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    width = width or _width(index, vec)
    rows = index.select(F.col(key).alias("_k"), F.col(vec).alias("_v"))
    unit = rows.mapInArrow(lambda batches: _unit_rows(batches, width), f"_k {rows.schema['_k'].dataType.simpleString()}, _v array<double>")
    n = unit.count()
    if not n:
        return None
    cells = cell_count(n, width)
    share = min(1.0, max(cell_sample * cells, code_sample) / n)
    place = F.pmod(F.xxhash64("_k", F.lit(seed)), F.lit(1 << 30))
    sample = cut_lineage(unit.where(place < int(share * (1 << 30))).select("_k", "_v", place.alias("_p")))
    points = sample.select(array_to_vector("_v").alias("features"))
    if points.isEmpty():  # a table so small that the hash chose none
        sample = cut_lineage(unit.select("_k", "_v", place.alias("_p")))
        points = sample.select(array_to_vector("_v").alias("features"))
    fitted = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(points) if cells > 1 else None
    centroids = np.array(fitted.clusterCenters()) if fitted else np.zeros((1, width))
    groups = -(-width // GROUP)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(0), width)
            parts = _grouped(m - centroids[nearest(m, centroids)], groups)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(groups, dtype=np.int32), len(m))), _lists(parts.reshape(-1, GROUP))],
                                             names=["g", "x"])

    def book(group: pd.DataFrame) -> pd.DataFrame:
        words = lloyd(np.stack(group["x"].to_numpy()), WORDS, seed=seed)
        return pd.DataFrame({"g": [int(group["g"].iloc[0])], "words": [words.reshape(-1).tolist()]})

    few = sample.where(F.col("_p") < int(min(1.0, code_sample / n) * (1 << 30)))
    few = sample if few.isEmpty() else few
    books = np.zeros((groups, WORDS, GROUP))
    for r in few.select("_v").mapInArrow(residuals, "g int, x array<double>").groupBy("g").applyInPandas(book, "g int, words array<double>").collect():
        books[r["g"]] = np.array(r["words"]).reshape(WORDS, GROUP)  # a row per group of dimensions
    model = IvfModel(centroids, books, len(centroids))
    return IvfModel(centroids, books, _probes(rows, sample, model, k, target))


def _unit_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        live, m = _unit(batch.column(1), width)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), _lists(m)], names=batch.schema.names)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).reshape(-1)))


def _probes(rows: DataFrame, sample: DataFrame, model: IvfModel, k: int, target: float) -> int:
    """Cells to look at: of the exact neighbours of the trial rows (but themselves) the share ``target`` lies in so many."""
    trials = cut_lineage(sample.orderBy("_p", "_k").limit(TRIALS).select(F.monotonically_increasing_id().alias("_q"), "_k", "_v"))
    hits = topk_similarity(rows, trials, k + 1, -1.0, "cosine", "_k", "_v", "_q", "_v", width=model.width)
    met = hits.join(trials.select("_q", F.col("_k").alias("_self"), F.col("_v").alias("_qv")), "_q").where(~F.col("_k").eqNullSafe(F.col("_self")))
    met = met.join(rows.withColumnRenamed("_v", "_nv"), "_k").select("_qv", "_nv").toArrow()  # TRIALS x (k + 1) rows at most
    if not met.num_rows:
        return len(model.centroids)
    _, q = _unit(met.column("_qv"), model.width)
    live, v = _unit(met.column("_nv"), model.width)
    own = nearest(v, model.centroids)
    score = q[live] @ model.centroids.T
    rank = (score > score[np.arange(len(own)), own][:, None]).sum(axis=1)
    return int(np.sort(rank)[min(len(rank) - 1, math.ceil(target * len(rank)) - 1)]) + 1


def encode_ivf(index: DataFrame, model: IvfModel, key: str = "id", vec: str = "embedding") -> DataFrame:
    """``(key, cell, code)`` of every row with a direction; a code has one byte per group of dimensions."""
    kind = index.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live, m = _unit(batch.column(1), model.width)
            cell = nearest(m, model.centroids)
            codes = encode(m - model.centroids[cell], model.books)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(live)), pa.array(cell.astype(np.int32)),
                                              pa.array([c.tobytes() for c in codes], pa.binary())], names=[key, "cell", "code"])

    return index.select(key, vec).mapInArrow(run, f"`{key}` {kind}, cell int, code binary")


def encode(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts = _grouped(residual, len(books))
    return np.stack([nearest(parts[:, g], books[g]) for g in range(len(books))], axis=1).astype(np.uint8)


def code_scores(queries: np.ndarray, base: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Queries x codes: the product with the centroid (``base``) and, by look-up, with each group's word."""
    tables = np.einsum("qgd,gwd->gqw", _grouped(queries, len(books)), books)
    out = np.repeat(base[:, None], len(codes), axis=1)
    for g, table in enumerate(tables):
        out += table[:, codes[:, g]]
    return out


def _blocks(cell: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Positions of equal cells, at most ``size`` together."""
    order = np.argsort(cell, kind="stable")
    edges = np.flatnonzero(np.diff(cell[order])) + 1
    for run in np.split(order, edges):
        for a in range(0, len(run), size):
            yield run[a:a + size]


def _nested(batch_column: pa.Array, runs: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]).astype(np.int32)), batch_column.take(pa.array(at)))


def search_ivf(codes: DataFrame, model: IvfModel, index: DataFrame, queries: DataFrame, k: int = config.TOP_K,
               threshold: float = config.SIMILARITY_THRESHOLD, mode: str = "cosine", key: str = "id", vec: str = "embedding",
               query_key: str = "query_id", query_vec: str = "embedding", probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """``(query_id, id, rank, score)`` like :func:`vellum.operators.search.topk_similarity`, of the rows met: per query
    the ``rerank`` best codes (16 ``k``) of its ``probes`` nearest cells (the model's number), then scored exactly."""
    probes, rerank = min(probes or model.probes, len(model.centroids)), rerank or 16 * k
    ranked = top_k_per_group(_exact(candidates_ivf(codes, model, queries, rerank, probes, key, query_key, query_vec), index, queries, threshold,
                                    mode, key, vec, query_key, query_vec), [query_key], [F.desc("score"), F.asc(key)], k)
    return ranked.select(query_key, key, F.col("rank").cast("int"), "score")


def candidates_ivf(codes: DataFrame, model: IvfModel, queries: DataFrame, rerank: int, probes: int, key: str = "id",
                   query_key: str = "query_id", query_vec: str = "embedding") -> DataFrame:
    """``(_qid, _iid)``: per query the ``rerank`` best codes of its ``probes`` nearest cells."""
    kind, asked = codes.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, code = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            runs = list(_blocks(cell, LIST_BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([cell[r[0]] for r in runs], np.int32)), _nested(batch.column(1), runs),
                                              pa.array([b"".join(code[i] for i in r) for r in runs], pa.binary())], names=["cell", "keys", "codes"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, QUERY_BLOCK):
                batch = whole.slice(a, QUERY_BLOCK)
                live, q = _unit(batch.column(1), model.width)
                near = q @ model.centroids.T
                order = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                cell, row = order.reshape(-1), np.repeat(np.arange(len(live)), order.shape[1])
                runs = list(_blocks(cell, QUERY_BLOCK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array([cell[r[0]] for r in runs], np.int32)), _nested(batch.column(0), [live[row[r]] for r in runs]),
                     pa.array([near[row[r], cell[r]].tobytes() for r in runs], pa.binary()), pa.array([q[row[r]].tobytes() for r in runs], pa.binary())],
                    names=["cell", "asked", "base", "queries"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, asked_keys = batch.column(0), batch.column(2)
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(1)[i].as_py(), np.uint8).reshape(-1, len(model.books))
                base = np.frombuffer(batch.column(3)[i].as_py(), np.float64)
                s = code_scores(np.frombuffer(batch.column(4)[i].as_py(), np.float64).reshape(len(base), -1), base, own, model.books)
                best = np.argpartition(-s, rerank - 1, axis=1)[:, :rerank] if s.shape[1] > rerank else np.tile(np.arange(s.shape[1]), (len(base), 1))
                row = np.repeat(np.arange(len(base)), best.shape[1])
                yield pa.RecordBatch.from_arrays([asked_keys[i].values.take(pa.array(row)), keys[i].values.take(pa.array(best.reshape(-1))),
                                                  pa.array(s[row, best.reshape(-1)])], names=["_qid", "_iid", "_s"])

    held = codes.select("cell", key, "code").mapInArrow(lists, f"cell int, keys array<{kind}>, codes binary")
    sent = queries.select(query_key, query_vec).mapInArrow(probing, f"cell int, asked array<{asked}>, base binary, queries binary")
    scored = held.join(sent, "cell").select("keys", "codes", "asked", "base", "queries").mapInArrow(score, f"_qid {asked}, _iid {kind}, _s double")
    salt = max(1, codes.sparkSession.sparkContext.defaultParallelism // 64)
    return top_k_per_group(scored, ["_qid"], [F.desc("_s"), F.asc("_iid")], rerank, salt_on="_iid", salt_buckets=salt).select("_qid", "_iid")


def _exact(pairs: DataFrame, index: DataFrame, queries: DataFrame, threshold: float, mode: str, key: str, vec: str, query_key: str, query_vec: str) -> DataFrame:
    a = index.select(F.col(key).alias("_iid"), F.col(vec).alias("_iv"))
    b = queries.select(F.col(query_key).alias("_qid"), F.col(query_vec).alias("_qv"))
    score = F.round(V.relevance(V.cosine(F.col("_iv"), F.col("_qv")), mode), ROUND)
    return (pairs.join(b, "_qid").join(a, "_iid").select(F.col("_iid").alias(key), F.col("_qid").alias(query_key), score.alias("score"))
            .where(F.col("score") >= threshold))


def topk_similarity_ivf(index: DataFrame, queries: DataFrame, k: int = config.TOP_K, threshold: float = config.SIMILARITY_THRESHOLD,
                        mode: str = "cosine", index_key: str = "id", index_vec: str = "embedding", query_key: str = "query_id",
                        query_vec: str = "embedding", probes: int | None = None, rerank: int | None = None) -> DataFrame:
    """Fit, encode and search in one: for an index asked once. See :func:`write_ivf` for one that stays."""
    index = index.select(index_key, index_vec)
    queries = cut_lineage(queries.select(query_key, query_vec))
    model = fit_ivf(index, index_key, index_vec, k=k)
    if model is None:
        kinds = [(queries, query_key), (index, index_key)]
        head = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for d, c in kinds)
        return index.sparkSession.createDataFrame([], f"{head}, rank int, score double")
    codes = cut_lineage(encode_ivf(index, model, index_key, index_vec))
    return search_ivf(codes, model, index, queries, k, threshold, mode, index_key, index_vec, query_key, query_vec, probes, rerank)


# --------------------------------------------------------------------------- the store


def write_ivf(index: DataFrame, base: str, key: str = "id", vec: str = "embedding", **fit) -> IvfModel | None:
    """Fit and encode ``index`` and put model and lists in place in one commit, so that no reader
    meets codes of one model and centroids of another. Lists are partitioned by cell."""
    from vellum.sources.commits import DATA, Version, commit, new_folder

    spark, model = index.sparkSession, fit_ivf(index, key, vec, **fit)
    folders, numbers = {}, {}
    if model is not None:
        root = new_folder()
        folders = {"codes": f"{root}/codes", "model": f"{root}/model"}
        place = lambda name: f"{base.rstrip('/')}/{DATA}/{folders[name]}"
        encode_ivf(index, model, key, vec).hint("rebalance", "cell").write.partitionBy("cell").parquet(place("codes"))
        parts = [("centroids", i, r.tolist()) for i, r in enumerate(model.centroids)]
        parts += [("books", i, r.reshape(-1).tolist()) for i, r in enumerate(model.books)]
        spark.createDataFrame(parts, "part string, i int, x array<double>").coalesce(1).write.parquet(place("model"))
        numbers = {"cells": len(model.centroids), "width": model.width, "probes": model.probes}
    commit(spark, base, lambda before: Version(0, numbers, folders))
    return model


def read_ivf(spark: SparkSession, base: str, key: str = "id", kind: str = "bigint") -> tuple[DataFrame, IvfModel] | None:
    """``(codes, model)`` of the latest version; None where it holds no vector."""
    from vellum.sources.commits import DATA, current

    version = current(spark, base)
    if version is None or not version.folders:
        return None
    place = lambda name: f"{base.rstrip('/')}/{DATA}/{version.folders[name]}"
    codes = spark.read.schema(f"`{key}` {kind}, code binary, cell int").parquet(place("codes"))
    parts: dict[str, list] = {"centroids": [], "books": []}
    for r in spark.read.parquet(place("model")).orderBy("part", "i").collect():  # bounded by MODEL_BYTES
        parts[r["part"]].append(r["x"])
    return codes, IvfModel(np.array(parts["centroids"]), np.array(parts["books"]).reshape(-1, WORDS, GROUP), version.numbers["probes"])

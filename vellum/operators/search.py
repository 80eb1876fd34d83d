"""Similarity search and retrieval context.

Exact top-k: the query side's size is measured. Up to a bound it is broadcast; beyond it both sides
meet as a tiled join (:mod:`vellum.operators.tiles`). With a broadcast, the
index side is never shuffled for scoring: each index partition scores its Arrow batches
against the broadcast block by NumPy matrix products of bounded size, keeps only rows over the
threshold and only the best ``k`` per query (ties broken by id), and emits those
candidates. A (salted) row_number then ranks the candidates per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum import config
from vellum.functions import vectors as V
from vellum.operators.packed import counted, kind_of, opened, packed
from vellum.operators.topk import top_k_per_group
from vellum.session import bounded_batches, cut_lineage

DEFAULT_MAX_BROADCAST_BYTES = 64 << 20
ROUND = 6


def centroid_queries(df: DataFrame, group: str = "label", vec: str = "embedding",
                     out_key: str = "query_id") -> DataFrame:
    """Unit-length mean vector per group, as a query table ``(out_key, embedding)``.

    Vectors are exploded to ``(group, pos, x)`` and averaged; partial aggregation runs
    before the shuffle, so only groups x width x tasks partial sums move.
    """
    per_dim = (df.select(group, F.posexplode(vec).alias("_pos", "_x"))
               .groupBy(group, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_m")))
    vecs = per_dim.groupBy(group).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_v"))
    return vecs.select(F.col(group).alias(out_key),
                       V.l2_normalize(F.transform("_v", lambda s: s["_m"])).alias("embedding"))


def _best(frames: list[pd.DataFrame], k: int, qkey: str, ikey: str) -> pd.DataFrame:
    best = pd.concat(frames, ignore_index=True)
    return (best.sort_values([qkey, "score", ikey], ascending=[True, False, True], kind="stable")
            .groupby(qkey, sort=False).head(k))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list<float> Arrow column as a float64 matrix; NULL rows become zero rows. A vector of
    another width raises: it was made by another model."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    lens = pc.fill_null(pc.list_value_length(col), width).to_numpy(zero_copy_only=False)
    if (lens != width).any():
        raise ValueError(f"vectors must have {width} entries, found one with {int(lens[lens != width][0])}")
    m = np.zeros((len(col), width), dtype=np.float64)
    m[col.is_valid().to_numpy(zero_copy_only=False)] = pc.list_flatten(col).to_numpy(zero_copy_only=False).reshape(-1, width)
    return m


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay zero."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


class Contest:
    """Index rows that may be among the ``k`` best of a block of queries, slice by slice: memory is that of the queries
    and one slice of ``ROWS`` rows by ``COLUMNS`` queries, however many there are of either.

    A product of unit vectors in single precision names the pairs worth an exact score: those over the threshold and
    not beaten by ``k`` rows seen before. Its error (some 1e-6 at these widths) is far below ``MARGIN``; scores
    themselves are in double.

    A query whose entries are small multiples of one number (counts of words, ``WORDS`` in all at most) needs no product. The index's
    columns, rounded to bytes, are added up as often as each word occurs, ``BYTES`` of them before the sum needs 16 bits, for ``GROUP``
    queries at a time; where the sum and all that rounding may have taken reach the query's floor, the columns themselves are added.
    No pair is lost."""

    ROWS, COLUMNS, EXACT, MARGIN, GROUP, WORDS, BYTES, WHOLE = 512, 1024, 4096, 1e-4, 256, 64, 2, 1e-4

    def __init__(self, queries: np.ndarray, k: int, threshold: float, mode: str) -> None:
        self.k, self.threshold, self.mode, (self.n, self.width) = k, threshold, mode, queries.shape
        self.qn = np.zeros(self.n)
        cosine = 2 * threshold - 1 if mode == "unit" else threshold
        self.floor = np.full(self.n, cosine - self.MARGIN, np.float32)
        parts = []
        for at in range(0, self.n, self.ROWS):
            part = queries[at:at + self.ROWS].astype(np.float64, copy=False)
            self.qn[at:at + self.ROWS] = np.linalg.norm(part, axis=1)
            parts.append((at, *self._counts(part, self.qn[at:at + self.ROWS])))
        few = np.zeros(self.n, bool)
        for at, query, *_ in parts:
            few[at + query] = True
        self.dense = np.flatnonzero(~few)
        self.q = queries[self.dense]
        self.unit = np.concatenate([unit_rows(self.q[at:at + self.ROWS].astype(np.float64, copy=False)).astype(np.float32)
                                    for at in range(0, len(self.q), self.ROWS)] or [np.zeros((0, self.width), np.float32)])
        self.groups: list[tuple] = []
        if few.any():
            self._group(np.flatnonzero(few), *(np.concatenate([x[c] for x in parts]) for c in range(2, 8)))

    def _counts(self, part: np.ndarray, norm: np.ndarray):
        """Of the queries that are counts: (query, its unit, error of that, entries), and (column, times, value) of the entries."""
        row, column = np.nonzero(part)
        value = part[row, column]
        few = np.bincount(row, minlength=len(part)) <= self.WORDS
        few &= np.isfinite(norm) & (norm > 0)
        few[row[value < 0]] = False
        for last in (False, True):
            kept = few[row]
            row, column, value = row[kept], column[kept], value[kept]
            query, first, entries = np.unique(row, return_index=True, return_counts=True)
            unit = np.minimum.reduceat(value, first) if len(query) else value
            times = value / np.repeat(unit, entries)
            off = times - np.rint(times)
            if not last and len(query):
                few[query[(np.maximum.reduceat(np.abs(off), first) > self.WHOLE) | (np.add.reduceat(np.rint(times), first) > self.WORDS)]] = False
        unit = unit / norm[query]
        error = unit * np.sqrt(np.add.reduceat(off * off, first)) if len(query) else unit
        return query, unit, error, entries, column, np.rint(times).astype(np.int64), value

    def _group(self, query, unit, error, entries, column, times, value) -> None:
        """``groups`` of queries with about as many words, and the ``scale`` of the columns: no sum of ``BYTES`` of them leaves a byte. A
        group: (number of its first query in ``counted``, queries, unit, error, number of words, words in lots of ``BYTES``, the places
        where their columns start in slices of ``ROWS``); words are column numbers, one for each time, filled up with the number of a
        column of zeros. A word that occurs again is in another lot, if there is one."""
        first = np.cumsum(entries) - entries
        length = np.add.reduceat(times, first)
        order = np.argsort(length, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owner = np.repeat(np.arange(len(query)), entries)
        at = place[owner], np.arange(len(owner)) - first[owner]
        self.columns, self.values = np.zeros((len(query), entries.max()), np.int16 if self.width < 32768 else np.int64), np.zeros((len(query), entries.max()))
        self.columns[at], self.values[at] = column, value
        begin = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(query)), length)
        words = np.full((len(query), self.WORDS), self.width, np.intp)
        words[place[owner], np.arange(len(owner)) - begin[owner]] = np.repeat(column, times)
        query, unit, error, length = query[order], unit[order], error[order], length[order]
        self.counted, longest = query, 1.0
        for at in range(0, len(query), self.GROUP):
            own = slice(at, at + self.GROUP)
            lots = -(-int(length[own][-1]) // self.BYTES)
            lot = np.ascontiguousarray(words[own, :lots * self.BYTES].T).reshape(self.BYTES, lots, -1).transpose(1, 0, 2)
            same = sum((lot[:, [i]] == lot).sum(axis=1, where=lot < self.width) * (lot[:, i] < self.width) for i in range(self.BYTES))
            longest = max(longest, float(same.max()) ** 0.5)  # of a lot, as a vector of counts
            self.groups.append((at, query[own], unit[own], error[own], length[own], lot, lot.transpose(1, 0, 2).reshape(lots * self.BYTES, -1) * self.ROWS))
        # a sum of products is at most the product of the lengths, and a row's length is 1
        self.scale = (254 - self.BYTES / 2) / longest

    def settle(self, query: np.ndarray, score: np.ndarray) -> None:
        """From now on rows count that reach ``score``, the score of the query's ``k``-th of those seen."""
        cosine = 2 * score - 1 if self.mode == "unit" else score
        self.floor[query] = np.maximum(self.floor[query], (cosine - self.MARGIN).astype(np.float32))

    def _scored(self, row, query, dot, size):
        s = np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
        s = np.round((1.0 + s) / 2.0 if self.mode == "unit" else s, ROUND)
        kept = s >= self.threshold
        return row[kept], query[kept], s[kept]

    def _near(self, u: np.ndarray):
        """(row, place in ``dense``) of pairs that the product lets pass."""
        for left in range(0, len(self.dense), self.COLUMNS):
            query = self.dense[left:left + self.COLUMNS]
            near = u @ self.unit[left:left + self.COLUMNS].T
            own = self.floor[query]
            crowded = np.flatnonzero((near >= own).sum(axis=0) > self.k)
            if len(crowded):
                kth = np.partition(near[:, crowded], len(u) - self.k, axis=0)[len(u) - self.k]
                own[crowded] = np.maximum(own[crowded], kth - 2 * self.MARGIN)
                self.floor[query] = own
            r, c = np.nonzero(near >= own)
            yield r, left + c

    def _summed(self, u: np.ndarray):
        """(row, place in ``counted``) of pairs that the sums let pass."""
        n, scale = len(u), self.scale
        exact = np.zeros((self.width + 1, self.ROWS), np.float32)
        exact[:-1, :n] = u.T
        table = np.rint(np.maximum(exact[:, :n], 0) * np.float32(scale)).astype(np.uint8)
        exact = exact.ravel()
        rising = u.min() >= 0  # else the sums may be too high, but never too low
        room = np.empty((2, self.GROUP, n), np.uint8)
        for group in self.groups:
            at, query, unit, error, length, lots, starts = group
            total, (few, more) = np.zeros((len(query), n), np.int16), room[:, :len(query)]
            for lot in lots:
                table.take(lot[0], axis=0, out=few, mode="clip")
                for word in lot[1:]:
                    table.take(word, axis=0, out=more, mode="clip")
                    few += more
                total += few
            lost = unit * length * 0.5 / scale + error
            least = lambda lost=lost, unit=unit, query=query: np.clip(np.floor((self.floor[query] - lost) * scale / unit), -1, 32767).astype(np.int16)
            hit = np.flatnonzero(total >= least()[:, None])
            if rising and len(hit) > self.k:
                crowded = np.flatnonzero(np.bincount(hit // n, minlength=len(query)) > max(self.k, n // 16))
                if len(crowded):
                    kth = np.partition(total[crowded], n - self.k, axis=1)[:, n - self.k] * unit[crowded] / scale - lost[crowded]
                    self.floor[query[crowded]] = np.maximum(self.floor[query[crowded]], (kth - self.MARGIN).astype(np.float32))
                    hit = np.flatnonzero(total >= least()[:, None])
            if not len(hit):
                continue
            c, r = np.divmod(hit, n)
            near = np.empty(len(c), np.float32)
            for e in range(0, len(c), self.EXACT):
                cells = starts.take(c[e:e + self.EXACT], axis=1)
                cells += r[e:e + self.EXACT]
                near[e:e + self.EXACT] = exact.take(cells, mode="clip").sum(axis=0)
            near *= unit[c]
            # the single precision of the sum is in the floor's margin
            kept = near >= (self.floor[query] - error)[c]
            r, c, near = r[kept], c[kept], near[kept]
            crowded = np.flatnonzero(np.bincount(c, minlength=len(query)) > self.k) if len(c) > self.k else ()
            if len(crowded):
                order = np.lexsort((-near, c))
                kth = near[order[np.searchsorted(c[order], crowded) + self.k - 1]] - error[crowded]
                self.floor[query[crowded]] = np.maximum(self.floor[query[crowded]], (kth - self.MARGIN).astype(np.float32))
                kept = near >= (self.floor[query] - error)[c]
                r, c = r[kept], c[kept]
            yield r, at + c

    def enter(self, m: np.ndarray, norms: np.ndarray | None = None):
        """(row of ``m``, query, score) of the pairs that pass; rows that tie with a query's k-th stay. ``norms`` as
        :func:`lengths` has them."""
        norms = lengths(m) if norms is None else norms
        for at in range(0, len(m), self.ROWS):
            part, mn = m[at:at + self.ROWS], norms[at:at + self.ROWS]
            live = np.flatnonzero((mn > 0) & np.isfinite(mn))
            if not len(live):
                continue
            u = (part[live] / mn[live, None]).astype(np.float32)
            for r, c in self._near(u):
                for e in range(0, len(r), self.EXACT):
                    row, own = live[r[e:e + self.EXACT]], c[e:e + self.EXACT]
                    dot = np.einsum("ij,ij->i", part[row].astype(np.float64, copy=False), self.q[own].astype(np.float64, copy=False), dtype=np.float64)
                    query = self.dense[own]
                    row, query, s = self._scored(row, query, dot, mn[row] * self.qn[query])
                    yield at + row, query, s
            found: list[tuple] = []
            for pair in self._summed(u) if self.groups else ():
                found.append(pair)
                if sum(len(r) for r, _ in found) > 4 * self.EXACT:
                    yield from self._exact(at, part, mn, live, found)
                    found = []
            yield from self._exact(at, part, mn, live, found)

    def _exact(self, at: int, part: np.ndarray, mn: np.ndarray, live: np.ndarray, found: list[tuple]):
        if not found:
            return
        r, c = (np.concatenate(x) for x in zip(*found, strict=True))
        for e in range(0, len(r), self.EXACT):
            row, own = live[r[e:e + self.EXACT]], c[e:e + self.EXACT]
            dot = np.einsum("ij,ij->i", part[row[:, None], self.columns[own]].astype(np.float64, copy=False), self.values[own])
            query = self.counted[own]
            row, query, s = self._scored(row, query, dot, mn[row] * self.qn[query])
            yield at + row, query, s


def lengths(m: np.ndarray) -> np.ndarray:
    """The rows' lengths, in double, a slice at a time."""
    return np.concatenate([np.linalg.norm(m[at:at + Contest.ROWS].astype(np.float64, copy=False), axis=1)
                           for at in range(0, len(m), Contest.ROWS)] or [np.zeros(0)])


def _scorer(qids, qmat_bc, k: int, threshold: float, mode: str, ikey: str, ivec: str,
            qkey: str, prune_rows: int = 20_000):
    def run(batches):
        contest = Contest(qmat_bc.value, k, threshold, mode)
        most = max(prune_rows, 2 * k * contest.n)
        kept: list[pd.DataFrame] = []
        n_kept = 0
        for whole in batches:
            for at in range(0, whole.num_rows, Contest.ROWS):
                rb = whole.slice(at, Contest.ROWS)
                ids = rb.column(ikey).to_numpy(zero_copy_only=False)
                for r, c, s in contest.enter(_matrix(rb.column(ivec), contest.width)):
                    kept.append(pd.DataFrame({qkey: c, ikey: ids[r], "score": s}))
                    n_kept += r.size
                    if n_kept > most:
                        kept = [_best(kept, k, qkey, ikey)]
                        n_kept = len(kept[0])
                        last = kept[0][kept[0].groupby(qkey, sort=False).cumcount() == k - 1]
                        contest.settle(last[qkey].to_numpy(), last["score"].to_numpy())
        if n_kept:
            best = _best(kept, k, qkey, ikey)
            best[qkey] = qids[best[qkey].to_numpy()]
            yield pa.RecordBatch.from_pandas(best, preserve_index=False)

    return run


def topk_similarity(index: DataFrame, queries: DataFrame, k: int = config.TOP_K,
                    threshold: float = config.SIMILARITY_THRESHOLD, mode: str = "cosine",
                    index_key: str = "id", index_vec: str = "embedding",
                    query_key: str = "query_id", query_vec: str = "embedding",
                    max_broadcast_bytes: int = DEFAULT_MAX_BROADCAST_BYTES,
                    width: int | None = None) -> DataFrame:
    """``(query_id, id, rank, score)``: per query the ``k`` best index rows with
    ``score >= threshold``, by score descending then id. Scores are rounded to 6 places.

    Every vector must have ``width`` entries (by default the queries' width); others raise. Index rows
    without a vector are no hits. A query side of up to ``max_broadcast_bytes`` is broadcast to the index; a
    larger one is joined tile by tile (:func:`vellum.operators.tiles.topk_join`), with the same result."""
    spark = index.sparkSession
    bounded_batches(spark)
    idx = index.select(index_key, index_vec)
    key_t = idx.schema[index_key].dataType.simpleString()
    qkey_t = queries.schema[query_key].dataType.simpleString()
    schema = f"{query_key} {qkey_t}, {index_key} {key_t}, score double"
    # The query table is read by the count and by the search; a reliable checkpoint computes it
    # (embedding included) once instead of once per read.
    kind = kind_of(queries, query_vec)
    rows = cut_lineage(packed(queries, query_key, query_vec))
    n, own = counted(rows)
    width = width or own
    if not n:
        return spark.createDataFrame([], schema + ", rank int").select(query_key, index_key, "rank", "score")
    if n * (width * 8 + 64) > max_broadcast_bytes:
        from vellum.operators.tiles import topk_join
        return topk_join(idx, queries, k, threshold, mode, index_key, index_vec, query_key, query_vec, width, rows)
    asked = [x for b in rows.toArrow().to_batches() for x in opened(b, kind, width)]
    bc = spark.sparkContext.broadcast(np.concatenate([m for _, m in asked]).astype(np.float64, copy=False))
    qids = pa.concat_arrays([ids for ids, _ in asked]).to_numpy(zero_copy_only=False)
    cands = idx.mapInArrow(_scorer(qids, bc, k, threshold, mode, index_key, index_vec, query_key), schema)
    # Candidates per query = k per index partition. Salt the final ranking in proportion
    # to the cluster's parallelism (not the index's partition count: asking a planned
    # frame for that would run it).
    salt = max(1, spark.sparkContext.defaultParallelism // 64)
    ranked = top_k_per_group(cands, [query_key], [F.desc("score"), F.asc(index_key)], k,
                             salt_on=index_key, salt_buckets=salt)
    return ranked.select(query_key, index_key, F.col("rank").cast("int"), "score")


_PRIME, _STEP = 2147483647, 48271


def planes(tables: int, bits: int, width: int) -> np.ndarray:
    """The +1/-1 normals of ``tables * bits`` hyperplanes (rows: width), from a rule that any engine can
    repeat: three steps of a multiplicative generator seeded by plane and position."""
    p, i = np.arange(tables * bits, dtype=np.int64)[None, :], np.arange(width, dtype=np.int64)[:, None]
    h = (i * 7919 + p * 104729 + 1) % _PRIME * _STEP % _PRIME
    h = (h * _STEP + p) % _PRIME
    h = (h * _STEP + i) % _PRIME
    return np.where(h % 2 == 1, 1.0, -1.0)


def _signatures(df: DataFrame, key: str, vec: str, width: int, tables: int, bits: int, out: str) -> DataFrame:
    """``(out, table, bucket)``: a row per table; the bucket holds the signs of the vector's products with
    the table's planes. Zero and NULL vectors have none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        normals, weight = planes(tables, bits, width), 1 << np.arange(bits)
        for batch in batches:
            m = _matrix(batch.column(1), width)
            live = np.flatnonzero(m.any(axis=1))
            sign = (m[live] @ normals > 0).reshape(len(live), tables, bits)
            keys = batch.column(0).take(pa.array(np.repeat(live, tables)))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(np.tile(np.arange(tables, dtype=np.int32), len(live))),
                 pa.array((sign @ weight).reshape(-1).astype(np.int32))], names=[out, "table", "bucket"])

    return df.select(key, vec).mapInArrow(run, f"{out} {kind}, table int, bucket int")


def topk_similarity_lsh(index: DataFrame, queries: DataFrame, k: int = config.TOP_K,
                        threshold: float = config.SIMILARITY_THRESHOLD, mode: str = "cosine",
                        index_key: str = "id", index_vec: str = "embedding",
                        query_key: str = "query_id", query_vec: str = "embedding",
                        tables: int = 32, bits: int = 6, width: int | None = None) -> DataFrame:
    """Approximate candidates from random hyperplanes, then exact scores and the same ranking.

    Rows meet where all ``bits`` signs of one of the ``tables`` agree: an equi-join on (table, bucket) that
    carries ids only. Vectors are fetched once per candidate pair, after ``distinct``. More bits give
    fewer candidates, more tables more recall; at the defaults a pair of cosine 0.35 is met with
    probability 0.9, of cosine 0.5 with 0.99."""
    width = width or _width(queries, query_vec)
    pairs = lsh_candidates(index, queries, index_key, index_vec, query_key, query_vec, tables, bits, width)
    a = index.select(F.col(index_key).alias("_iid"), F.col(index_vec).alias("_iv"))
    b = queries.select(F.col(query_key).alias("_qid"), F.col(query_vec).alias("_qv"))
    scored = (pairs.join(b, "_qid").join(a, "_iid").select(
        F.col("_iid").alias(index_key), F.col("_qid").alias(query_key),
        F.round(V.relevance(V.cosine(F.col("_iv"), F.col("_qv")), mode), ROUND).alias("score"))
        .where(F.col("score") >= threshold))
    ranked = top_k_per_group(scored, [query_key], [F.desc("score"), F.asc(index_key)], k)
    return ranked.select(query_key, index_key, F.col("rank").cast("int"), "score")


def lsh_candidates(index: DataFrame, queries: DataFrame, index_key: str, index_vec: str, query_key: str,
                   query_vec: str, tables: int, bits: int, width: int) -> DataFrame:
    """``(_iid, _qid)``: the distinct pairs that share a bucket."""
    a = _signatures(index, index_key, index_vec, width, tables, bits, "_iid")
    b = _signatures(queries, query_key, query_vec, width, tables, bits, "_qid")
    return a.join(b, ["table", "bucket"]).select("_iid", "_qid").distinct()


def _width(queries: DataFrame, vec: str) -> int:
    """The width all vectors must have: the queries' (1 for an empty table)."""
    return int(queries.agg(F.max(F.size(vec))).first()[0] or 1)


def mean_score(score: str = "score"):
    """Mean of 6-decimal scores computed on exact integer micro-units, so the result does
    not depend on summation order (a plain double mean of ten such scores lands on a
    rounding tie at the 6th decimal surprisingly often)."""
    micro = F.sum(F.round(F.col(score) * 1e6).cast("long"))
    return micro / F.count(score) / F.lit(1e6)


def retrieval_confidence(hits: DataFrame, queries: DataFrame,
                         query_key: str = "query_id") -> DataFrame:
    """D3: ``(query_id, confidence)`` = mean hit score, 0.0 for a query without hits."""
    agg = hits.groupBy(query_key).agg(mean_score("score").alias("_c"))
    return (queries.select(query_key).join(agg, query_key, "left")
            .select(query_key, F.coalesce("_c", F.lit(0.0)).alias("confidence")))


def context_assembly(hits: DataFrame, docs: DataFrame, queries: DataFrame,
                     query_key: str = "query_id", hit_key: str = "id", doc_key: str = "id",
                     source: str = "source", text: str = "text",
                     with_confidence: bool = False, hits_from_docs: bool = False) -> DataFrame:
    """D4-D6 (+D3): per query the sorted distinct sources (NULL source -> ``Unknown``), their
    number, and the hit texts in rank order joined by the separator line; no hit ->
    ``No relevant documents found.``

    ``hits`` holds at most k rows per query, so the join to the document texts sees a tiny
    build side (AQE turns it into a broadcast at run time)."""
    d = docs.select(F.col(doc_key).alias("_did"), F.col(source).alias("_src"),
                    F.col(text).alias("_txt"))
    if hits_from_docs:
        # The hits were scored from ``docs`` itself, so every hit finds its row: one inner
        # join, which AQE turns into a broadcast of the (k per query) hits.
        h = d.join(hits, d["_did"] == hits[hit_key], "inner")
    else:
        # Two joins, neither with the document table as the build side: (1) the documents
        # of the hit ids -- an inner join, so AQE can broadcast the ids and stream the
        # documents; (2) hits LEFT JOIN those few rows, so a hit whose document is missing
        # keeps the defaults. The hits feed both joins, so they are materialised once (a
        # reliable checkpoint of k rows per query) instead of scoring the index twice.
        hits = cut_lineage(hits)
        ids = hits.select(F.col(hit_key).alias("_did")).distinct()
        found = d.join(ids, "_did", "inner")
        h = hits.join(found, hits[hit_key] == found["_did"], "left")
    agg = h.groupBy(query_key).agg(
        F.array_sort(F.collect_set(F.coalesce("_src", F.lit(config.UNKNOWN_SOURCE))))
        .alias("_sources"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("rank", F.coalesce("_txt", F.lit("")).alias("t")))), lambda x: x["t"]),
            config.CONTEXT_SEPARATOR).alias("_ctx"),
        mean_score("score").alias("_conf"))
    out = queries.select(query_key).join(agg, query_key, "left").select(
        query_key,
        F.coalesce("_sources", F.array().cast("array<string>")).alias("sources"),
        F.when(F.col("_sources").isNull(), F.lit(0)).otherwise(F.size("_sources"))
        .alias("num_sources"),
        F.coalesce("_ctx", F.lit(config.NO_CONTEXT)).alias("context"),
        F.coalesce("_conf", F.lit(0.0)).alias("confidence"))
    return out if with_confidence else out.drop("confidence")

"""Exact top-k join of two growing sides (J4, J7): queries and index on a grid of tiles.

Both sides are cut into blocks of bounded bytes: rows go to the nearest of a bounded number of sampled directions,
and a crowded direction is split by hash. A block knows its ball, the mean direction and the largest angle to it. A
tile is a pair of blocks; by the triangle inequality on angles no pair of rows in a tile is closer than the balls allow, so tiles
that cannot reach the threshold are dropped before any vector moves. Index blocks of near directions lie on shelves of
bounded bytes, and a query block travels once to every shelf it has a tile on. Vectors travel and lie on shelves compressed
(:mod:`vellum.operators.packed`). Rows sorted by shelf bring the shelf's blocks first and then the query blocks, those with the same
tiles one after the other: a task holds one shelf, query blocks of bounded size that are scored together, and one index block
that is opened for them. Sums and products of bounded size
score them, and at most ``k`` rows a query leave the shelf. A ranking merges them. Neither side nor any block passes through
the driver; it sees two row counts and the sampled directions.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum import config
from vellum.operators.packed import counted, kind_of, one_row, opened, packed, squeeze, unsqueeze
from vellum.operators.search import Contest, lengths, unit_rows
from vellum.operators.topk import top_k_per_group
from vellum.session import bounded_batches, cut_lineage, drop_saved

#: Bytes of a block's vectors (in double), of a shelf's (as they lie there), of the queries' that are scored together (as opened), sampled directions at
#: most, rows a direction should have, and balls of the index that a task holds.
TILE_BYTES, SHELF_BYTES, ASKED_BYTES, DIRECTIONS, DIRECTION_ROWS, BALLS = 8 << 20, 48 << 20, 32 << 20, 256, 2048, 512


def _thinned(batches):
    """Every 64th of the packed rows of a batch."""
    for batch in batches:
        yield batch.take(pa.array(np.arange(0, batch.num_rows, 64)))


def _cell_of(m: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.argmax(unit_rows(m.astype(np.float64, copy=False)).astype(np.float32) @ directions.astype(np.float32).T, axis=1).astype(np.int32)


def _sizes(width: int, directions: np.ndarray, kind: str, batches):
    """(cell, n): how many rows have which nearest direction."""
    for batch in batches:
        for _, m in opened(batch, kind, width):
            cell, n = np.unique(_cell_of(m, directions), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])


def _cells(width: int, directions: np.ndarray, kind: str, most: int, batches):
    """(cell, ids, vecs): rows of the same nearest direction, ``most`` at a time."""
    for batch in batches:
        for ids, m in opened(batch, kind, width):
            cell = _cell_of(m, directions)
            order = np.argsort(cell, kind="stable")
            edges = np.flatnonzero(np.diff(cell[order], prepend=-1))
            edges = [(at, min(at + most, b)) for a, b in zip(edges, [*edges[1:], len(order)], strict=True) for at in range(a, b, most)]
            ids, m = ids.take(pa.array(order)), m[order]
            bounds = pa.array([a for a, _ in edges] + [len(order)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(cell[order][[a for a, _ in edges]]), pa.ListArray.from_arrays(bounds, ids),
                                              pa.array([squeeze(m[a:b]) for a, b in edges], pa.binary())], names=["cell", "ids", "vecs"])


def _ball(m: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean direction and the largest angle to it; a zero row is any direction."""
    u = unit_rows(m.astype(np.float64, copy=False))
    c = unit_rows(u.sum(axis=0, keepdims=True))[0]
    any_way = not c.any() or not u.any(axis=1).all()
    return c, np.pi if any_way else float(np.arccos(np.clip((u @ c).min(), -1, 1)))


def _blocked(width: int, kind: str, most: int, batches):
    """Parts (cell, piece, ids, vecs) sorted by cell and piece as blocks (block, ids, vecs, centre, radius) of ``most`` rows at most,
    one at a time."""
    own, key, part, size = [], None, 0, 0

    def block():
        m = np.concatenate([unsqueeze(v, kind, len(i) * width) for i, v in own]).reshape(-1, width)
        c, radius = _ball(m)
        name = pa.StructArray.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([part], pa.int32())], names=["cell", "piece", "part"])
        return pa.RecordBatch.from_arrays(
            [name, one_row(pa.concat_arrays([i for i, _ in own])), pa.array([squeeze(m)], pa.binary()),
             pa.array([c.tolist()], pa.list_(pa.float64())), pa.array([radius], pa.float64())], names=["block", "ids", "vecs", "centre", "radius"])

    for batch in batches:
        cell, piece = (batch.column(k).to_numpy() for k in (0, 1))
        for row in range(batch.num_rows):
            now, ids = (int(cell[row]), int(piece[row])), batch.column(2).slice(row, 1).flatten()
            if own and (now != key or size + len(ids) > most):
                yield block()
                own, size, part = [], 0, part + 1
            if now != key:
                key, part = now, 0
            # copied: a part outlives the batch it came in
            own.append((pa.concat_arrays([ids]), batch.column(3)[row].as_py()))
            size += len(ids)
    if own:
        yield block()


def _blocks(rows: DataFrame, name: str, kind: str, width: int, directions: np.ndarray, block_rows: int) -> DataFrame:
    # DIRECTIONS at most are left
    sizes = rows.mapInArrow(partial(_sizes, width, directions, kind), "cell int, n bigint")
    pieces = sizes.groupBy("cell").agg(F.ceil(F.sum("n") / block_rows).cast("int").alias("pieces"))
    placed = rows.mapInArrow(partial(_cells, width, directions, kind, max(1, block_rows // 32)), f"cell int, ids array<{name}>, vecs binary")
    dealt = placed.join(F.broadcast(pieces), "cell").select("cell", F.pmod(F.xxhash64("ids", "vecs"), F.col("pieces")).cast("bigint").alias("piece"), "ids", "vecs")
    # small parts move and are packed as they arrive: no task gathers several blocks
    sorted_rows = dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece")
    return cut_lineage(sorted_rows.mapInArrow(
        partial(_blocked, width, kind, 2 * block_rows),
        f"block struct<cell:int,piece:bigint,part:int>, ids array<{name}>, vecs binary, centre array<double>, radius double"))


def blocks(df: DataFrame, key: str, vec: str, width: int, directions: np.ndarray, rows: int, block_rows: int) -> DataFrame:
    """``(block, ids, vecs, centre, radius)``: ``df`` in blocks of about ``block_rows`` rows of near directions, the vectors
    compressed. Saved in the shared folder, since it is read for its balls and for its vectors."""
    return _blocks(packed(df, key, vec), df.schema[key].dataType.simpleString(), kind_of(df, vec), width, directions, block_rows)


def _meeting(threshold: float, batches):
    """Balls (at, asking, block, centre, radius) sorted by lot, a lot's index balls first: the pairs (left, right) that are near enough."""
    lot, names, centres, radii = None, [], [], []
    for batch in batches:
        at, asking = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        edges = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(asking.astype(np.int8)) != 0)) + 1), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if at[a] != lot:
                lot, names, centres, radii = at[a], [], [], []
            own = pa.concat_arrays([batch.column(2).slice(a, b - a)])
            c = pc.list_flatten(batch.column(3).slice(a, b - a)).to_numpy().reshape(b - a, -1)
            r = batch.column(4).slice(a, b - a).to_numpy()
            if not asking[a]:
                names.append(own)
                centres.append(c.copy())
                radii.append(r.copy())
                continue
            if not names:
                continue
            angle = np.arccos(np.clip(c @ np.concatenate(centres).T, -1, 1))
            closest = np.cos(np.maximum(0, angle - r[:, None] - np.concatenate(radii)))
            # scores are rounded, and angles have their own error
            x, y = np.nonzero(closest >= threshold - 1e-5)
            yield pa.RecordBatch.from_arrays([own.take(pa.array(x)), pa.concat_arrays(names).take(pa.array(y))], names=["left", "right"])


def tiles(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(left, right)``: the pairs of blocks whose balls may hold a pair of cosine ``threshold`` or more. Works on the balls alone:
    the right ones are dealt to lots of about ``BALLS``, and the left ones visit all lots."""
    lots = max(1, -(-right.count() // BALLS))
    ball = lambda df, at, asking: df.select(at.alias("at"), F.lit(asking).alias("asking"), "block", "centre", "radius")
    rows = ball(right, F.pmod(F.xxhash64("block"), F.lit(lots).cast("bigint")), False).unionByName(
        ball(left, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lots - 1).cast("bigint"))), True))
    kind = right.schema["block"].dataType.simpleString()
    return rows.repartition(lots, "at").sortWithinPartitions("at", "asking").mapInArrow(partial(_meeting, threshold), f"left {kind}, right {kind}")


def shelves(blocks: DataFrame, rows: int) -> DataFrame:
    """``(block, shelf)``: blocks in the order of their directions, about ``rows`` rows to a shelf. Numbers keys alone, a row
    per block of some MB."""
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("block", F.size("ids").cast("bigint").alias("n"))
    return sizes.select("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / rows).cast("bigint").alias("shelf"))


def _homes(spark, shelves: int) -> DataFrame:
    """``(shelf, home)``: keys that a shuffle of as many partitions deals to one partition each."""
    keys = spark.range(0, 32 * shelves, 1, 1)
    return keys.groupBy(F.pmod(F.hash("id"), F.lit(shelves)).cast("bigint").alias("shelf")).agg(F.min("id").alias("home"))


class _Shelf:
    """The index blocks of a shelf, compressed, and query blocks that are scored against the same of them together."""

    def __init__(self, width: int, k: int, threshold: float, mode: str, index_kind: str, query_kind: str) -> None:
        self.width, self.k, self.threshold, self.mode, self.kinds = width, k, threshold, mode, (index_kind, query_kind)
        self.clear()

    def clear(self) -> None:
        self.ids, self.at, self.packed, self.norms, self.rows, self.order = [], {}, {}, {}, 0, None
        self.meets, self.asked, self.waiting = None, [], 0

    def lay(self, name: tuple, ids: pa.Array, vecs: bytes) -> None:
        self.ids.append(ids)
        self.at[name], self.packed[name] = self.rows, (len(ids), vecs)
        self.rows += len(ids)

    def _best(self, contest: Contest, found: list) -> list:
        """Each query's ``k`` best of the rows found, ties by id; they are what others have to beat."""
        query, row, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.order[row], -s, query))
        query, row, s = query[order], row[order], s[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        contest.settle(query[last], s[last])
        kept = place < self.k
        return [(query[kept], row[kept], s[kept])]

    def ask(self, meets: list, qids: pa.Array, vecs: bytes):
        if meets != self.meets or (self.waiting + len(qids)) * self.width * np.dtype(self.kinds[1]).itemsize > ASKED_BYTES:
            yield from self.answer()
        self.meets = meets
        self.asked.append((qids, vecs))
        self.waiting += len(qids)

    def answer(self):
        """(query, id, score) of the queries that wait."""
        if not self.asked:
            return
        if self.order is None:
            self.ids = pa.concat_arrays(self.ids)
            self.order = np.empty(self.rows, np.int64)
            self.order[pc.array_sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(self.rows)
        qids = pa.concat_arrays([i for i, _ in self.asked])
        asked = np.empty((len(qids), self.width), self.kinds[1])
        at = 0
        for own, vecs in self.asked:
            asked[at:at + len(own)] = unsqueeze(vecs, self.kinds[1], len(own) * self.width).reshape(-1, self.width)
            at += len(own)
        contest = Contest(asked, self.k, self.threshold, self.mode)
        del asked
        found, size, best = [], 0, 0
        for name in self.meets:
            n, vecs = self.packed[name]
            m = unsqueeze(vecs, self.kinds[0], n * self.width).reshape(n, self.width)
            if name not in self.norms:
                self.norms[name] = lengths(m)
            for r, c, s in contest.enter(m, self.norms[name]):
                found.append((c, self.at[name] + r, s))
                size += len(s)
                if size > best + max(20_000, 4 * len(qids)):
                    found = self._best(contest, found)
                    size = best = len(found[0][0])
        self.meets, self.asked, self.waiting = None, [], 0
        if size:
            query, row, s = self._best(contest, found)[0]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(query)), self.ids.take(pa.array(row)), pa.array(s)], names=["query", "id", "score"])


def _score(width: int, k: int, threshold: float, mode: str, index_kind: str, query_kind: str, batches):
    """Rows by shelf (shelf, block, ids, qids, vecs, meets): its index blocks, then the query blocks with the index blocks that
    they meet: each query's best rows of the shelf."""
    shelf, own = None, _Shelf(width, k, threshold, mode, index_kind, query_kind)
    for batch in batches:
        for t in range(batch.num_rows):
            # copied: a block outlives the batch it came in
            if batch.column(0)[t].as_py() != shelf:
                yield from own.answer()
                own.clear()
                shelf = batch.column(0)[t].as_py()
            if batch.column(2)[t].is_valid:
                own.lay(tuple(batch.column(1)[t].as_py().values()), pa.concat_arrays([batch.column(2).slice(t, 1).flatten()]), batch.column(4)[t].as_py())
                continue
            if not own.rows:
                raise ValueError("a query block came before its index blocks")
            yield from own.ask([tuple(x.values()) for x in batch.column(5)[t].as_py()], pa.concat_arrays([batch.column(3).slice(t, 1).flatten()]),
                               batch.column(4)[t].as_py())
    yield from own.answer()


def topk_join(index: DataFrame, queries: DataFrame, k: int = config.TOP_K, threshold: float = config.SIMILARITY_THRESHOLD, mode: str = "cosine",
              index_key: str = "id", index_vec: str = "embedding", query_key: str = "query_id", query_vec: str = "embedding",
              width: int | None = None, asked: DataFrame | None = None, tile_bytes: int = TILE_BYTES, shelf_bytes: int = SHELF_BYTES) -> DataFrame:
    """``(query_id, id, rank, score)`` as :func:`vellum.operators.search.topk_similarity` gives it, for a query side that grows with
    the data: per query the ``k`` best index rows with ``score >= threshold``, by score descending, then id.

    Every vector must have ``width`` entries (by default the queries' width); others raise. Index rows without a vector
    or with a zero one are no hits; a query without a vector has score 0 to all rows. Query ids that repeat are ranked together.
    ``asked`` are the queries packed and saved, if they are already; their files go."""
    spark = index.sparkSession
    bounded_batches(spark)
    # both sides may be plans (chunking, embedding): computed once
    saved = cut_lineage(packed(index, index_key, index_vec))
    live = saved.where("vec IS NOT NULL")
    asked = cut_lineage(packed(queries, query_key, query_vec)) if asked is None else asked
    (n, _), (m, own) = counted(live), counted(asked)
    names = [df.schema[key].dataType.simpleString() for df, key in ((queries, query_key), (index, index_key))]
    kinds = f"query {names[0]}, id {names[1]}, score double"
    out = lambda df: df.select(F.col("query").alias(query_key), F.col("id").alias(index_key), F.col("rank").cast("int"), "score")
    if not n or not m:
        return out(spark.createDataFrame([], f"{kinds}, rank int"))
    width, index_kind, query_kind = width or own, kind_of(index, index_vec), kind_of(queries, query_vec)
    # at most DIRECTIONS vectors
    want = max(1, min(DIRECTIONS, n // DIRECTION_ROWS))
    sample = live.mapInArrow(_thinned, live.schema).orderBy(F.xxhash64("id"), "id").limit(want).toArrow()
    directions = unit_rows(np.concatenate([x for b in sample.to_batches() for _, x in opened(b, index_kind, width)]).astype(np.float64))
    most = max(1, tile_bytes // (8 * width))
    # enough tiles for all cores on small inputs
    tasks = 2 * spark.sparkContext.defaultParallelism
    a = _blocks(live, names[1], index_kind, width, directions, max(1, min(most, -(-n // tasks))))
    b = _blocks(asked, names[0], query_kind, width, directions, most)
    drop_saved(saved, asked)
    lying = a.agg(F.sum(F.length("vecs"))).first()[0]
    rows = max(1, min(-(-n // tasks), n * shelf_bytes // lying))
    shelf = cut_lineage(shelves(a, rows).join(F.broadcast(_homes(spark, n // rows + 1)), "shelf", "left").select(
        "block", F.coalesce("home", "shelf").alias("shelf")))
    grid = tiles(b, a, 2 * threshold - 1 if mode == "unit" else threshold).join(shelf.withColumnRenamed("block", "right"), "right")
    grid = cut_lineage(grid.groupBy("shelf", "left").agg(F.sort_array(F.collect_list("right")).alias("meets")))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    # a row per index block, of its name and its shelf
    met = shelf.join(grid.select("shelf").distinct(), "shelf", "left_semi")
    lain = a.join(F.broadcast(met), "block").select("shelf", "block", "ids", none(b, "ids").alias("qids"), "vecs", none(grid, "meets").alias("meets"))
    asking = b.withColumnRenamed("block", "left").join(grid, "left").select(
        "shelf", none(a, "block").alias("block"), none(a, "ids").alias("ids"), F.col("ids").alias("qids"), "vecs", "meets")
    met_rows = lain.unionByName(asking).repartition(n // rows + 1, "shelf").sortWithinPartitions("shelf", F.col("ids").isNull(), F.xxhash64("meets"))
    scored = met_rows.mapInArrow(partial(_score, width, k, threshold, mode, index_kind, query_kind), kinds)
    # a task sends k rows a query at most: a query that repeats makes no large group
    hits = cut_lineage(out(top_k_per_group(scored, ["query"], [F.desc("score"), F.asc("id")], k)))
    del met, lain, asking, met_rows, scored
    drop_saved(a, b, shelf, grid)
    return hits

"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the hashes of its distinct word shingles. Documents with the same set
form one class and only classes are joined. Sets are ordered rare first; two sets with
Jaccard similarity t or more share a shingle among their first n - ceil(t n) + 1. So:

1. *Order.* Shingle frequencies are counted over all documents in a fixed number of counters;
   the order is (counter, hash). Any fixed order gives whole results, a rarer start
   gives fewer candidates.
2. *Prefix join.* Prefix shingles that occur once are put aside by a count; the others are the
   inverted index. A bit filter of fixed size spares most of the others the way to the join (at
   a size where its bits are all taken it spares none). A passage gives many lists with the same members; one
   of them is kept, the first in the common order.
3. *Links.* Components are asked for, so not all pairs of a group of copies are built: first
   every class is compared with one of the leaders of its shingles' lists, the one it shares most lists with. A list's
   leaders are the member with the fewest shingles before this one (rarer ones: it has the least of its own, so it stands in
   the middle of a group of copies), in the second round outside the list's largest component, and one drawn by hash. Lists that lie
   inside one component have nothing more to give; in the remaining lists the members outside the largest component are joined with
   all, over pairs of different components.
4. *Filters*, all inside the index join's condition. Length: 100 min(n) >= 80 max(n).
   Positional: the shingles after the two prefix positions must still allow the overlap. Suffix:
   the sets are cut into ``PARTS`` parts at the same hash pivots, of which a class keeps the parities
   (64 bytes); a part whose parities differ holds a shingle of one set only, so the number of such
   parts bounds the sets' difference from below. The pairs left meet a sketch with two to four parts a shingle, which is sharp for
   long sets too, and what passes is verified once per pair on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import SEPARATOR_CHARS, Scratch, bit_array, bit_filter, in_bits, passing, read, slices
from vellum.llm.graph import components
from vellum.llm.hashing import U, mix, prefix, spans, words

COUNTERS = 1 << 16
#: Parts of a set whose parities are kept, and sets whose parts are counted at a time.
PARTS, BLOCK = 512, 512
PARITIES = [f"g{i}" for i in range(PARTS // 64)]
#: Most parts of a sketch: 32 KB for sets of 65,536 shingles or more.
SKETCH = 1 << 18
#: Bits of the filters for prefix shingles (8 MB) and for texts (1 MB).
SHINGLE_BITS, TEXT_BITS = 1 << 26, 1 << 23
#: Rounds of comparisons with leaders.
STAR_ROUNDS = 2
#: Tasks that a class's pairs are dealt to.
SALTS = 4


def shingle_sets(col: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, ascending, and the offsets of the texts' sets. A text
    with fewer than ``k`` words has its whole sequence as one shingle; without words it has none."""
    w = words(col, lower=True)
    total = np.diff(w.first)
    count = np.where(total >= k, total - k + 1, np.minimum(total, 1))
    doc = np.repeat(np.arange(len(total)), count)
    ends = np.cumsum(count)
    start = w.first[doc] + np.arange(len(doc)) - (ends - count)[doc]
    h = spans(prefix(w.hash), start, np.minimum(start + k, w.first[doc + 1]))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(total) + 1))


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An order-free 64-bit key of every set (with the set's size it identifies the class)."""
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(0x2545F4914F6CDD1D)), dtype=U)])
    return mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def counter(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> U(48)).astype(np.int64) & (COUNTERS - 1)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(percent n / 100) + 1; 0 for empty sets."""
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def parities(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Of every set (``n``: sizes, hashes end to end) the parities of its parts, 64 to a number and column."""
    out, ends = [], np.concatenate([[0], np.cumsum(n)])
    for at in range(0, max(1, len(n)), BLOCK):
        own = n[at:at + BLOCK]
        part = h[ends[at]:ends[at + len(own)]] >> U(64 - PARTS.bit_length() + 1)
        cell = np.repeat(np.arange(len(own)), own) * PARTS + part.astype(np.int64)
        odd = (np.bincount(cell, minlength=len(own) * PARTS) & 1).astype(np.uint8)
        out.append(np.packbits(odd, bitorder="little").view(np.int64).reshape(-1, PARTS // 64))
    return list(np.concatenate(out).T)


def sketches(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of every set (``n``: sizes, hashes end to end) the parities of its parts by the hashes' low bits; the number of parts is a
    power of two, twice the size or more (up to ``SKETCH``). Halves of a sketch, one over the other, are a sketch of half the parts."""
    parts = np.where(n > 0, np.minimum(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, SKETCH), 0)
    parts = np.where(n > 0, np.maximum(parts, 64), 0)
    out, ends = [np.zeros(0, np.uint8)], np.concatenate([[0], np.cumsum(n)])
    for at in range(0, len(n), BLOCK):
        own, size = n[at:at + BLOCK], parts[at:at + BLOCK]
        cell = h[ends[at]:ends[at + len(own)]].astype(np.int64) & np.repeat(size - 1, own)
        cell += np.repeat(np.cumsum(size) - size, own)
        out.append(np.packbits((np.bincount(cell, minlength=size.sum()) & 1).astype(np.uint8), bitorder="little"))
    offsets = np.concatenate([[0], np.cumsum(parts // 8)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(out))])


def differing(x: bytes, y: bytes) -> int:
    """Parts whose parities differ in two sketches: at most the sets' difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _plausible(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (a, b, n1, n2, k1, k2) whose sketches allow the similarity, without sizes and sketches."""
    for batch in batches:
        both = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        apart = np.array([differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
        overlap = (both - apart) // 2
        yield batch.select([0, 1]).filter(pa.array(100 * overlap >= percent * (both - overlap)))


def _distinct(part: pa.RecordBatch) -> pa.RecordBatch:
    """One row per text key (column 1), as the copies in a batch have the same set."""
    _, rows = np.unique(part.column(1).to_numpy(), return_index=True)
    return part.take(pa.array(np.sort(rows)))


def _sizes(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (n, class key, text key, parities, sketch), and a task's shingle counters at its end."""
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("n", pa.int64()), ("c", pa.int64()),
                        *((g, pa.int64()) for g in PARITIES), ("sketch", pa.binary()), ("counter", pa.int32()), ("count", pa.int64())])
    seen = np.zeros(COUNTERS, np.int64)

    def rows(size, *values):
        return pa.RecordBatch.from_arrays([pa.nulls(size, f.type) if v is None else v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v), f.type)
                                           for v, f in zip(values, schema, strict=True)], schema=schema)

    for batch in batches:
        for part in slices(batch, "text"):
            h, first = shingle_sets(part.column(2), k)
            np.add(seen, np.bincount(counter(h), minlength=COUNTERS), out=seen)
            n = np.diff(first)
            yield rows(len(n), part.column(0), part.column(1), n, set_keys(h, first), *parities(h, n), sketches(h, n), None, None)
    used = np.flatnonzero(seen)
    if len(used):
        yield rows(len(used), None, None, None, None, *(None for _ in PARITIES), None, used, seen[used])


def _entries(k: int, percent: int, ranks: np.ndarray, bits: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix shingles: (s); with the bit filter of those wanted (s, c, n, pos)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for part in slices(_distinct(batch), "text"):
            h, first = shingle_sets(part.column(2), k)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, ranks[counter(h)], doc))
            place = np.arange(len(h)) - first[doc]
            head = place < prefix_size(n, percent)[doc]
            if bits is not None:
                head &= in_bits(bits, h[order])
            s = h[order][head].view(np.int64)
            if bits is not None:
                c = set_keys(h, first)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(c[doc[head]]), pa.array(n[doc[head]].astype(np.int32)),
                                                  pa.array(place[head].astype(np.int32))], names=["s", "c", "n", "pos"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(s)], names=["s"])


def _whole_sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, n, shingles) of every text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for part in slices(_distinct(batch), "text"):
            h, first = shingle_sets(part.column(2), k)
            yield pa.RecordBatch.from_arrays([
                pa.array(set_keys(h, first)), pa.array(np.diff(first).astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))], names=["c", "n", "shingles"])


def _enough(overlap: Column, percent: int) -> Column:
    """Whether an overlap gives the pair (n1, n2) its similarity, in integers."""
    return 100 * overlap >= percent * (F.col("n1").cast("bigint") + F.col("n2") - overlap)


def _at_most(apart: Column) -> Column:
    """The overlap's bound: |A| + |B| - 2 overlap is the difference, which is at least ``apart``."""
    return F.floor((F.col("n1").cast("bigint") + F.col("n2") - apart) / 2)


def _candidates(left: DataFrame, right: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """Pairs of index entries of one shingle, in different components, that pass all filters; with ``once`` those of two
    members outside the list's largest component in one order."""
    side = lambda d, x, i: d.select(
        "s", F.struct("c", "n").alias(x), F.col("n").alias(f"n{i}"), F.col("pos").alias(f"p{i}"), F.col("root").alias(f"root{i}"),
        *(F.col(g).alias(f"{g}_{i}") for g in PARITIES), *(["weight"] if i == 1 else [F.col("main").alias("main2")]))
    a, b = side(left, "a", 1), side(right, "b", 2)
    length = 100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")
    position = _enough(F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2")).cast("bigint"), percent)
    apart = sum((F.bit_count(F.col(f"{g}_1").bitwiseXOR(F.col(f"{g}_2"))) for g in PARITIES[1:]),
                F.bit_count(F.col(f"{PARITIES[0]}_1").bitwiseXOR(F.col(f"{PARITIES[0]}_2")))).cast("bigint")
    suffix = _enough(_at_most(apart), percent)
    both = F.col("main2") | (F.col("a") < F.col("b")) if once else F.lit(True)
    return a.join(b, (a.s == b.s) & (F.col("root1") != F.col("root2")) & both & length & position & suffix)


class _Verifier:
    """Checks pairs of classes on their sketches, and what passes on their whole sets. ``classes``: (c, n, t, doc_id, sketch), where
    (t, doc_id) is a row with the class's text. Sets are read from the texts, once, for the classes of some pair."""

    def __init__(self, source: DataFrame, classes: DataFrame, k: int, percent: int, scratch: Scratch) -> None:
        self.source, self.classes, self.k, self.percent, self.scratch, self.sets = source, classes, k, percent, scratch, None

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Pairs that their sketches let pass."""
        own = lambda x, i: self.classes.select(F.struct("c", "n").alias(x), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"k{i}"))
        node = "struct<c: bigint, n: int>"
        return (pairs.join(own("a", 1), "a").join(own("b", 2), "b").select("a", "b", "n1", "n2", "k1", "k2")
                .mapInArrow(partial(_plausible, self.percent), f"a {node}, b {node}"))

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        save, node = self.scratch.save, F.struct("c", "n")
        # a class with many partners meets them in several tasks: its set goes to each of its salts
        salts = {"s1": F.pmod(F.xxhash64("b"), F.lit(SALTS)), "s2": F.pmod(F.xxhash64("a"), F.lit(SALTS))}
        pairs = save(self.plausible(pairs).withColumns(salts), f"{name}-salted")
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("x")).select("x.c", "x.n").distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("c", "n"), ["c", "n"], "left_anti")
        rows = save(self.classes.join(wanted, ["c", "n"]).select(F.col("t").alias("t1"), F.col("doc_id").alias("d1")), f"{name}-texts")
        near = passing(self.source, "t", bit_filter(rows, "t1", TEXT_BITS), TEXT_BITS)
        texts = near.join(rows, (F.col("t") == F.col("t1")) & F.col("doc_id").eqNullSafe(F.col("d1"))).select("doc_id", "t", "text")
        new = save(texts.mapInArrow(partial(_whole_sets, self.k), "c bigint, n int, shingles array<bigint>"), f"{name}-sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)

        def with_set(x: str, salt: str, size: str, own: str) -> DataFrame:
            keys = pairs.select(F.col(f"{x}.c").alias("c"), F.col(f"{x}.n").alias("n"), salt).distinct()
            return keys.join(self.sets, ["c", "n"]).select(node.alias(x), salt, F.col("n").alias(size), F.col("shingles").alias(own))

        same = F.size(F.array_intersect("x1", "x2")).cast("bigint")
        found = save(pairs.join(with_set("a", "s1", "n1", "x1"), ["a", "s1"]).join(with_set("b", "s2", "n2", "x2"), ["b", "s2"])
                     .where(_enough(same, self.percent)).select("a", "b").distinct(), name)
        self.scratch.drop(f"{name}-texts", f"{name}-salted")
        return found


def _distinct_lists(index: DataFrame, scratch: Scratch) -> DataFrame:
    """The index with one list (s) of those that have the same members, and their number as ``weight``. Shingles with
    the same members stand in one order in all of them; the first is kept, so that positions still bound the
    overlap of each pair that meets here."""
    node = (F.col("c"), F.col("n"))
    lists = index.groupBy("s").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64(*node)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), *node)).alias("y"),
                                   F.min(F.struct("c", "n", "pos")).alias("m"))
    once = scratch.save(lists.groupBy("members", "x", "y").agg(F.min_by("s", F.col("m.pos")).alias("s"), F.count("*").alias("weight")).select("s", "weight"), "distinct-lists")
    return scratch.save(index.join(once, "s"), "distinct")


def _rooted(index: DataFrame, links: DataFrame | None, classes: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The index (s, c, n, pos) with each class's component (and parities, once ``classes`` is there), without
    lists that lie inside one component. ``main``: whether it is the largest component of the list's (there is none before links)."""
    node = F.struct("c", "n")
    if links is None:
        rooted = index.withColumns({"root": node, "members": F.lit(1).cast("bigint")})
    else:
        roots = components(links, scratch, name)
        sized = roots.join(roots.groupBy("root").agg(F.count("*").alias("members")), "root")
        rooted = (index.withColumn("node", node).join(sized, "node", "left")
                  .withColumns({"root": F.coalesce("root", "node"), "members": F.coalesce("members", F.lit(1))}).drop("node"))
    rooted = scratch.save(rooted, f"{name}-rooted")
    lists = rooted.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.max(F.struct("members", "root")).alias("m"))
    open_lists = scratch.save(lists.where("x != y").select("s", F.col("m.root").alias("largest")), f"{name}-open")
    largest = F.col("root") == F.col("largest") if links is not None else F.lit(False)
    kept = rooted.join(open_lists, "s").withColumn("main", largest).drop("members", "largest")
    if classes is not None:
        kept = kept.join(classes.select("c", "n", *PARITIES), ["c", "n"])
    kept = scratch.save(kept, f"{name}-index")
    scratch.drop(f"{name}-rooted", f"{name}-open")
    return kept


def _grouped(docs: DataFrame, k: int, percent: int, key: str, text: str, scratch: Scratch) -> DataFrame:
    """(doc_id, t, n, root, component_id) for every row; root and component_id null without words. Of the tables written, it reads
    "figures" and "by-class"."""
    raw = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(raw).alias("t"), raw.alias("text"))
    counted = scratch.save(source.mapInArrow(
        partial(_sizes, k), f"doc_id bigint, t bigint, n bigint, c bigint, {', '.join(f'{g} bigint' for g in PARITIES)}, sketch binary, counter int, count bigint"), "sizes")
    sizes = counted.where("counter IS NULL").select("doc_id", "t", F.col("n").cast("int").alias("n"), "c", *PARITIES, "sketch")
    # at most COUNTERS rows, whatever the input
    cells = counted.where("counter IS NOT NULL").groupBy("counter").agg(F.sum("count").alias("count")).toPandas()
    ranks = np.zeros(COUNTERS, np.int64)
    ranks[cells["counter"].to_numpy(int)] = cells["count"].to_numpy(int)

    shingles = source.mapInArrow(partial(_entries, k, percent, ranks, None), "s bigint")
    often = scratch.save(shingles.groupBy("s").count().where("count > 1").select("s"), "repeated")
    wanted = bit_array(bit_filter(often, "s", SHINGLE_BITS), SHINGLE_BITS)
    entries = source.mapInArrow(partial(_entries, k, percent, ranks, wanted), "s bigint, c bigint, n int, pos int")
    found = scratch.save(entries.join(often, "s").distinct(), "found")
    scratch.drop("repeated")
    index = _distinct_lists(_rooted(found, None, None, scratch, "lists"), scratch)
    # a row per class before the join, as a class may have many copies
    each = sizes.groupBy("c", "n").agg(F.min_by(F.struct("t", "doc_id", *PARITIES, "sketch"), F.struct("t", "doc_id")).alias("r"))
    classes = scratch.save(each.join(index.select("c", "n").distinct(), ["c", "n"]).select("c", "n", "r.*"), "candidates")
    index = scratch.save(index.join(classes.select("c", "n", *PARITIES), ["c", "n"]), "index")
    scratch.drop("found", "lists-index", "distinct-lists", "distinct")
    sizes = scratch.save(sizes.drop(*PARITIES, "sketch"), "figures")
    scratch.drop("sizes")
    verifier = _Verifier(source, classes, k, percent, scratch)

    ordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = None
    for turn in range(STAR_ROUNDS):
        # one that stands first, outside the largest component; one drawn, another for every list and round
        drawn_by = F.xxhash64(F.lit(turn), "s", "c")
        leader = lambda *order: F.min_by(F.struct("root", "n", "c", "pos", "main"), F.struct(*order))
        drawn = F.array_distinct(F.array(leader("main", "pos", "n", "c"), leader(drawn_by)))
        leaders = scratch.save(index.groupBy("s").agg(drawn.alias("l")).select("s", F.explode("l").alias("l")).select("s", "l.*")
                               .join(classes.select("c", "n", *PARITIES), ["c", "n"]), f"leaders{turn}")
        # each class with the leader it shares most lists with; the rest is for the join in full below
        met = _candidates(index, leaders, percent).groupBy("a", "b").agg(F.sum("weight").alias("shared"))
        best = met.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        pairs = scratch.save(ordered(best), f"pairs{turn}")
        new = verifier.links(pairs, f"links{turn}")
        links = new if links is None else links.unionByName(new)
        index = _rooted(index.select("s", "c", "n", "pos", "weight"), links, classes, scratch, f"round{turn + 1}")
        scratch.drop(f"leaders{turn}", f"pairs{turn}", f"round{turn}-index" if turn else "index")
    rest = scratch.save(ordered(_candidates(index.where("NOT main"), index, percent, once=True)), "pairs")
    links = links.unionByName(verifier.links(rest, "links"))
    scratch.drop("pairs", f"round{STAR_ROUNDS}-index", *(f"links{x}-sets" for x in ("", *range(STAR_ROUNDS))), "candidates")

    roots = components(links, scratch, "final").select(F.col("node.c").alias("c"), F.col("node.n").alias("n"), "root")
    least = sizes.where("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("least"))
    linked = scratch.save(least.join(roots, ["c", "n"], "left").withColumn("root", F.coalesce("root", F.struct("c", "n"))), "classes")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = scratch.save(linked.join(whole, "root").select("c", "n", "root", "component_id"), "by-class")
    scratch.drop("classes")
    return sizes.join(by_class, ["c", "n"], "left").select("doc_id", "t", "n", "root", "component_id")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its shingle set and the
    least doc_id reachable by links of Jaccard similarity ``percent`` / 100 or more.

    Words are separated by ASCII white space, with A-Z as a-z. Rows without words or text have
    no shingle and link with nothing, equal texts included: their component is their own id. Repeated rows are one
    class; a null id is never a least id unless its component has no other. An empty table gives
    none. Other columns are ignored, whatever their names. Very long texts are read whole; the shingles of one
    document are made and kept by one task.
    """
    return _grouped(docs, k, percent, key, text, Scratch(docs.sparkSession, "jaccard")).select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every component the row with the least id (null last; of rows
    equal in id the least text hash, of equal rows one). Rows without words are no copies and all stay. Columns keep their
    names, whatever these are; an empty table gives none."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    grouped = _grouped(docs, k, percent, key, text, scratch).where("n > 0")
    least = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("t"))).alias("m"))
    keepers = scratch.save(least.select(F.col("m.doc_id").alias("id"), F.col("m.t").alias("t")), "keepers")
    scratch.drop("figures", "by-class")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the row travels as one column, so that its columns may have any names
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(raw).alias("own_t"),
                         F.col(f"`{key}`").cast("bigint").alias("own_id"), (F.btrim(raw, F.lit(SEPARATOR_CHARS)) != "").alias("has_words"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_t") == F.col("t"))
    chosen = marked.where("has_words").join(keepers, same, "left_semi").dropDuplicates(["own_id", "own_t"])
    return chosen.unionByName(marked.where("NOT has_words")).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


#: The contract in SQL over all shared shingles; for small tables only.
ORACLE_SMALL = """
WITH RECURSIVE w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words
  FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT r, array_to_string(words[i:i + 4], ' ') AS s
  FROM w, unnest(range(1, greatest(len(words) - 3, 2))) AS t(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM sh GROUP BY r),
ov AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM ov JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
sym AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS m FROM n UNION SELECT reach.r, sym.y FROM reach JOIN sym ON sym.x = reach.m),
comp AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.m GROUP BY reach.r)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) LEFT JOIN comp USING (r)
"""

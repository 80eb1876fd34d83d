"""Source divergence audit with late string materialisation.

How far do the sources of one language differ in their words? Counts are shuffled under fixed-width
term digests; strings stay where they are until the end:

1. *Kept digests.* Tasks count in how many documents of a language each digest occurs; only (language,
   digest, number) is shuffled. Digests of too few documents go.
2. *Counts.* A second pass writes a row per slice of texts, group and term of a kept digest, string included. From
   this table the sums per (language, source, digest) are shuffled without strings.
3. *Collisions.* The least and the greatest string of each kept digest are compared. Where they
   differ, several terms share the digest: its rows, and only these, are counted again by string.
4. *Text.* Strings are joined back to the rows of the result alone: the ten terms of a group and those that
   tie with the last of them.

Pairs of sources are compared over all kept terms at once: tasks hold the rates of a block of terms for a tile
of at most ``TILE`` x ``TILE`` sources as matrices and emit one partial sum per pair of the tile. Terms that a
source does not have enter with that source's rate for count 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, bit_array, bit_filter, bytes_of, in_bits, passing, read, slices
from vellum.llm.hashing import U, words

#: Sources of one side of a tile, parts of a language's terms in the tile join, and terms of one numpy block.
TILE, SALT, BLOCK = 64, 32, 256
#: Bits of the filter for kept digests (8 MB) and for those with several terms (1 MB).
KEPT_BITS, SPLIT_BITS = 1 << 26, 1 << 23
_LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])


def term_array(col: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of all texts end to end (stretches of ASCII letters and of characters beyond ASCII, A-Z
    as a-z), and the number of each term's text."""
    data, offsets = bytes_of(col)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = _LETTER[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][np.diff(offsets) > 0]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    place = np.concatenate([[0], np.cumsum(inside)])
    ends = np.append(place[start], place[-1]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside].tobytes()))
    return terms, np.searchsorted(offsets, start, side="right") - 1


def digests(terms: pa.Array, bits: int) -> np.ndarray:
    return (words(terms).hash >> U(64 - bits)).astype(np.int64) if bits < 64 else words(terms).hash.view(np.int64)


def _counted(part: pa.RecordBatch, by_source: bool, bits: int):
    """Of a slice (lang, source, text): the distinct terms and their digests, and per (group, term) the
    number of the group's first row, of the term, how often it occurs and in how many documents."""
    terms, doc = term_array(part.column(2))
    coded = terms.dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy().astype(np.int64)
    pair, times = np.unique(doc * max(1, len(names)) + code, return_counts=True)
    group = part.column(0).dictionary_encode().indices.to_numpy().astype(np.int64)
    if by_source:
        source = part.column(1).dictionary_encode().indices.to_numpy().astype(np.int64)
        group = group * part.num_rows + source
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    key, at = np.unique(group[pair // max(1, len(names))] * max(1, len(names)) + pair % max(1, len(names)), return_inverse=True)
    return names, digests(names, bits), first[key // max(1, len(names))], key % max(1, len(names)), np.bincount(at, times, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))


def _documents(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, digest, n_docs)"""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            _, digest, row, term, _, n_docs = _counted(part, False, bits)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(digest[term]), pa.array(n_docs)], names=["lang", "digest", "n_docs"])


def _occurrences(bits: int, wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, digest, term, count, n_docs) of digests that pass the filter."""
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            names, digest, row, term, count, n_docs = _counted(part, True, bits)
            live = in_bits(wanted, digest.view(U))[term] if len(term) else np.zeros(0, bool)
            row, term = pa.array(row[live]), term[live]
            yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(digest[term]), names.take(pa.array(term)),
                                              pa.array(count[live]), pa.array(n_docs[live])], names=["lang", "source", "digest", "term", "count", "n_docs"])


def rate(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), exactly; null without kept terms."""
    return F.expr(f"1 + cast(1000000000 as decimal(10, 0)) * cast({count} + 2 as decimal(19, 0)) div cast({total} + 2 * {kept} as decimal(20, 0))")


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, left, right, zero1, zero2, own1, own2): a term's rates (place in the tile, p) over those of count 0.
    Emits (lang, left, right, cell, value): sums over the batch's terms, cell = place 1 * TILE + place 2."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        left, right = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
        _, first, tile = np.unique(np.stack([lang.indices.to_numpy().astype(np.int64), left, right]), axis=1, return_index=True, return_inverse=True)
        for k, f in enumerate(first):
            rows = np.flatnonzero(tile.ravel() == k)
            side = []
            for zero, own in ((3, 5), (4, 6)):
                base = np.array(batch.column(zero)[int(f)].as_py(), np.int64)
                lists = batch.column(own).take(pa.array(rows))
                dense = np.repeat(base[None, :], len(rows), 0)
                flat = lists.flatten()
                dense[np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy()), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                side.append(dense)
            total = np.zeros((side[0].shape[1], side[1].shape[1]), np.int64)
            for at in range(0, len(rows), BLOCK):
                p, q = side[0][at:at + BLOCK, :, None], side[1][at:at + BLOCK, None, :]
                total += ((p - q) ** 2 // (p + q)).sum(axis=0)
            cell = (np.arange(total.shape[0])[:, None] * TILE + np.arange(total.shape[1])).ravel()
            again = pa.array(np.full(len(cell), f))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), batch.column(2).take(again), pa.array(cell), pa.array(total.ravel())],
                                             names=["lang", "left", "right", "cell", "value"])


def term_counts(source: DataFrame, scratch: Scratch, min_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, sub, count) of the kept terms, and names (lang, digest, lo). A term is a digest, and
    a string ``sub`` where several terms share the digest (else the empty string)."""
    numbers = source.mapInArrow(partial(_documents, bits), "lang string, digest bigint, n_docs bigint")
    kept = scratch.save(numbers.groupBy("lang", "digest").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select("lang", "digest"), "kept")
    wanted = bit_array(bit_filter(kept, "digest", KEPT_BITS), KEPT_BITS)
    rows = scratch.save(source.mapInArrow(partial(_occurrences, bits, wanted), "lang string, source string, digest bigint, term string, count bigint, n_docs bigint"), "rows")
    key = ["lang", "digest"]
    # each string once first: a least or greatest string is found by sorting, which all rows would pay for (the count
    # keeps Spark from leaving the first step out)
    strings = rows.select(*key, "term").distinct()
    names = scratch.save(strings.groupBy(*key).agg(F.min("term").alias("lo"), F.max("term").alias("hi"), F.count("*").alias("strings")).join(kept, key), "names")
    shared = names.where("strings > 1").select(*key)
    plain = rows.groupBy("lang", "source", "digest").agg(F.sum("count").alias("count")).join(names.where("strings = 1").select(*key), key)
    split = scratch.save(passing(rows, "digest", bit_filter(shared, "digest", SPLIT_BITS), SPLIT_BITS).join(shared, key)
                         .groupBy("lang", "source", "digest", "term").agg(F.sum("count").alias("count"), F.sum("n_docs").alias("n_docs")), "split")
    enough = split.groupBy(*key, "term").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= min_docs).select(*key, "term")
    columns = ["lang", "source", "digest", "sub", "count"]
    counts = plain.withColumn("sub", F.lit("")).select(*columns).unionByName(split.join(enough, [*key, "term"]).withColumnRenamed("term", "sub").select(*columns))
    return scratch.save(counts, "counts"), names


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, bits: int = 64, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): per (lang, source) group of ``docs``, part ``pair`` has every other source
    of the language with the divergence of their term rates, part ``term`` the ``top`` terms that are more frequent in the
    group than in the language, by their share of the divergence from it.

    Terms are stretches of letters (all characters beyond ASCII count as letters), A-Z as a-z; a language keeps those of
    at least ``min_docs`` of its documents. Null texts, languages and sources are empty strings; empty texts have no term but
    their group counts; repeated rows are documents of their own; ties go to the item that is less in UTF-8; columns
    other than these three are ignored, whatever their names; an empty table gives none. A long text is counted in one task.
    ``bits``: width of the digests; the result does not depend on it.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    texts = docs.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))
    counts, names = term_counts(texts, scratch, min_docs, bits)
    term = ["lang", "digest", "sub"]
    by_lang = scratch.save(counts.groupBy(*term).agg(F.sum("count").alias("all")), "by-lang")
    sums = by_lang.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("lang_total"))
    own = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = scratch.save(
        texts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sums, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("pos", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")

    rated = counts.join(groups, ["lang", "source"])
    p = scratch.save(rated.select(*term, "source", "pos", "lang_total", "kept", rate("count", "total", "kept").alias("p")), "rates")
    gain = p.join(by_lang, term).withColumn("q", rate("all", "lang_total", "kept")).where("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    group = Window.partitionBy("lang", "source")
    best = scratch.save(gain.select("lang", "source", "digest", "sub", value.alias("value"))
                        .withColumn("r", F.rank().over(group.orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r"), "best")
    item = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("sub"))
    ranked = F.row_number().over(group.orderBy(F.desc("value"), "item"))
    terms = (best.join(names, ["lang", "digest"]).select("lang", "source", F.lit("term").alias("part"), item.alias("item"), "value")
             .withColumn("rank", ranked).where(F.col("rank") <= top))

    # a row per language and tile, with the rates of count 0
    zero = groups.where("kept > 0").select("lang", F.expr(f"pos div {TILE}").alias("tile"), "pos", rate("0", "total", "kept").alias("p"))
    tiles = zero.groupBy("lang", "tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda x: x.p).alias("zero"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    side = lambda k: tiles.select("lang", F.col("tile").alias(("left", "right")[k]), F.col("zero").alias(f"zero{k + 1}"))
    both = scratch.save(side(0).join(side(1), "lang").select("*", salt), "tiles")
    lists = p.groupBy(*term).agg(F.collect_list(F.struct("pos", "p")).alias("own")).withColumn("salt", F.pmod(F.xxhash64("digest", "sub"), F.lit(SALT)).cast("int"))
    inside = lambda tile: F.transform(F.filter("own", lambda x: F.floor(x.pos / TILE) == F.col(tile)), lambda x: F.struct((x.pos % TILE).alias("at"), x.p.alias("p")))
    cells = (lists.join(both, ["lang", "salt"]).select("lang", "left", "right", "zero1", "zero2", inside("left").alias("own1"), inside("right").alias("own2"))
             .mapInArrow(_tile_sums, "lang string, left bigint, right bigint, cell bigint, value bigint")
             .groupBy("lang", "left", "right", "cell").agg(F.sum("value").alias("value")))
    summed = cells.select("lang", (F.col("left") * TILE + F.expr(f"cell div {TILE}")).alias("pos"), (F.col("right") * TILE + F.col("cell") % TILE).alias("pos2"), "value")
    other = groups.select("lang", F.col("source").alias("item"), F.col("pos").alias("pos2"))
    pairs = (groups.select("lang", "source", "pos").join(other, "lang").where("pos != pos2").join(summed, ["lang", "pos", "pos2"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", ranked))
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read(spark, sf_dir, "documents"))


#: The contract in SQL, over strings.
ORACLE = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
doc_terms AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS c FROM terms GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(c) AS all_c FROM doc_terms GROUP BY lang, term HAVING count(*) >= 10),
langs AS MATERIALIZED (SELECT lang, count(*) AS v, sum(all_c) AS n FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, sum(c) AS c FROM doc_terms JOIN kept USING (lang, term) GROUP BY ALL),
totals AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0) AS n FROM groups LEFT JOIN counts USING (lang, source) GROUP BY ALL),
rates AS MATERIALIZED (SELECT t.lang, t.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2)::HUGEINT // (t.n + 2 * l.v)::HUGEINT AS p,
    1 + 1000000000::HUGEINT * (k.all_c + 2)::HUGEINT // (l.n + 2 * l.v)::HUGEINT AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts ON counts.lang = t.lang AND counts.source = t.source AND counts.term = k.term),
pair_sums AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM rates x JOIN rates y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
gains AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM rates WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM gains))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

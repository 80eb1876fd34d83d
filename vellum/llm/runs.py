"""Periodic runs of words, by an online sparse diagonal programme.

On the diagonal of lag q stand the pairs (i, i - q) of equal words. A stretch of m such pairs is
m + q words with period q. The words of a document are read in order; a word that is due looks up
its earlier occurrences, and each of them opens its lag: the lag's match length is incremented, as
far as the diagonal goes, and a diagonal that ends with sufficient length emits its run at once.

Two rules keep this sparse without losing a run:

* *Due words.* A run of period q has at least 3 q consecutive matches. For lags in (Q / 2, Q], Q a
  power of two, these hold a word whose number is a multiple of Q. So only those words look for
  occurrences between Q / 2 and Q words before: n / 2 pairs a power at most, also where all
  words are equal.
* *Half lengths.* Of the matches of a run, half lie before or behind the due word. A lag is opened
  only if one of these halves agrees, which is one comparison of two window hashes. Increments
  go by powers of two of words, compared in the same way.

A stretch that has a period q and also a smaller one, p, has 4 q words, so p divides q and both diagonals
end at the same words: of runs with the same ends the smallest period stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, let, read, slices, word_array
from vellum.llm.hashing import U, Words, mix, prefix, spans, words

#: A run has this many periods, and this many words.
PERIODS, LEAST = 4, 6
#: Up to this lag, earlier occurrences are looked up lag by lag.
NEAR = 64


def _matches(sums: np.ndarray, i: np.ndarray, lag: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``i`` on (``step`` 1) or before ``i`` (-1) equal those ``lag`` before; ``room``
    at most. Lengths grow by powers of two, the largest first."""
    have = np.zeros(len(i), np.int64)
    power = 1 << int(room.max()).bit_length() if len(room) else 0
    while power:
        may = np.flatnonzero(have + power <= room)
        at = i[may] + have[may] if step > 0 else i[may] - have[may] - power
        same = spans(sums, at, at + power) == spans(sums, at - lag[may], at - lag[may] + power)
        have[may[same]] += power
        power >>= 1
    return have


def find_runs(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of several documents (word hashes end to end,
    ``first`` their bounds), by document, start and period. Starts are word numbers of the document."""
    none = np.zeros(0, np.int64)
    size = np.diff(first)
    if not len(size) or size.max() < LEAST:
        return none, none, none, none
    total = len(hashes)
    doc = np.repeat(np.arange(len(size)), size)
    sums = prefix(hashes)
    # places of each word in its document, in order
    key = mix(hashes + doc.astype(U) * U(0x9E3779B97F4A7C15))
    place = np.argsort(key, kind="stable")
    group = np.empty(total, np.int64)
    group[place] = np.cumsum(np.concatenate([[0], key[place][1:] != key[place][:-1]]))
    listed = group[place] * total + place
    low, high = first[:-1][doc], first[1:][doc]
    found = []
    scale = 1
    while scale // 2 < size.max() // PERIODS:
        large = np.flatnonzero(size // PERIODS > scale // 2)
        count = -(-size[large] // scale)
        ends = np.cumsum(count)
        due = np.repeat(first[large] - (ends - count) * scale, count) + np.arange(ends[-1]) * scale
        if scale <= NEAR:  # one lag after the other is quicker than the list
            pairs = []
            for q in range(scale // 2 + 1, scale + 1):
                at = due[np.searchsorted(due, q):]
                pairs.append((at[key[at] == key[at - q]], q))
            i, lag = np.concatenate([x for x, _ in pairs]), np.concatenate([np.full(len(x), q) for x, q in pairs])
            j = i - lag
        else:
            # its occurrences at lags above scale / 2 and up to scale, as a range of the list
            base = group[due] * total
            left = np.searchsorted(listed, base + np.maximum(low[due], due - scale))
            right = np.searchsorted(listed, base + due - scale // 2)
            count = np.maximum(0, right - left)
            ends = np.cumsum(count)
            i = np.repeat(due, count)
            j = place[np.arange(len(i)) - np.repeat(ends - count, count) + np.repeat(left, count)]
            lag = i - j
        half = (np.maximum((PERIODS - 1) * lag, LEAST - lag) + 1) // 2
        ahead, behind = i + half <= high[i], j - half >= low[i]
        live = np.zeros(len(i), bool)
        for may, shift in ((ahead, 0), (behind, half)):
            at = np.flatnonzero(may & ~live)
            x = i[at] - (shift if np.isscalar(shift) else shift[at])
            live[at] = spans(sums, x, x + half[at]) == spans(sums, x - lag[at], x - lag[at] + half[at])
        i, lag = i[live], lag[live]
        before = _matches(sums, i, lag, i - lag - low[i], -1)
        match = before + _matches(sums, i, lag, high[i] - i, 1)
        ended = (match >= (PERIODS - 1) * lag) & (match + lag >= LEAST)
        start, length, lag = (i - before - lag)[ended], (match + lag)[ended], lag[ended]
        found.append(np.unique(np.stack([start, length, lag], 1), axis=0))
        scale *= 2
    start, length, lag = np.concatenate(found).T
    order = np.lexsort((lag, length, start))
    start, length, lag = start[order], length[order], lag[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, lag = start[new], length[new], lag[new]
    order = np.lexsort((lag, start))
    start, length, lag = start[order], length[order], lag[order]
    owner = doc[start]
    return owner, start - first[owner], length, lag


def _collapse(w: Words, doc: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray, texts: list[str]) -> list[str]:
    """The texts' words without those that a run holds after its first period, joined by one space."""
    out = [b" ".join(t.encode().split()).decode() for t in texts]
    change = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(change, w.first[doc] + start + period, 1)
    np.add.at(change, w.first[doc] + start + length, -1)
    stay = np.cumsum(change)[:-1] == 0
    for d in np.unique(doc):
        own = texts[d].encode().split()
        out[d] = b" ".join([own[k] for k in np.flatnonzero(stay[w.first[d]:w.first[d + 1]])]).decode()
    return out


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, batch.schema.names[-1]):
            col = part.column(part.num_columns - 1)
            w = words(col)
            doc, start, length, period = find_runs(w.hash, w.first)
            edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
            runs = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.StructArray.from_arrays(
                [pa.array(x) for x in (start, length, period)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(np.diff(w.first)), runs.cast(_RUNS), pa.array(_collapse(w, doc, start, length, period, col.to_pylist()), pa.string())],
                names=[*part.schema.names[:-1], "n_words", "runs", "collapsed_text"])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text and with n_words, runs (array of start, length, period: word numbers from 0, by
    start and period) and collapsed_text.

    Words are what ASCII white space separates, unchanged. A run is a stretch of words with smallest
    period q and at least max(6, 4 q) words that no neighbour extends with that period.
    collapsed_text drops each word that any run holds after its first q words; the others are joined by
    one space. Null and empty texts have no words, no runs and the empty text; repeated rows are
    treated alike, each on its own; columns named like the new ones are replaced; an empty table gives
    none. One narrow pass; a document is one task's work, n log n for n words.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, "n_words", "runs", "collapsed_text")]
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(text))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(_mark, f"{fields}n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string")


def with_cycles(doc_id: Column, text: Column) -> Column:
    """The contract's texts: where crc32(doc_id) ends in 0, the words from one place on repeat with one period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def cycled(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1),
                                            lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))

    return F.when(h % 10 == 0, let(word_array(text), lambda w: F.when(F.size(w) > 0, cycled(w)).otherwise(F.lit("")))).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_cycles(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_sort("runs", lambda x, y: F.when(x.length != y.length, F.when(x.length > y.length, -1).otherwise(1))
                           .when(x.start != y.start, F.when(x.start < y.start, -1).otherwise(1))
                           .otherwise(F.when(x.period < y.period, -1).when(x.period > y.period, 1).otherwise(0)))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))))
    top = F.col("top")
    return found.withColumn("top", F.get(longest, F.lit(0))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), top.start.alias("start"), top.length.alias("length"), top.period.alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))




#: crc32 of an ASCII string ``s``, bit by bit.
_CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({s}, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: The contract in SQL over all pairs of equal words of every text; for small tables only.
ORACLE_SMALL = f"""
WITH given AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_CRC32_SQL.format(s="CAST(doc_id AS VARCHAR)")}, 1) AS h,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
placed AS (SELECT *, len(words) AS n, h // 10 AS g FROM given),
cycle AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM placed),
cycled AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cycle),
w AS MATERIALIZED (SELECT r, n, i, words[1 + CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % p END] AS word FROM cycled, unnest(range(n)) AS t(i)),
pairs AS (SELECT x.r, x.i - y.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
diagonals AS (SELECT r, q, min(i) - q AS start, count(*) + q AS length FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM diagonals GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN gone USING (r, i) GROUP BY w.r),
top AS (SELECT r, count(*) AS n_runs, first(runs ORDER BY length DESC, start, period) AS t,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, t.start AS start, t.length AS length, t.period AS period, 1000 * t.length // t.period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM given LEFT JOIN top USING (r) LEFT JOIN kept USING (r)
"""

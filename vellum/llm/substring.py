"""Substring deduplication: word windows repeated anywhere, found by level-wise doubling.

To find windows of L words that occur at two or more places, windows of a quarter of L come
first; only those repeated at one length are extended to twice that length, until L is reached
or no candidate is left:

1. *Anchors.* The first level looks at one short window in each L-window only: the one with the
   least hash (leftmost of equals). Two equal L-windows have the same anchor, so none is lost, and
   about one window in fourteen is counted. Runs of L-windows share their anchor.
2. *Doubled.* Around every repeated anchor the window of twice its length that lies inside the L-window
   (to the right, or else reaching left) is counted.
3. *Full length.* For repeated doubled windows the whole region of a run (its L-windows end to
   end) is counted first: a region repeated as a whole settles all its windows at once. The windows
   of regions found once are looked up one by one among all distinct regions with the
   same doubled window.

Texts travel under a 128-bit content key, so copies collapse before anything is counted, and
all counts are summed per task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, SEPARATOR_CHARS, read, slices, word_array
from vellum.llm.hashing import U, mix, prefix, sliding_min, spans, window_starts, words

_POSITION = 28  # low bits of an anchor's rank that hold its place


def anchor_runs(hashes: np.ndarray, first: np.ndarray, length: int, short: int):
    """Runs of consecutive L-windows with one anchor: (document, anchor, first window, last
    window, anchor's hash), positions counted over the batch."""
    start, doc = window_starts(first, length)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, U)
    sums = prefix(hashes)
    n = len(hashes) - short + 1
    at = np.arange(n)
    small = spans(sums, at, at + short)
    mask = U((1 << _POSITION) - 1)
    rank = (small & ~mask) | (at.astype(U) & mask)
    least = sliding_min(rank, length - short + 1)[start] & mask
    # the place is known modulo 2^28; the window tells the rest
    anchor = start + ((least.astype(np.int64) - start) & ((1 << _POSITION) - 1))
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(start)]]) - 1
    return doc[head], anchor[head], start[head], start[tail], small[anchor[head]]


def _distinct(part: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """One row per content key (the first two columns) and how many rows it stands for."""
    k = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], 1)
    _, rows, counts = np.unique(k, axis=0, return_index=True, return_counts=True)
    order = np.argsort(rows)
    return part.take(pa.array(rows[order])), counts[order]


def _anchors(length: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, weight = _distinct(batch)
            for part in slices(own, "text"):
                w = words(part.column(2))
                doc, anchor, _, _, h = anchor_runs(w.hash, w.first, length, short)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array((anchor - w.first[doc]).astype(np.int32)),
                     pa.array(h.view(np.int64)), pa.array(weight[:part.num_rows][doc].astype(np.int64))], names=["k1", "k2", "pos", "h", "w"])
                weight = weight[part.num_rows:]
    return run


def _regions(length: int, short: int):
    """Runs with a surviving anchor: doubled hash, region hash, and the hashes of their windows."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("h2", pa.int64()),
                        ("r1", pa.int64()), ("r2", pa.int64()), ("windows", pa.list_(pa.int64())), ("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, weight = _distinct(batch)
            for part in slices(own, "text"):
                w = words(part.column(2))
                doc, anchor, lo, hi, _ = anchor_runs(w.hash, w.first, length, short)
                live = np.zeros(len(w.hash) + 1, bool)
                places = part.column(3)
                flat = places.flatten().to_numpy()
                live[flat + np.repeat(w.first[:-1], places.value_lengths().to_numpy())] = True
                keep = live[anchor]
                doc, anchor, lo, hi = doc[keep], anchor[keep], lo[keep], hi[keep]
                # windows too far left of the anchor for a doubled window to the right
                edge = anchor - (length - 2 * short)
                left, right = lo < edge, hi >= edge
                doc = np.concatenate([doc[left], doc[right]])
                begin = np.concatenate([anchor[left] - short, anchor[right]])
                lo, hi = (np.concatenate([lo[left], np.maximum(lo, edge)[right]]),
                          np.concatenate([np.minimum(hi, edge - 1)[left], hi[right]]))
                one, two = prefix(w.hash), prefix(mix(w.hash ^ U(0x5851F42D4C957F2D)), 2)
                count = hi - lo + 1
                ends = np.cumsum(count)
                each = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(lo, count)
                base = w.first[doc]
                columns = [part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), (lo - base).astype(np.int32),
                           (hi - base).astype(np.int32), spans(one, begin, begin + 2 * short).view(np.int64),
                           spans(one, lo, hi + length).view(np.int64), spans(two, lo, hi + length, 2).view(np.int64),
                           pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                                    pa.array(spans(two, each, each + length, 2).view(np.int64))),
                           weight[:part.num_rows][doc].astype(np.int64)]
                weight = weight[part.num_rows:]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)
    return run, "k1 bigint, k2 bigint, lo int, hi int, h2 bigint, r1 bigint, r2 bigint, windows array<bigint>, w bigint"


def _cut(length: int):
    """Appends kept_text, n_words and n_removed; text and spans are the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[-2]):
                own, texts, places = part.columns[:-2], part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                w = words(texts)
                kept = texts.to_pylist()
                total, removed = np.diff(w.first), np.zeros(part.num_rows, np.int64)
                for d in np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False)):
                    where, a, n = places[int(d)].values, w.first[d], total[d]
                    change = np.zeros(n + 1, np.int64)
                    np.add.at(change, where.field(0).to_numpy(), 1)
                    np.add.at(change, where.field(1).to_numpy() + length, -1)
                    stay = np.cumsum(change)[:n] == 0
                    removed[d] = n - stay.sum()
                    head = np.flatnonzero(stay & np.concatenate([[True], ~stay[:-1]]))
                    tail = np.flatnonzero(stay & np.concatenate([~stay[1:], [True]]))
                    # a run of kept words, and the white space up to the next word of the text
                    stop = np.where(tail + 1 < n, w.start[np.minimum(a + tail + 1, len(w.start) - 1)], w.doc_offsets[d + 1])
                    pieces = b"".join(w.data[s:e].tobytes() for s, e in zip(w.start[a + head], stop, strict=True))
                    kept[d] = pieces.decode("utf-8").rstrip(SEPARATOR_CHARS)
                yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.string()), pa.array(total), pa.array(removed)],
                                                 names=[*part.schema.names[:-2], "kept_text", "n_words", "n_removed"])
    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = 35, text: str = "text") -> DataFrame:
    """(k1, k2, spans): per text key with any, the ranges [lo, hi] of windows of ``length`` words whose
    word sequence starts at two or more places of ``docs``."""
    short = -(-length // 4)
    keyed = _keyed(docs, text).select("k1", "k2", "text")
    first = scratch.save(keyed.mapInArrow(_anchors(length, short), "k1 bigint, k2 bigint, pos int, h bigint, w bigint"), "anchors")
    often = scratch.save(first.groupBy("h").agg(F.sum("w").alias("n")).where("n > 1").select("h"), "anchors-repeated")
    places = scratch.save(first.join(often, "h").groupBy("k1", "k2").agg(F.collect_set("pos").alias("places")), "places")
    scratch.drop("anchors", "anchors-repeated")

    run, schema = _regions(length, short)
    runs = scratch.save(keyed.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places").mapInArrow(run, schema), "runs")
    scratch.drop("places")
    often = scratch.save(runs.groupBy("h2").agg(F.sum("w").alias("n")).where("n > 1").select("h2"), "doubled-repeated")
    live = scratch.save(runs.join(often, "h2"), "doubled")
    scratch.drop("runs", "doubled-repeated")

    key = ["h2", "r1", "r2"]
    regions = scratch.save(live.groupBy(*key).agg(
        F.sum("w").alias("n"), F.first("windows").alias("windows"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("lo").alias("lo")), "regions")
    each = regions.select("h2", "n", F.explode("windows").alias("g"))
    often = scratch.save(each.groupBy("h2", "g").agg(F.sum("n").alias("n")).where("n > 1").select("h2", "g"), "windows-repeated")
    whole = live.select(*key, "k1", "k2", "lo", "hi").join(regions.where("n > 1").select(*key), key).select("k1", "k2", "lo", "hi")
    single = (regions.where("n = 1").select("h2", "k1", "k2", "lo", F.posexplode("windows").alias("step", "g")).join(often, ["h2", "g"])
              .select("k1", "k2", (F.col("lo") + F.col("step")).alias("lo"), (F.col("lo") + F.col("step")).alias("hi")))
    found = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    out = scratch.save(found, "spans")
    scratch.drop("doubled", "regions", "windows-repeated")
    return out


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(raw).alias("k1"), F.xxhash64(F.lit(1), raw).alias("k2"), raw.alias("text"), F.struct(*docs.columns).alias("row"))


def remove_repeats(docs: DataFrame, length: int = 35, text: str = "text") -> DataFrame:
    """``docs`` with three more columns: kept_text (the text without every word that lies in a repeated window;
    white space between kept words stays), n_words and n_removed.

    Words are what ASCII white space separates, unchanged. Windows are judged on the input. Null and
    empty texts have no words and keep their null or empty text; repeated rows (also of one id) are
    each other's repeats; columns of ``docs`` named like the new ones are replaced; an empty table
    gives none. One document's windows are handled by one task.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    kept = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    docs = docs.select(*(f"`{c}`" for c in kept))
    found = repeated_spans(docs, scratch, length, text)
    joined = _keyed(docs, text).select("k1", "k2", "row").join(found, ["k1", "k2"], "left").select(
        *(F.col(f"row.`{c}`").alias(c) for c in kept), F.col(f"row.`{text}`").alias("_text"), F.col("spans").alias("_spans"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema.fields[:-2])
    return joined.mapInArrow(_cut(length), f"{fields}kept_text string, n_words bigint, n_removed bigint")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = F.concat_ws(" ", word_array(F.col("kept_text")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


#: Windows by their words in one string, counted over all documents; for small tables only.
ORACLE_SMALL = """
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT r, i, array_to_string(words[i:i + 34], ' ') AS g FROM w, unnest(range(1, len(words) - 33)) AS t(i)),
bad AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, j FROM bad, unnest(range(i, i + 35)) AS t(j)),
kept AS (SELECT w.r, array_to_string(list(w.words[j] ORDER BY j) FILTER (WHERE gone.j IS NULL), ' ') AS text, count(gone.j) AS n
  FROM w JOIN unnest(range(1, len(w.words) + 1)) AS t(j) ON true LEFT JOIN gone USING (r, j) GROUP BY w.r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

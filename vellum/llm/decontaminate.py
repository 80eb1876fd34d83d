"""Benchmark decontamination by latent semantic retrieval, subsequences and answers.

1. *Passages.* Documents and benchmark items are cut into overlapping windows of words; a window's
   TF-IDF vector (each of its words once) uses document frequencies of the whole corpus.
2. *Latent space.* A randomised SVD of the passage-term matrix over the items' vocabulary: item
   passages and those of the whole corpus. Spark sums the corpus passages' A'A, whose sides are the
   vocabulary of a bounded number of items whatever the corpus; only this factor reaches the driver.
3. *Candidates.* Every window of every document is compared with all item passages by cosine in
   the latent space. A window whose weight lies too little on the items' words cannot reach the
   threshold (Cauchy-Schwarz; each word counts once) and is left out before projecting. Items shorter
   than a window are compared with the windows of their own length, from every word on.
4. *Checks.* Around candidate windows, the longest common subsequence of words with the item must
   cover enough of the item, and of its answer (its last sentence), so that reordered or
   partly reworded copies count and chance likeness does not.

The items are a stated query set, taken in blocks of at most ``BLOCK`` items and ``RANK`` passages (an item
stays whole) with a latent space each, so that the rank grows with no benchmark. Where the leading
directions hold too little of an item passage, its own direction joins them: a verbatim copy is never lost.
Items shorter than ``WIDTH`` words are in blocks of their own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, read, slices, unused
from vellum.llm.hashing import U, words

TERMS = 1 << 16
#: Words of a passage, and from one passage of a document (or item) to the next.
WIDTH, STEP, ITEM_STEP = 20, 5, 10
#: Items of one latent space, its rank and the further columns of the range finder.
BLOCK, RANK, OVERSAMPLE = 256, 384, 16
#: Part of its norm that every item passage keeps in the latent space, and latent spaces of one pass over the documents.
KEPT, SPACES = 0.9, 16
#: All corpus passages together weigh this part of the items' in the SVD; entries of A'A that one pass over the corpus sums at most
#: (a block with more has a pass of its own), and corpus passages whose word pairs are added at a time.
CORPUS_WEIGHT, ENTRIES, PAIRED = 0.25, 1 << 24, 2048
COSINE, COVER, ANSWER = 0.6, 0.6, 0.5
#: What rounding may take from a cosine that is found as a sum of its words' shares.
SLACK = 1e-3
LEAK = "struct<item_id:bigint,start:bigint,n_words:bigint,similarity:double,cover:double,answer:double>"


def _term(h: np.ndarray) -> np.ndarray:
    return (h >> U(48)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequency of every term, and the number of documents as term -1."""
    seen, n = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column(0), plain=True)
            term, edges = _term(w.hash), w.first.tolist()
            for a, b in zip(edges, edges[1:], strict=False):
                seen[term[a:b]] += 1  # a term of the document counts once
            n += part.num_rows
    used = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], n))], names=["term", "n"])


def inverse_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """idf of every term over all rows of ``text``, and their number; the table has one size for any corpus."""
    counts = texts.mapInArrow(_frequencies, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = int(counts.n[counts.term == -1].sum())
    df = np.zeros(TERMS)
    real = counts[counts.term >= 0]
    df[real.term.to_numpy(int)] = real.n.to_numpy(float)
    return np.log((n + 1) / (df + 0.5)).clip(min=0.01), n


def passages(first: np.ndarray, step: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of windows of ``width`` (WIDTH) words every ``step`` words, and one at a document's
    end; a shorter document is one window."""
    n, width = np.diff(first), width or WIDTH
    count = np.where(n > width, -(-(n - width) // step) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + np.minimum(k * step, np.maximum(n[doc] - width, 0))
    return doc, start, np.minimum(start + width, first[doc + 1])


def find(vocabulary: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Place of each word hash in the sorted vocabulary, -1 without one."""
    if not len(vocabulary):
        return np.full(len(h), -1, np.int64)
    # by their first 16 bits; where some of the vocabulary share them, the next places in turn
    term = _term(vocabulary)
    first = np.searchsorted(term, np.arange(TERMS))
    at = first.astype(np.int32)[_term(h)]
    out = np.full(len(h), -1, np.int64)
    for k in range(int(np.bincount(term).max())):
        place = np.minimum(at + k, len(vocabulary) - 1)
        np.copyto(out, place, where=vocabulary[place] == h)
    return out


def _rows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges, and the range of each."""
    n = end - start
    row = np.repeat(np.arange(len(n)), n)
    return start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; bit-parallel over ``a``."""
    masks: dict[int, int] = defaultdict(int)
    for k, x in enumerate(a):
        masks[x] |= 1 << k
    whole = state = (1 << len(a)) - 1
    for x in b:
        m = masks.get(x)
        if m:
            u = state & m
            state = ((state + u) | (state - u)) & whole
    return len(a) - state.bit_count()


@dataclass
class Item:
    item_id: int
    tokens: list[int]
    answer: list[int]


@dataclass
class Space:
    """One block's items and latent space: ``basis`` (vocabulary x rank), and per item passage its
    unit latent vector, item and number of words."""

    items: list[Item]
    idf: np.ndarray
    vocabulary: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    owner: np.ndarray
    size: np.ndarray

    @cached_property
    def parts(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By width of their windows: item passages, their vectors, and of every word of the vocabulary its share in the cosine with each
        of them, before weights."""
        width = np.minimum(self.size, WIDTH)
        own = [(w, np.flatnonzero(width == w)) for w in np.unique(width).tolist()]
        return [(w, to, self.vectors[to], self.basis @ self.vectors[to].T) for w, to in own]


def answer_of(text: str) -> str:
    """The last sentence, or the last third of the words if there is but one."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if re.search(r"\w", p)]
    if len(parts) > 1:
        return parts[-1]
    w = text.split()
    return " ".join(w[-max(1, len(w) // 3):])


def _tokens(text: str) -> list[int]:
    return words(pa.array([text]), plain=True).hash.tolist()


def _gram(vocabularies: list[np.ndarray], idf: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task's passages the entries of A'A on and above its diagonal, by vocabulary (space, cell, value); a last row of space
    -1 counts the passages. A word that a passage has twice counts twice."""
    total, n = [np.zeros(len(v) ** 2) for v in vocabularies], 0
    for batch in batches:
        for part in slices(batch, "text"):
            w = words(part.column(0), plain=True)
            _, start, end = passages(w.first, WIDTH)
            n += len(start)
            at, row = _rows(start, end)
            weight = idf[_term(w.hash[at])]
            unit = weight / np.sqrt(np.bincount(row, weight ** 2, minlength=len(start)))[row]
            for own, vocabulary in zip(total, vocabularies, strict=True):
                place = find(vocabulary, w.hash)[at]
                known = np.flatnonzero(place >= 0)
                _add_pairs(own, len(vocabulary), place[known], row[known], unit[known])
    for k, own in enumerate(total):
        used = np.flatnonzero(own)
        for at in range(0, len(used), 1 << 16):
            cell = used[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(own[cell])], names=["space", "cell", "value"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int64()), pa.array([float(n)])], names=["space", "cell", "value"])


def _add_pairs(total: np.ndarray, size: int, place: np.ndarray, row: np.ndarray, weight: np.ndarray) -> None:
    """Adds the products of all pairs of words of a passage (``row``, rising) to the upper triangle ``total``."""
    edges = np.searchsorted(row, np.arange(row[0], row[-1] + PAIRED + 1, PAIRED)) if len(row) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        p, r, x = place[a:b], row[a:b], weight[a:b]
        np.add.at(total, p * (size + 1), x * x)
        for d in range(1, min(WIDTH, len(p))):
            same = np.flatnonzero(r[d:] == r[:-d])
            if not len(same):
                break
            i, j, value = p[same], p[same + d], x[same] * x[same + d]
            # a word met twice: both orders of the pair fall on the diagonal
            np.add.at(total, np.minimum(i, j) * size + np.maximum(i, j), np.where(i == j, 2 * value, value))


def corpus_grams(texts: DataFrame, vocabularies: list[np.ndarray], idf: np.ndarray) -> tuple[list[np.ndarray], int]:
    """A'A of all corpus passages for every vocabulary, and the number of passages; one pass over ``texts``."""
    summed = (texts.mapInArrow(partial(_gram, vocabularies, idf), "space int, cell bigint, value double")
              .groupBy("space", "cell").agg(F.sum("value").alias("value")).toArrow())
    space, cell, value = (summed.column(k).to_numpy() for k in range(3))
    out = []
    for k, vocabulary in enumerate(vocabularies):
        size, own = len(vocabulary), space == k
        c = np.zeros(size * size)
        c[cell[own]] = value[own]
        c = c.reshape(size, size)
        out.append(c + np.triu(c, 1).T)
    return out, int(value[space == -1].sum())


def whole_passages(basis: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``basis`` (orthonormal columns) and the directions that passages (unit rows of ``own``) lack which keep less than KEPT of their norm."""
    low = own[np.linalg.norm(own @ basis, axis=1) < KEPT]
    if len(low):
        missing = low - (low @ basis) @ basis.T
        _, size, more = np.linalg.svd(missing, full_matrices=False)
        basis = np.hstack([basis, more[size > 1e-6].T])
    if (np.linalg.norm(own @ basis, axis=1) < KEPT - 1e-6).any():
        raise ArithmeticError("an item passage lies outside its latent space")
    return basis


def vocabulary_of(items: list[tuple[int, str]]) -> np.ndarray:
    return np.unique(words(pa.array([t for _, t in items], pa.string()), plain=True).hash)


def latent_space(corpus: np.ndarray, n: int, items: list[tuple[int, str]], idf: np.ndarray) -> Space:
    """Randomised SVD with one power iteration: right singular vectors of the stacked passages. ``corpus``: A'A of the corpus'
    ``n`` passages over the items' vocabulary."""
    w = words(pa.array([t for _, t in items], pa.string()), plain=True)
    vocabulary = vocabulary_of(items)
    owner, start, end = passages(w.first, ITEM_STEP)
    at, row = _rows(start, end)
    weight = idf[_term(w.hash[at])]
    own = np.zeros((len(start), len(vocabulary)))
    own[row, find(vocabulary, w.hash[at])] = weight  # every word of a window counts once
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)

    part = CORPUS_WEIGHT * len(own) / max(1, n)
    rank = min(RANK, len(vocabulary))
    z = np.random.default_rng(1).normal(size=(len(vocabulary), min(rank + OVERSAMPLE, len(vocabulary))))
    ata = lambda x: own.T @ (own @ x) + part * (corpus @ x)
    q = np.linalg.qr(ata(z))[0]
    y = ata(q)
    q2 = np.linalg.qr(y)[0]
    # A'A on the found range, then its leading directions
    values, rotation = np.linalg.eigh(q2.T @ y @ (q.T @ q2))
    basis = whole_passages(q2 @ rotation[:, np.argsort(-values)[:rank]], own).astype(np.float32)
    vectors = own @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    known = [Item(k, _tokens(t), _tokens(answer_of(t))) for k, t in items]
    return Space(known, idf, vocabulary, basis, vectors.astype(np.float32), owner, end - start)


def repeated(h: np.ndarray) -> np.ndarray:
    """Which words occur among the WIDTH - 1 before them."""
    out = np.zeros(len(h), bool)
    for k in range(1, min(WIDTH, len(h))):
        out[k:] |= h[k:] == h[:-k]
    return out


def live_windows(first: np.ndarray, step: int, width: int, known: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the windows whose known weight can reach COSINE; ``known``, ``norm``: prefix sums."""
    if step > 1:
        doc, start, end = passages(first, step, width)
        live = known[end] - known[start] >= COSINE ** 2 * (norm[end] - norm[start])
        return doc[live], start[live], end[live]
    # from every word on: documents of up to ``width`` words whole, then the ranges inside longer ones
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) <= width))
    start = np.flatnonzero(known[width:] - known[:-width] >= COSINE ** 2 * (norm[width:] - norm[:-width])) if len(known) > width else np.zeros(0, np.int64)
    doc = np.searchsorted(first, start, side="right") - 1
    inside = (start + width <= first[doc + 1]) & (first[doc + 1] - first[doc] > width)
    return (np.concatenate([short, doc[inside]]), np.concatenate([first[short], start[inside]]),
            np.concatenate([first[short + 1], start[inside] + width]))


def candidate_windows(w, space: Space, again: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, end, cosine with item passages, these passages) of the windows that reach COSINE with any:
    windows of WIDTH words with the items of WIDTH words or more, and of their own length with each shorter one.
    ``again``: ``repeated`` of the words."""
    if not len(w.hash):
        return
    again = repeated(w.hash) if again is None else again
    place, weight = find(space.vocabulary, w.hash), space.idf[_term(w.hash)]
    # a window's word counts once: no more than all are known, and the norm is no less than without the repeated
    known = np.concatenate([[0.0], np.cumsum(np.where(place >= 0, weight ** 2, 0.0))])
    norm = np.concatenate([[0.0], np.cumsum(np.where(again, 0.0, weight ** 2))]) * (1 - 1e-9)
    for width, to, vectors, shares in space.parts:
        doc, start, end = live_windows(w.first, STEP if width == WIDTH else 1, width, known, norm)
        live = np.ones(len(doc), bool)
        if width == WIDTH:
            # nor can a cosine be more than the sum of its words' best shares
            best = np.append(shares.max(axis=1, initial=0), 0.0)[place] * weight
            best = np.concatenate([[0.0], np.cumsum(best)])
            live = best[end] - best[start] >= (COSINE - SLACK) * np.sqrt(np.maximum(norm[end] - norm[start], 0))
        for found in _compared(w, space, place, weight, vectors, shares, doc, start, end, live):
            yield *found, to


def _compared(w, space: Space, place: np.ndarray, weight: np.ndarray, vectors: np.ndarray, shares: np.ndarray, doc: np.ndarray, start: np.ndarray,
              end: np.ndarray, live: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, end, cosine with the passages of ``vectors``) of the ``live`` ones of the given windows that reach COSINE with any."""
    for k in range(0, len(doc), 1024):
        own = slice(k, min(k + 1024, len(doc)))
        n, chosen = own.stop - own.start, np.flatnonzero(live[own])
        at, row = _rows(start[own][chosen], end[own][chosen])
        row = chosen[row]
        # every word of a window counts once
        _, order = np.unique((row.astype(U) << U(54)) | (w.hash[at] >> U(10)), return_index=True)
        at, row = at[order], row[order]
        length = np.sqrt(np.bincount(row, weight[at] ** 2, minlength=n))
        keep = place[at] >= 0
        at, row = at[keep], row[keep]
        if not len(at):
            continue
        # the cosine but for rounding, from the words' shares: only windows near COSINE or above it are projected
        head = np.flatnonzero(np.diff(row, prepend=-1))
        share = np.add.reduceat(shares[place[at]] * weight[at].astype(np.float32)[:, None], head, axis=0).max(axis=1)
        near = np.zeros(n, bool)
        near[row[head]] = share >= (COSINE - SLACK) * length[row[head]]
        if not near.any():
            continue
        keep = near[row]
        at, row = at[keep], row[keep]
        head = np.flatnonzero(np.diff(row, prepend=-1))
        latent = np.zeros((n, space.basis.shape[1]), np.float32)
        latent[row[head]] = np.add.reduceat(space.basis[place[at]] * weight[at].astype(np.float32)[:, None], head, axis=0)
        cosine = (latent @ vectors.T) / np.where(near, length, 1.0)[:, None]
        hit = np.flatnonzero(cosine.max(axis=1) >= COSINE)
        yield doc[own][hit], start[own][hit], end[own][hit], cosine[hit]


def leaks(w, space: Space, again: np.ndarray | None = None) -> dict[int, list[dict]]:
    """Per document (of the batch) its leaks, by item: the best region that passes the checks."""
    places: dict[tuple[int, int], list[tuple[int, int, float]]] = defaultdict(list)
    for doc, start, end, cosine, to in candidate_windows(w, space, again):
        for k, p in zip(*np.nonzero(cosine >= COSINE), strict=True):
            places[int(doc[k]), int(space.owner[to[p]])].append((int(start[k]), int(end[k]), float(cosine[k, p])))
    found: dict[int, list[dict]] = defaultdict(list)
    for (d, i), spans in sorted(places.items()):
        item = space.items[i]
        size, low, high = len(item.tokens), int(w.first[d]), int(w.first[d + 1])
        regions: list[list] = []
        for a, b, c in sorted(spans):
            if regions and a <= regions[-1][1] + STEP and b - regions[-1][0] <= 2 * size + WIDTH:
                regions[-1][1], regions[-1][2] = max(b, regions[-1][1]), max(c, regions[-1][2])
            else:
                regions.append([a, b, c])
        best = None
        for a, b, c in regions:
            a, b = max(low, a - size), min(high, b + size)
            part = w.hash[a:b].tolist()
            cover = lcs(item.tokens, part) / size
            answer = lcs(item.answer, part) / max(1, len(item.answer))
            if cover >= COVER and answer >= ANSWER and (best is None or cover > best["cover"]):
                best = {"item_id": item.item_id, "start": a - low, "n_words": b - a, "similarity": c, "cover": cover, "answer": answer}
        if best:
            found[d].append(best)
    return found


def _search(spaces: list[Space], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()),
                               ("cover", pa.float64()), ("answer", pa.float64())]))
    for batch in batches:
        for part in slices(batch, batch.schema.names[-1], 1 << 20):
            w = words(part.column(part.num_columns - 1), plain=True)
            again = repeated(w.hash)
            found = [leaks(w, space, again) for space in spaces]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([[x for f in found for x in f.get(k, [])] for k in range(part.num_rows)], kind)],
                                             names=[*part.schema.names[:-1], "leaks"])


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: per benchmark item found in the text (item_id, start and n_words of the region in
    words, similarity, cover, answer).

    ``items``: item_id and text; null or wordless items are left out, of repeated ids each is searched. Null and
    empty texts have no leaks; rows are judged each, in whole texts; a column named ``leaks`` is replaced, others may have
    any names; a block's item passages are one matrix on the driver, so an item should have some ten thousand words at most; empty
    tables give no rows or no leaks. The corpus frequencies cover all rows of ``docs``.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "leaks"]
    out = docs.select(*(f"`{c}`" for c in kept), F.array().cast(f"array<{LEAK}>").alias("leaks"))
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator()
    idf, spaces = None, []
    for group in passes(blocks((int(r.item_id), r.text) for r in rows)):
        if idf is None:
            idf, _ = inverse_frequencies(texts)
        grams, n = corpus_grams(texts, [vocabulary_of(own) for own in group], idf)
        spaces += [latent_space(c, n, own, idf) for c, own in zip(grams, group, strict=True)]
        if len(spaces) >= SPACES:
            out, spaces = _searched(out, spaces, kept, text), []
    return _searched(out, spaces, kept, text) if spaces else out


def passes(parts: Iterator[list[tuple[int, str]]]) -> Iterator[list[list[tuple[int, str]]]]:
    """Blocks of items whose A'A one pass over the corpus sums: ENTRIES entries and SPACES blocks at most, or one block."""
    group, size = [], 0
    for own in parts:
        entries = len(vocabulary_of(own)) ** 2
        if group and (size + entries > ENTRIES or len(group) == SPACES):
            yield group
            group, size = [], 0
        group.append(own)
        size += entries
    if group:
        yield group


def blocks(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Items with words, those shorter than WIDTH words apart, in blocks of at most BLOCK items and RANK passages; an
    item with more is a block of its own."""
    own, size = {True: [], False: []}, {True: 0, False: 0}
    for item_id, text in items:
        n = len(_tokens(text))
        count, short = len(passages(np.array([0, n]), ITEM_STEP)[0]), n < WIDTH
        if own[short] and count and (len(own[short]) == BLOCK or size[short] + count > RANK):
            yield own[short]
            own[short], size[short] = [], 0
        if count:
            own[short].append((item_id, text))
            size[short] += count
    yield from (x for x in own.values() if x)


def _searched(out: DataFrame, spaces: list[Space], kept: list[str], text: str) -> DataFrame:
    """``out`` with the leaks of the items of ``spaces`` added to its ``leaks``."""
    before, whole = unused("before", [*kept, "leaks"]), unused("whole", [*kept, "leaks"])
    source = out.withColumnRenamed("leaks", before).select(*(F.col(f"`{c}`") for c in kept), before, F.col(f"`{text}`").alias(whole))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return (source.mapInArrow(partial(_search, spaces), f"{fields}leaks array<{LEAK}>")
            .select(*(F.col(f"`{c}`") for c in kept), F.concat(before, "leaks").alias("leaks")))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every document and benchmark item found in it."""
    found = find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")

"""Packing by lexical retrieval: sequences are filled with a seed's BM25 neighbours.

Documents are dealt by content into shards of a bounded number of documents: a tree of principal
directions, fitted on the moments of all documents, orders their TF-IDF sketches, equal texts lie side by side,
and Spark cuts this order into even ranges (within a hot group too). Each shard has its own inverted
index over full 64-bit word hashes; frequencies and the mean length are those of the whole corpus. A document's full
windows are sequences of their own; its remainder waits in the index. The longest unused remainder
seeds a window, all its words query the index, and its best unused neighbours fill the window:
those that fit whole first, then the best of the others is cut to fill it. Only a shard's last sequence can need
padding.

What lies in another shard is not found. Up to ``SHARD_DOCS`` documents, retrieval is over all rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, bytes_of, read, slices
from vellum.llm.hashing import U, words

#: Documents of one shard, about: what one task's index holds.
SHARD_DOCS = 10_240
#: Words whose frequency in the corpus every shard knows: the most frequent ones. For a rarer word, a shard's own
#: count stands in, which is at most that much too low (the idf of rare words hardly depends on it).
FREQUENT = 1 << 18
#: Words of more documents of a shard than this (and than a twentieth of them) are columns of a matrix; so many seeds ask at once.
OFTEN, SEEDS = 512, 64
#: Entries of the index that are weighted at a time, so that its building needs little more memory than it.
PART = 1 << 18
#: Neighbours that are looked at together: those that fit whole go before one is cut.
NEAR = 10
#: The deal: hashed terms, dimensions of a sketch, the corpus' main axes that the tree sees, its greatest depth.
TERMS, DIMS, AXES, DEPTH = 1 << 16, 256, 32, 10
#: Sketches are whole numbers in units of 1 / ``UNIT``, so that sums over the corpus are exact in any order; documents that
#: a task sums at a time.
UNIT, BLOCK = 4096, 1 << 12
K1, B = 1.2, 0.75


#: White space, as the usual pattern has it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def runs_of_space(texts: list[str]) -> np.ndarray:
    """Whether a text may hold two white-space characters in a row: any with two of ASCII, or with another that may be white space."""
    data, offsets = bytes_of(pa.array(texts, pa.string()))
    space, out = (data == 32) | ((data >= 9) & (data <= 13)), np.zeros(len(texts), bool)
    wide = np.flatnonzero((data >= 0xC2) & (data <= 0xE3))
    second = data[wide + 1]  # of two bytes or three: one follows
    lead = data[wide]
    wide = wide[((lead == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((lead == 0xE1) & (second == 0x9A)) | ((lead == 0xE2) & (second >> 1 == 0x40))
                | ((lead == 0xE3) & (second == 0x80))]
    two, edges = space[1:] & space[:-1], offsets[1:-1]
    two[edges[(edges > 0) & (edges < len(data))] - 1] = False
    at = np.concatenate([np.flatnonzero(two), wide])
    out[np.searchsorted(offsets, at, side="right") - 1] = True
    return out


class Encoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library.

    If the file is of the plain kind (no normaliser, the usual pre-tokenisation, merges in the
    order of their ids), ``tiktoken`` gives the same ids several times faster; else the file's own
    library is used. The file's special tokens count in texts, as they do there.
    """

    #: The usual pattern ('s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+) without backtracking.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    #: The same where no two white-space characters stand in a row: nothing to look ahead for, which is twice as fast.
    SINGLE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
    #: Of a run of white space what is a token's text by itself.
    RUNS = re.compile(f"[{SPACE}]+(?=[{SPACE}][^{SPACE}])|[{SPACE}]{{2,}}\\Z")

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast, self.special = None, [t["content"] for t in spec["added_tokens"]]
        if self.plain(spec):
            import tiktoken

            letters = self.byte_letters()
            ranks = {bytes(letters[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.special}
            self.fast, self.single = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks,
                                                        special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})
                                      for pattern in (self.PATTERN, self.SINGLE))
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)

    @staticmethod
    def byte_letters() -> dict[str, int]:
        """The printable letter that stands for each byte in the vocabulary."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    @staticmethod
    def plain(spec: dict) -> bool:
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return False
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            return False
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            return False
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        return all(a < b for a, b in zip(merged, merged[1:], strict=False))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast is None:
            return [np.array(e.ids, np.uint32) for e in self.slow.encode_batch(texts, add_special_tokens=False)]
        return [self.one(t, r) for t, r in zip(texts, runs_of_space(texts).tolist(), strict=True)]

    def one(self, text: str, runs: bool = True) -> np.ndarray:
        """``runs``: whether the text may hold two white-space characters in a row."""
        if any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        if not runs:
            return self.single.encode_to_numpy(text, disallowed_special=())
        # a run is a token of its own but for its last character, at the text's end with it
        out, start = [], 0
        for run in self.RUNS.finditer(text):
            out += [self.single.encode_to_numpy(text[start:run.start()], disallowed_special=()), self.fast.encode_to_numpy(run[0], disallowed_special=())]
            start = run.end()
        out.append(self.single.encode_to_numpy(text[start:], disallowed_special=()))
        return np.concatenate(out) if len(out) > 1 else out[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def coded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and of every value its number among them (int32), without a sort of all."""
    found = pa.array(values).dictionary_encode()
    own = found.dictionary.to_numpy()
    order = np.argsort(own)
    number = np.empty(len(own), np.int32)
    number[order] = np.arange(len(own), dtype=np.int32)
    return own[order], number[found.indices.to_numpy()]


def term_counts(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, word hash, times it occurs) of every text's distinct words, text by text, and the texts' word counts."""
    w = words(col, lower=True)
    word, total = w.hash, np.diff(w.first)
    edges = w.first.tolist()
    for a, b in zip(edges, edges[1:], strict=False):
        word[a:b].sort()
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    new[w.first[:-1][total > 0]] = True
    at = np.flatnonzero(new)
    return np.repeat(np.arange(len(total)), total)[at], word[at], np.diff(np.append(at, len(new))), total


def packed_terms(counts) -> pa.Array:
    """Of every text the hashed terms of its distinct words, then how often each occurs (both 16 bits, more as 65535)."""
    doc, word, times, total = counts
    size = np.bincount(doc, minlength=len(total))
    ends = 2 * np.cumsum(size)
    own = np.empty(2 * len(word), "<u2")
    at = np.arange(len(word)) + np.repeat(ends // 2 - size, size)
    own[at] = word >> U(48)
    own[at + np.repeat(size, size)] = np.minimum(times, 65535)
    offsets = np.concatenate([[0], 2 * ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(total), [None, pa.py_buffer(offsets), pa.py_buffer(own)])


_LOGS = np.log1p(np.arange(1 << 16, dtype="<u2"))


def sketch(terms: list[bytes], weight: np.ndarray) -> np.ndarray:
    """A vector of ``DIMS`` whole numbers, of length ``UNIT``, for every text: its weighted terms, added up at hashed places
    with hashed signs."""
    size = np.array([len(t) for t in terms], np.int64) // 4
    flat = np.frombuffer(b"".join(terms), "<u2")
    doc = np.repeat(np.arange(len(terms)), size)
    at = np.arange(len(doc)) + np.repeat(np.cumsum(size) - size, size)
    term, times = flat[at], flat[at + np.repeat(size, size)]
    signed = (1.0 - 2.0 * (np.arange(TERMS) >> 8 & 1)) * weight
    x = np.bincount(doc * DIMS + (term & DIMS - 1), signed[term] * _LOGS[times], minlength=len(terms) * DIMS).reshape(-1, DIMS)
    return np.rint(x * (UNIT / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)))


class Tree:
    """Halves the corpus at the mean along its principal direction, level by level; leaves from left to right are an order in
    which like texts are near each other. It sees sketches (``weight`` of their terms) on ``axes``."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray | None = None) -> None:
        self.weight, self.axes, self.depth = weight, axes, 0
        self.way, self.cut = np.zeros((0, AXES)), np.zeros(0)

    def seen(self, terms: list[bytes]) -> np.ndarray:
        """Whole numbers: the sketch on the axes, or before there are any the sketch."""
        x = sketch(terms, self.weight)
        return x if self.axes is None else np.rint(x @ self.axes)

    def leaf(self, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + ((y * self.way[node]).sum(1) > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def place(self, terms: list[bytes]) -> np.ndarray:
        """The leaf, and below it the signs on the first 16 axes."""
        y = self.seen(terms)
        return (self.leaf(y) << 16) + ((y[:, :16] > 0) << np.arange(16)).sum(1)

    def grow(self, moments) -> None:
        """One level more, from rows (leaf, cell, value): the leaves' ``_sums``."""
        level = 1 << self.depth
        way, cut = np.zeros((level, AXES)), np.zeros(level)
        sums = np.zeros((level, AXES + 1, AXES + 1))
        sums[moments.leaf.to_numpy(int), moments.cell.to_numpy(int) // (AXES + 1), moments.cell.to_numpy(int) % (AXES + 1)] = moments.value.to_numpy(float)
        for k in np.flatnonzero(sums[:, 0, 0] > 1):
            mean, spread = spread_of(sums[k])
            way[k] = np.linalg.eigh(spread)[1][:, -1]
            cut[k] = mean @ way[k]
        self.way, self.cut, self.depth = np.concatenate([self.way, way]), np.concatenate([self.cut, cut]), self.depth + 1


def spread_of(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, from the upper half of the sums of products of (1, y)."""
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    upper = np.triu(sums[1:, 1:])
    return mean, (upper + np.triu(upper, 1).T) / n - np.outer(mean, mean)


def _sums(see, leaf, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, cell, value): of each leaf the sums of products of (1, y) with itself, the upper half, once a task."""
    total: dict[int, np.ndarray] = {}
    waiting, size, side = [], 0, 1

    def add(y: np.ndarray) -> None:
        one, where = np.concatenate([np.ones((len(y), 1)), y], axis=1), leaf(y)
        order = np.argsort(where, kind="stable")
        own, first = np.unique(where[order], return_index=True)
        for k, rows in zip(own.tolist(), np.split(one[order], first[1:]), strict=True):
            total[k] = total.get(k, 0.0) + (rows.T @ rows)[np.triu_indices(one.shape[1])]

    for batch in batches:
        if batch.num_rows:
            waiting.append(see(batch.column(0).to_pylist()))
            size, side = size + batch.num_rows, waiting[0].shape[1] + 1
        if size >= BLOCK:
            add(np.concatenate(waiting))
            waiting, size = [], 0
    if waiting:
        add(np.concatenate(waiting))
    row, column = np.triu_indices(side)
    for k, value in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k)), pa.array(row * side + column), pa.array(value.astype(np.int64))],
                                         names=["leaf", "cell", "value"])


def _coordinates(tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            y = tree.seen(batch.column(0).to_pylist()).astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in y], pa.binary())], names=["y"])


def _read_coordinates(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i2").reshape(-1, AXES).astype(float)


def _one_leaf(y: np.ndarray) -> np.ndarray:
    return np.zeros(len(y), np.int64)


def fit_tree(terms: DataFrame, weight: np.ndarray, depth: int, scratch: Scratch) -> Tree:
    """The tree of all rows (terms): a pass for the corpus' main axes, one for the coordinates on them and one a level.
    To the driver come sums alone: 33,153 numbers for the axes, 561 a leaf."""
    def moments(rows: DataFrame, see, leaf):
        return (rows.mapInArrow(partial(_sums, see, leaf), "leaf bigint, cell bigint, value bigint")
                .groupBy("leaf", "cell").agg(F.sum("value").alias("value")).toPandas())

    tree, sums = Tree(weight), np.zeros((DIMS + 1, DIMS + 1))
    found = moments(terms, tree.seen, _one_leaf)
    sums.flat[found.cell.to_numpy(int)] = found.value.to_numpy(float)
    tree = Tree(weight, np.linalg.eigh(spread_of(sums)[1])[1][:, :-AXES - 1:-1])
    coordinates = scratch.save(terms.mapInArrow(partial(_coordinates, tree), "y binary"), "coordinates")
    for _ in range(depth):
        tree.grow(moments(coordinates, _read_coordinates, tree.leaf))
    return tree


_SURVEY = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("terms", pa.binary()), ("row", pa.int64()), ("digest", pa.int64()),
                     ("words", pa.binary()), ("length", pa.int64())])
#: Words of one row of the survey; words of the corpus whose counts a task sums, about.
WORDS, PART_WORDS = 1 << 16, 1 << 22
_COUNTED = np.dtype([("word", "<i8"), ("n", "<i8")])


def counted(words: list[np.ndarray], more: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, ascending, and how often each occurs in ``words``, added to (words, times) ``more``."""
    word = np.concatenate(words)
    word.sort()
    at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    word, n = word[at], np.diff(np.append(at, len(word)))
    if more is None:
        return word, n
    word, n = np.concatenate([more[0], word]), np.concatenate([more[1], n])
    order = np.argsort(word, kind="stable")
    word = word[order]
    at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
    return word[at], np.add.reduceat(n[order], at) if len(at) else n


def _survey(sketched: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (row, doc_id, text, digest) with their terms if ``sketched``, and every task's words with the documents that hold
    each (``words``: ``WORDS`` of them a row); a last row sums the words of the texts."""
    def rows(**given) -> pa.RecordBatch:
        n = len(next(iter(given.values())))
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in _SURVEY],
                                          schema=_SURVEY)

    def written(word: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(word), WORDS):
            own = np.empty(min(WORDS, len(word) - at), _COUNTED)
            own["word"], own["n"] = word[at:at + WORDS].view(np.int64), n[at:at + WORDS]
            yield rows(words=[own.tobytes()])

    waiting, size, found, length = [], 0, None, 0
    for batch in batches:
        for part in slices(batch, "text"):
            counts = term_counts(part.column(2))
            yield rows(doc_id=part.column(1), text=part.column(2), row=part.column(0), digest=part.column(3),
                       **({"terms": packed_terms(counts)} if sketched else {}))
            waiting.append(counts[1])
            size, length = size + len(counts[1]), length + int(counts[3].sum())
            if size > 1 << 20:
                found = counted(waiting, found)
                waiting, size = [], 0
                if len(found[0]) > 1 << 19:
                    yield from written(*found)
                    found = None
    if waiting:
        found = counted(waiting, found)
    if found:
        yield from written(*found)
    yield rows(length=np.array([length]))


def _dealt(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, words): the survey's ``words`` cut at ``parts`` (a power of two) even ranges of the hash."""
    for batch in batches:
        for cell in batch.column(0):
            own = np.frombuffer(cell.as_buffer(), _COUNTED)
            part = own["word"].view(np.uint64) >> U(32) >> U(33 - parts.bit_length())
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            pieces = [own[a:b].tobytes() for a, b in zip(at, [*at[1:], len(own)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), pa.array(pieces, pa.binary())], names=["part", "words"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the words that are in more than one document; all ``words`` of a word are in this task."""
    cells = [np.frombuffer(cell.as_buffer(), _COUNTED) for batch in batches for cell in batch.column(0)]
    if cells:
        own = np.concatenate(cells)
        own = own[np.argsort(own["word"])]
        at = np.flatnonzero(np.append(True, own["word"][1:] != own["word"][:-1]))
        n = np.add.reduceat(own["n"], at)
        word, n = own["word"][at][n > 1], n[n > 1]
        for k in range(0, len(word), WORDS):
            yield pa.RecordBatch.from_arrays([pa.array(word[k:k + WORDS]), pa.array(n[k:k + WORDS])], names=["word", "n"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of the survey's ``words``: the sums of a task."""
    total = np.zeros(TERMS)
    for batch in batches:
        for cell in batch.column(0):
            own = np.frombuffer(cell.as_buffer(), _COUNTED)
            total += np.bincount(own["word"].view(np.uint64) >> U(48), own["n"], minlength=TERMS)
    term = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term].astype(np.int64))], names=["term", "n"])


class Corpus:
    """What every shard knows of the corpus: documents, mean length, frequencies of its most frequent words."""

    def __init__(self, n: int, mean: float, word: np.ndarray, frequency: np.ndarray) -> None:
        order = np.argsort(word)
        self.n, self.mean, self.word, self.frequency = n, max(mean, 1.0), word[order], frequency[order]

    def idf(self, word: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Of words that occur in ``here`` documents of a shard."""
        f = here.astype(float)
        if len(self.word):
            at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
            f = np.where(self.word[at] == word, self.frequency[at], f)
        return np.log1p((self.n - f + 0.5) / (f + 0.5))


class Retrieval:
    """BM25 over the documents of one shard, every word of the seed asking, with the corpus' idf and mean length.
    Document d has the text ``member[d]``; ``text`` rises, and a text that many documents have is
    indexed once. Words of one document alone find nothing but it and are left out. The words of many
    documents are columns of a matrix, and a block of seeds asks for them in one product; the others have postings."""

    def __init__(self, text: np.ndarray, word: np.ndarray, times: np.ndarray, length: np.ndarray, member: np.ndarray, corpus: Corpus) -> None:
        texts = len(length)
        own, term = coded(word)
        copies, here = np.bincount(member, minlength=texts), np.zeros(len(own))
        for at in range(0, len(term), PART):
            here += np.bincount(term[at:at + PART], copies[text[at:at + PART]], minlength=len(own))
        idf = corpus.idf(own, here)
        shared = here[term] > 1
        text, term, times = text[shared].astype(np.int32, copy=False), term[shared], times[shared].astype(np.int32, copy=False)
        impact, norm = np.empty(len(term)), K1 * (1 - B + B * length / corpus.mean)
        for at in range(0, len(term), PART):
            part = slice(at, at + PART)
            impact[part] = idf[term[part]] * times[part] * (K1 + 1) / (times[part] + norm[text[part]])
        del shared, times
        # the matrix: a row per text that some document still has
        often = np.flatnonzero(here > max(OFTEN, len(member) // 20))
        place = np.full(len(own), -1, np.int32)
        place[often] = np.arange(len(often))
        column = place[term]
        dense = column >= 0
        self.matrix = np.zeros((texts, len(often)), np.float32)
        self.matrix[text[dense], column[dense]] = impact[dense]
        text, term, impact = text[~dense], term[~dense], impact[~dense]
        del column, dense
        self.member, self.row = member, member
        self.query, self.first = term, np.searchsorted(text, np.arange(texts + 1))
        key = term.astype(np.int64) << 32 | np.arange(len(term))
        key.sort()
        self.start = np.searchsorted(key >> 32, np.arange(len(own) + 1))
        key &= 0xFFFFFFFF
        self.text, self.impact = text[key], impact[key]
        self.asked: dict[int, np.ndarray] = {}

    def ask(self, seeds: np.ndarray) -> None:
        """Scores of the matrix's words, for seeds that are not used yet."""
        if self.matrix.shape[1]:
            wanted = (self.matrix[self.row[seeds]] > 0).astype(np.float32)
            self.asked = dict(zip(seeds.tolist(), wanted @ self.matrix.T, strict=True))

    def scores(self, seed: int) -> np.ndarray:
        """Of every document for the seed's words; of a forgotten one, any number."""
        own = self.member[seed]
        term = self.query[self.first[own]:self.first[own + 1]]
        start = self.start[term]
        size = self.start[term + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        found = np.bincount(self.text[at], self.impact[at], minlength=len(self.matrix))
        if self.matrix.shape[1]:
            if seed not in self.asked:
                self.ask(np.array([seed]))
            found = found + self.asked[seed]
        return found[self.row]

    def forget(self, unused: np.ndarray) -> None:
        """Texts that no unused document has leave the index."""
        rows = len(self.matrix)
        stay = np.bincount(self.row, unused, minlength=rows) > 0
        number = np.cumsum(stay, dtype=np.int32) - 1
        kept = stay[self.text]
        self.start = np.concatenate([[0], np.cumsum(kept)])[self.start]
        self.text, self.impact = number[self.text[kept]], self.impact[kept]
        self.matrix, self.row, self.asked = self.matrix[stay], np.maximum(number[self.row], 0), {}


def fill(left: np.ndarray, found: Retrieval, width: int) -> list[list[tuple[int, int]]]:
    """Sequences of (document, ids taken from the front of what it has left). ``left``: lengths of the
    documents' remainders, below ``width``. Neighbours go down the whole ranking until the sequence is full."""
    left, out = left.copy(), []
    indexed = len(left)
    waiting = int(np.count_nonzero(left))
    order = np.argsort(-left, kind="stable")
    for turn, seed in enumerate(order.tolist()):
        if not left[seed]:
            continue
        window, room = [(seed, int(left[seed]))], width - int(left[seed])
        waiting -= 1
        if 2 * waiting < indexed:
            found.forget(left > 0)
            indexed = waiting
        if room and waiting:
            if seed not in found.asked:
                coming = order[turn:turn + 2 * SEEDS]
                found.ask(coming[left[coming] > 0][:SEEDS])
            score = found.scores(seed)
        left[seed] = 0
        while room and waiting:
            s = np.where(left > 0, -score, 1.0)
            near = np.argpartition(s, NEAR)[:NEAR] if len(s) > NEAR else np.arange(len(s))
            near = near[np.lexsort((near, s[near]))]
            near = near[left[near] > 0]
            for whole in (True, False):
                for d in near.tolist():
                    take = min(room, int(left[d]))
                    if take and (take == left[d] or not whole):
                        window.append((d, take))
                        left[d] -= take
                        room -= take
                        waiting -= not left[d]
        out.append(window)
    return out


class _Shard:
    """Documents of one shard as they arrive; full windows leave at once. Equal texts arrive one after
    another and are encoded and indexed once."""

    def __init__(self, number: int, width: int) -> None:
        self.number, self.width, self.sequence = number, width, number << 32
        self.docs: list[tuple] = []  # doc_id, tokens, start of the remainder, the remainder
        self.terms: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.lengths: list[np.ndarray] = []
        self.member: list[int] = []
        self.texts, self.last, self.whole = 0, None, np.zeros(0, np.uint32)

    def add(self, ids: list[int | None], col: pa.Array, encode: Encoder) -> Iterator[tuple]:
        texts = col.to_pylist()
        new = [k for k, t in enumerate(texts) if t != (texts[k - 1] if k else self.last)]
        tokens = dict(zip(new, encode([texts[k] for k in new]), strict=True))
        text, word, times, total = term_counts(col.take(pa.array(new, pa.int64())))
        self.terms.append(((text + self.texts).astype(np.int32), word, times.astype(np.int32)))
        self.lengths.append(total)
        self.last = texts[-1]
        for k, doc_id in enumerate(ids):
            if k in tokens:
                self.whole = np.append(tokens[k], np.uint32(0))
                self.texts += 1
            self.member.append(self.texts - 1)
            full = len(self.whole) // self.width * self.width
            for at in range(0, full, self.width):
                yield self.piece(doc_id, self.whole, at, self.whole[at:at + self.width], 0)
                self.sequence += 1
            self.docs.append((doc_id, len(self.whole), full, self.whole[full:].copy()))

    def piece(self, doc_id, whole, start, ids, offset, size=None) -> tuple:
        return (doc_id, start, len(ids), size or len(whole), self.sequence, offset, ids.astype("<u4").tobytes())

    def finish(self, corpus: Corpus) -> Iterator[tuple]:
        text, word, times = (np.concatenate(x) for x in zip(*self.terms, strict=True))
        self.terms = []
        found = Retrieval(text, word, times, np.concatenate(self.lengths), np.array(self.member), corpus)
        del text, word, times
        used = [0] * len(self.docs)
        for window in fill(np.array([len(d[3]) for d in self.docs]), found, self.width):
            offset = 0
            for d, take in window:
                doc_id, size, start, rest = self.docs[d]
                yield self.piece(doc_id, rest, start + used[d], rest[used[d]:used[d] + take], offset, size)
                used[d] += take
                offset += take
            self.sequence += 1


def _pack(tokenizer: str, width: int, corpus: Corpus, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: (shard, doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    encode, shard, out, size = encoder(tokenizer), None, [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for part in slices(batch, "text"):
            numbers = part.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                run, own = part.slice(a, b - a), int(numbers[a])
                pieces = []
                if shard is None or own != shard.number:
                    if shard is not None:
                        pieces += shard.finish(corpus)
                    shard = _Shard(own, width)
                pieces += shard.add(run.column(1).to_pylist(), run.column(2), encode)
                for p in pieces:
                    out.append(p)
                    size += len(p[-1])
                    if size > 4 << 20:
                        yield flush()
                        out, size = [], 0
    if shard is not None:
        out += shard.finish(corpus)
    if out:
        yield flush()


def deal(docs: DataFrame, scratch: Scratch, shard_docs: int) -> tuple[DataFrame, Corpus]:
    """(shard, doc_id, text) of rows (doc_id, text), shard by shard, and the corpus' figures."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("text").alias("digest"))
    n = docs.count()
    shards = max(1, -(-n // shard_docs))
    depth = min(DEPTH, 2 + (shards - 1).bit_length()) if shards > 1 else 0
    survey = scratch.save(source.mapInArrow(partial(_survey, depth > 0), "doc_id bigint, text string, terms binary, row bigint, "
                                            "digest bigint, words binary, length bigint"), "survey", **{"parquet.enable.dictionary": "false"})
    found = survey.where("words is not null").select("words")
    place = F.lit(0).cast("bigint")
    if depth:
        seen = found.mapInArrow(_terms, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
        weight, f = np.zeros(TERMS), seen.n.to_numpy(float)
        weight[seen.term.to_numpy(int)] = np.log1p((n - f + 0.5) / (f + 0.5)).clip(0)
        tree = fit_tree(survey.where("row is not null").select("terms"), weight, depth, scratch)
        place = F.pandas_udf(lambda terms: pd.Series(tree.place(terms.tolist())), "bigint")("terms")
    length = survey.agg(F.sum("length")).first()[0] or 0
    parts = 1 << max(4, (length // PART_WORDS).bit_length())
    counts = scratch.save(found.mapInArrow(partial(_dealt, parts), "part bigint, words binary").repartition(parts, "part").select("words")
                          .mapInArrow(_summed, "word bigint, n bigint"), "counts")
    # 64 classes of frequency an octave, some thousand rows at most; then the classes that hold FREQUENT words or fewer
    octave = F.floor(F.log2("n") * 64)
    classes = counts.groupBy(octave.alias("c")).agg(F.count("*").alias("words")).toPandas().sort_values("c", ascending=False)
    least = classes.c[classes.words.cumsum() <= FREQUENT].min()
    top = counts.where(octave >= F.lit(int(least)) if least == least else F.lit(False)).toPandas()  # no class: least is NaN
    corpus = Corpus(n, length / max(1, n), top.word.to_numpy(np.int64).view(np.uint64), top.n.to_numpy(float))
    order = [F.col("place"), F.col("digest"), F.col("row")]
    placed = survey.where("row is not null").select(place.alias("place"), "doc_id", "text", "digest", "row")
    dealt = placed.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return dealt.select(F.spark_partition_id().cast("bigint").alias("shard"), "doc_id", "text"), corpus


def pack_documents(docs: DataFrame, tokenizer: str, width: int = 1024, shard_docs: int = SHARD_DOCS, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Pieces: doc_id, start (the document's ids before it), length, doc_tokens, sequence_id, offset (in its
    sequence, gapless from 0), ids (little-endian unsigned 32-bit).

    A document is the ids of its text and then id 0. Every id lies in exactly one piece; a sequence
    has ``width`` ids, but for the last of a shard, which is to be padded. Null texts are empty (one id);
    repeated rows are documents of their own, dealt over shards where they fill more than one; a null id stays
    null; ties go to the row that comes first in the shard; other columns are ignored; an empty table gives none. Long
    documents are encoded whole and cut into full windows.
    """
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt, corpus = deal(source, Scratch(docs.sparkSession, "packing"), shard_docs)
    return dealt.mapInArrow(partial(_pack, tokenizer, width, corpus),
                            "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

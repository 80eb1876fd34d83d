"""Text embedding.

``embed(df, col, embedder)`` appends ``embedding ARRAY<FLOAT>``. The default embedder is a
hashed bag of words: lower-cased letter/digit tokens, bucket = first 8 hex digits of the
token's MD5 modulo the width, term counts, L2-normalised. It needs no model and SQL can
state it, so retrieval over text has an exact oracle. Real models plug in as
``model_embedder(load)``: an iterator pandas UDF that loads the model once per Python
worker and encodes Arrow batches. ``mllib`` runs RegexTokenizer -> HashingTF -> Normalizer
in the JVM (murmur3 buckets, faster, no SQL twin).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum import config
from vellum.session import bounded_batches

VECTOR = T.ArrayType(T.FloatType())
TOKEN_PATTERN = r"[^\p{L}\p{N}]+"


def bucket_of(token: str, dim: int) -> int:
    return int.from_bytes(hashlib.md5(token.encode("utf-8")).digest()[:4], "big") % dim


#: Tokens whose bucket a process remembers, and texts that are counted at a time: a task's memory grows with neither.
_CACHE_LIMIT, SLICE = 1 << 16, 512
#: The buckets of tokens that this process has met, by width.
_BUCKETS: dict[int, dict] = {}


def hashed_vector(text: str | None, dim: int) -> np.ndarray:
    """The hashed embedding of one text (see :func:`hashed_matrix`)."""
    return hashed_matrix(pa.array([text], type=pa.string()), dim)[0]


#: Bytes that are no ASCII letter or digit; those of longer characters are looked at as characters.
_ASCII = bytes(1 if c < 128 and not chr(c).isalnum() else 0 for c in range(256))
_OTHER: dict[int, bool] = {}


def _separates(points: np.ndarray) -> np.ndarray:
    """Which code points beyond ASCII separate tokens, as the pattern has it; each is asked for once a process."""
    distinct, which = np.unique(points, return_inverse=True)
    new = [c for c in distinct.tolist() if c not in _OTHER]
    if new:
        _OTHER.update(zip(new, pc.match_substring_regex(pa.array(map(chr, new), pa.string()), TOKEN_PATTERN).to_pylist(), strict=True))
    return np.array([_OTHER[c] for c in distinct.tolist()], bool)[which]


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts without nulls, and how many each text has: runs of letters and digits, as the split by
    ``TOKEN_PATTERN`` has them without the empty ones. The bytes are looked at once, not by a regex engine."""
    texts = texts.cast(pa.string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return pa.array([], pa.string()), np.zeros(n, np.int64)
    raw = texts.buffers()[2].to_pybytes()[ends[0]:ends[-1]] if ends[0] or ends[-1] != texts.buffers()[2].size else texts.buffers()[2].to_pybytes()
    ends = ends - ends[0]
    data = np.frombuffer(raw, np.uint8)
    between = np.frombuffer(bytearray(raw.translate(_ASCII)), np.bool_)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        more = (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0) + 1  # bytes that follow
        point = (data[lead] & (0x3F >> more)).astype(np.int64)
        for k in (1, 2, 3):
            own = more >= k
            point[own] = point[own] << 6 | data[lead[own] + k] & 0x3F
        apart = _separates(point)
        for k in range(4):
            between[lead[apart & (more >= k)] + k] = True
    inside = ~between
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = np.unique(ends[(ends > 0) & (ends < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # one text ends and the next one begins inside a run
    if len(cut):
        start, stop = np.sort(np.concatenate([start, cut]), kind="stable"), np.sort(np.concatenate([stop, cut]), kind="stable")
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(stop - start, out=offsets[1:])
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return tokens, np.diff(np.searchsorted(start, ends))


def hashed_matrix(texts: pa.Array, dim: int, cache: dict | None = None) -> np.ndarray:
    """The hashed embedding of a whole Arrow batch at once: lower-casing runs in Arrow's C++ kernels, tokens are cut
    from the bytes by the classes of RE2 (the same regex engine as DuckDB), every distinct
    token of the batch is hashed once, and one ``bincount`` fills the batch matrix."""
    n = len(texts)
    cache = {} if cache is None else cache
    if len(cache) > _CACHE_LIMIT:
        cache.clear()
    flat, counts = _tokens(pc.utf8_lower(pc.fill_null(texts, "")))
    m = np.zeros((n, dim), dtype=np.float64)
    if len(flat):
        enc = pc.dictionary_encode(flat)
        uniq = enc.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(cache.get, uniq))
        if None in known:
            for j, tok in enumerate(uniq):
                if known[j] is None:
                    known[j] = cache[tok] = bucket_of(tok, dim)
        lin = np.repeat(np.arange(n) * dim, counts) + np.array(known, np.int64)[enc.indices.to_numpy()]
        m = np.bincount(lin, minlength=n * dim).reshape(n, dim).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", m, m))
    norms[norms == 0] = 1.0
    return (m / norms[:, None]).astype(np.float32)


def hashed_slices(texts: pa.Array, dim: int, cache: dict) -> np.ndarray:
    """:func:`hashed_matrix` of a batch of any size, a slice at a time."""
    out = np.empty((len(texts), dim), np.float32)
    for at in range(0, len(texts), SLICE):
        out[at:at + SLICE] = hashed_matrix(texts.slice(at, SLICE), dim, cache)
    return out


def matrix_to_lists(m: np.ndarray) -> pa.Array:
    n, dim = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)),
                                    pa.array(m.reshape(-1)))


def hashed_embedder(dim: int = config.VECTOR_WIDTH) -> Callable[[Column], Column]:
    if hasattr(F, "arrow_udf"):
        @F.arrow_udf(VECTOR)
        def enc(texts: pa.Array) -> pa.Array:  # not by batches: those run alone, this one in a worker with what reads it
            return matrix_to_lists(hashed_slices(texts, dim, _BUCKETS.setdefault(dim, {})))
        return enc

    @F.pandas_udf(VECTOR)  # pragma: no cover - before Spark 4.1
    def enc_pd(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for batch in texts:
            yield pd.Series(list(hashed_slices(pa.array(batch, type=pa.string()), dim, cache)))

    return enc_pd


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]],
                   normalize: bool = True) -> Callable[[Column], Column]:
    """Hook for real models: ``load()`` runs once per Python worker and returns
    ``encode(texts) -> (n, dim) array``."""
    @F.pandas_udf(VECTOR)
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            m = np.asarray(encode([t or "" for t in texts]), dtype=np.float64)
            if normalize:
                n = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, n, out=m.copy(), where=n > 0)
            yield pd.Series(list(m.astype(np.float32)))

    return enc


def embed(df: DataFrame, text: str = "text", out: str = "embedding",
          embedder: Callable[[Column], Column] | str | None = None,
          dim: int = config.VECTOR_WIDTH) -> DataFrame:
    """Append ``out`` = embedding of ``text``; ``embedder`` is a Column function, ``"hashed"``
    (default) or ``"mllib"``."""
    bounded_batches(df.sparkSession)
    if embedder is None or embedder == "hashed":
        return df.withColumn(out, hashed_embedder(dim)(F.col(text)))
    if embedder == "mllib":
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array
        tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}]+",
                             toLowercase=True)
        tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
        nm = Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)
        res = nm.transform(tf.transform(tok.transform(df.withColumn(
            text, F.coalesce(F.col(text), F.lit(""))))))
        return res.withColumn(out, vector_to_array("_nv", "float32")).drop("_tok", "_tf", "_nv")
    if isinstance(embedder, str):
        raise ValueError(f"unknown embedder: {embedder}")
    return df.withColumn(out, embedder(F.col(text)))

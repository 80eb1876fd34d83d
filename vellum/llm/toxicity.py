"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon, nearness of its words to second-person words,
capitals, punctuation and obfuscation rates. The lexicon is learned from the training rows:
words and word beginnings whose log odds of being in toxic texts are high. Words are
looked up as written and after undoing common obfuscation (digits and signs for letters, signs
inside words, drawn-out letters).

The trees (MLlib) are fitted on part of the training rows, the isotonic curve on the others.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, bounded_batches, read, unused

# Second-person words of the corpus' languages.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro".split())
_LEET = str.maketrans({"@": "a", "4": "a", "0": "o", "1": "i", "!": "i", "3": "e", "$": "s", "5": "s", "7": "t", "+": "t"})
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_SIGNS = re.compile(r"[^\w]+|_+")
_DRAWN = re.compile(r"(.)\1{2,}")
_MIXED = re.compile(r"[^\W\d_][\d@$!*#+]+[^\W\d_]")
PREFIXES = (4, 5, 6)

FEATURES = ("hit_rate", "hit_log", "distinct_hits", "weight_rate", "top_weight", "hidden_rate", "near_rate", "near_share",
            "person_rate", "capital_rate", "capital_word_rate", "exclaim_rate", "question_rate", "punct_rate", "mixed_rate",
            "drawn_rate", "digit_rate", "word_length", "log_words")
_CAPITALS = bytes(range(65, 91))
_PUNCT = b"!?.,;:\"'()[]{}-*#$%&|<>~^_/\\"


def forms(token: str) -> tuple[str, str]:
    """A lower-cased word without signs at its edges, and with its obfuscation undone."""
    plain = _EDGE.sub("", token)
    if plain.isalpha() and not _DRAWN.search(plain):
        return plain, plain
    return plain, _DRAWN.sub(r"\1", _SIGNS.sub("", plain.translate(_LEET)))


def entries(token: str) -> list[str]:
    """What a word may match in the lexicon: itself, undisguised, and its beginnings."""
    plain, clear = forms(token)
    found = [clear] if plain == clear else [plain, clear]
    return [x for x in found if len(x) > 2] + [f"{clear[:k]}-" for k in PREFIXES if len(clear) > k]


class _Codes(dict):
    """Code of a word, filled on first use: 1 lexicon, 2 only undisguised, 4 second person,
    8 mixed signs, 16 drawn out; times 32 plus the index of its weight."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.weights, self.index = lexicon, [0.0], {}

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:  # bounds the memory; the words are looked up anew
            self.clear()
        plain, clear = forms(token)
        best = max((self.lexicon.get(x, 0.0) for x in entries(token)), default=0.0)
        code = (best > 0) | 2 * (best > 0 and plain != clear) | 4 * (clear in SECOND_PERSON) | (
            8 * bool(_MIXED.search(token))) | 16 * bool(_DRAWN.search(plain))
        if best > 0:
            if clear not in self.index:
                self.index[clear] = len(self.weights)
                self.weights.append(best)
            code += 32 * self.index[clear]
        self[token] = code
        return code


def featurize(text: str, codes: _Codes) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; all 0 without a word."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, n)
    raw = text.encode("utf-8", "replace")
    hit = np.flatnonzero(code & 1)
    weight = np.array(codes.weights)[code[hit] >> 5] if len(hit) else np.zeros(0)
    person = np.flatnonzero(code & 4)
    near = 0
    if len(hit) and len(person):
        at = np.searchsorted(person, hit)
        gap = np.minimum(np.abs(person[np.minimum(at, len(person) - 1)] - hit), np.abs(person[np.maximum(at - 1, 0)] - hit))
        near = int((gap <= 5).sum())
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return [100 * len(hit) / n, math.log1p(len(hit)), float(len(np.unique(code[hit] >> 5))), 100 * float(weight.sum()) / n,
            float(weight.max(initial=0.0)), 100 * int((code & 2 > 0).sum()) / n, 100 * near / n, near / max(1, len(hit)),
            len(person) / n, capitals / len(raw), text.count("!!") / n, text.count("!") / n, text.count("?") / n,
            (len(raw) - len(raw.translate(None, _PUNCT))) / len(raw), int((code & 8 > 0).sum()) / n,
            int((code & 16 > 0).sum()) / n, (len(raw) - len(raw.translate(None, b"0123456789"))) / len(raw),
            len(raw) / n, math.log1p(n)]


def features(docs: DataFrame, lexicon: dict[str, float], text: str = "text") -> DataFrame:
    """``docs`` with ``features`` (array<double>) in place of the text; one narrow pass. Null texts count as empty; a
    column ``features`` is replaced; rows are read each, repeated or not."""
    kept = [c for c in docs.columns if c not in (text, "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [featurize(x or "", codes) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.list_(pa.float64()))],
                                                 names=[*part.schema.names[:-1], "features"])

    bounded_batches(docs.sparkSession)
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias("text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}features array<double>")


def learn_lexicon(train: DataFrame, size: int = 2000, share: float = 0.02) -> dict[str, float]:
    """Entries found in at least five toxic texts and in ``share`` of them, with their smoothed log
    odds where these exceed 2; the ``size`` of most evidence. The share keeps out what is
    peculiar to one group of copies. ``train``: text and label (0 or 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted({e for w in set((text or "").lower().split()) for e in entries(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([label] * len(found), pa.int32())],
                                                 names=["entry", "label"])

    bad, good = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    n1, n0 = (train.select(F.count_if(F.col("label") == k)).first()[0] for k in (1, 0))
    odds = F.log((F.col("bad") + 0.1) / (n1 + 1)) - F.log((F.col("good") + 0.1) / (n0 + 1))
    found = (train.select("text", F.col("label").cast("int").alias("label")).mapInArrow(run, "entry string, label int")
             .groupBy("entry").agg(bad.alias("bad"), good.alias("good")).where(F.col("bad") >= max(5, share * n1))
             .withColumn("odds", odds).where("odds > 2")
             .orderBy(F.desc(F.col("bad") * F.col("odds")), "entry").limit(size).select("entry", "odds").collect())
    return {r.entry: float(r.odds) for r in found}


class ToxicityModel:
    """Lexicon, trees and calibration curve; ``score`` adds ``score`` to documents."""

    def __init__(self, lexicon: dict[str, float], trees, curve, rate: float) -> None:
        self.lexicon, self.trees, self.curve, self.rate = lexicon, trees, curve, rate

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``score`` (0 to 1) and leaves the text out; without a fitted model (one class
        only among the training rows) the rate of toxic rows is every document's score. Null and empty texts are scored by their
        empty figures, whole texts of any length in one task each; repeated rows are scored each and alike; a
        column ``score`` is replaced, others may have any names; an empty table gives none."""
        kept = [c for c in docs.columns if c not in (text, "score")]
        if self.trees is None:
            return docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(self.rate).alias("score"))
        # the other columns travel as one, so that they may have any names
        rows = features(docs.select(F.struct(F.lit(0).alias(unused("n", kept)), *(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text}`").alias("text")), self.lexicon)
        return _curve(self.curve, _raw(self.trees, rows)).select(*(F.col(f"row.`{c}`") for c in kept), "score")


def _raw(trees, rows: DataFrame) -> DataFrame:
    scored = trees.transform(rows.withColumn("_x", array_to_vector("features")))
    return scored.withColumn("_raw", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def _curve(curve, rows: DataFrame) -> DataFrame:
    return (curve.transform(rows).withColumn("score", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)))
            .drop("_raw", "prediction"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, rounds: int = 30, depth: int = 4) -> ToxicityModel:
    """Fits on at most ``max_rows`` labelled rows (those with the smallest hash of doc_id).

    ``labels``: doc_id and label (0 or 1); null ids or labels are left out, of repeated ids the
    highest label counts. A fifth of the rows (by hash) calibrates; if it has fewer than 30
    toxic rows, all rows do.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    chosen = (labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    train = scratch.save(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "train")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return ToxicityModel({}, None, None, float(rate))
    fold = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(5)) == 0
    train = train.withColumn("calibrate", fold)
    lexicon = learn_lexicon(train.where("NOT calibrate") if counts[1] >= 200 else train)
    rows = scratch.save(features(train, lexicon).withColumn("label", F.col("label").cast("double")), "features")
    fit, held = rows.where("NOT calibrate"), rows.where("calibrate")
    if held.where("label = 1").count() < 30:
        fit, held = rows, rows
    x = fit.withColumn("_x", array_to_vector("features")).coalesce(4)
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64,
                          seed=1, minInstancesPerNode=5).fit(x)
    curve = IsotonicRegression(featuresCol="_raw", labelCol="label").fit(_raw(trees, held.coalesce(1)))
    return ToxicityModel(lexicon, trees, curve, float(rate))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("toxic").alias("label"))
    scored = fit_toxicity(docs, labels).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

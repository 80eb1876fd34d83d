"""Quality by a linear-chain conditional random field over the lines of a document.

Every line gets a label, good or bad. State features are the line's own and those of the lines
before and after; a transition matrix couples neighbouring labels. Training sets each line's
label to its document's. For scoring, forward-backward gives every line's marginal; the
document's figure is the mean marginal weighted by line length, brought to a probability by a
logistic curve fitted on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import Scratch, bounded_batches, read

_CAPITALS = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_PUNCT = b"!?.,;:\"'()[]{}-/\\~^_@"
#: Cut points that turn each line figure into steps (0 or 1: above the cut).
CUTS = {
    "capital": [0.02, 0.1, 0.3, 0.6], "symbol": [0.001, 0.02, 0.08, 0.15], "punct": [0.0, 0.03, 0.08, 0.15],
    "exclaim": [0.02, 0.1, 0.5], "bar": [0.02, 0.2], "digit": [0.001, 0.05, 0.2], "same_next": [0.01, 0.1, 0.5],
    "distinct": [0.3, 0.5, 0.7, 0.9], "word_length": [2.5, 4.0, 5.5, 7.0, 9.0, 14.0], "words": [1.5, 3.5, 8.5, 20.5, 60.5],
    "seen": [0.5], "sentence_end": [0.5], "url": [0.001, 0.1], "short_words": [0.1, 0.3, 0.5],
}
WIDTH = sum(map(len, CUTS.values()))
#: Features of a position: bias, own, previous (with whether there is one), next (likewise).
DIM = 1 + 3 * WIDTH + 2
_FLAT = np.concatenate([np.array(x) for x in CUTS.values()])
_COLUMN = np.repeat(np.arange(len(CUTS)), [len(x) for x in CUTS.values()])


def line_figures(text: str) -> tuple[list[list[float]], list[int]]:
    """The figures (in the order of ``CUTS``) and lengths of all lines that have a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        raw = line.encode("utf-8", "replace")
        words = raw.split()
        n = len(words)
        if not n:
            continue
        size = len(raw)
        without = lambda chars: (size - len(raw.translate(None, chars))) / size  # noqa: E731, B023
        bare = {w.strip(_PUNCT) for w in words}
        rows.append([
            without(_CAPITALS), without(_SYMBOLS), without(_PUNCT), raw.count(b"!") / n, raw.count(b"|") / n, without(b"0123456789"),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(bare) / n,
            (size - n + 1) / n, float(n), float(raw in seen), float(words[-1][-1:] in b".!?"),
            (raw.count(b"http") + raw.count(b"www.") + raw.count(b"@")) / n, sum(len(w) < 3 for w in words) / n])
        sizes.append(len(line))
        seen.add(raw)
    return rows, sizes


@dataclass
class Chains:
    """Lines of several documents end to end: ``x`` (figures), ``size`` (length), ``first``."""

    x: np.ndarray
    size: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Chains:
        rows, sizes, first = [], [], [0]
        for text in texts:
            r, s = line_figures(text or "")
            rows += r
            sizes += s
            first.append(len(rows))
        return cls(np.array(rows, np.float32).reshape(-1, len(CUTS)), np.array(sizes, float), np.array(first))


def state_features(c: Chains) -> np.ndarray:
    """DIM features of every line: a bias, its steps, and those of its neighbours."""
    own = (c.x[:, _COLUMN] > _FLAT.astype(np.float32)).astype(np.float32)
    n = len(own)
    out = np.zeros((n, DIM), np.float32)
    out[:, 0] = 1
    out[:, 1:1 + WIDTH] = own
    starts = np.zeros(n + 1, bool)
    starts[c.first[:-1]] = True
    inner = ~starts[1:n] if n else np.zeros(0, bool)  # the line is no document's first
    before, after = out[1:, 1 + WIDTH:2 + 2 * WIDTH], out[:-1, 2 + 2 * WIDTH:]
    before[inner, :WIDTH], before[inner, WIDTH] = own[:-1][inner], 1
    after[inner, :WIDTH], after[inner, WIDTH] = own[1:][inner], 1
    return out


def forward_backward(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains with log state scores ``score`` (lines x 2): the label marginals of every line,
    the summed pair marginals (2 x 2), and each chain's log partition. All chains advance
    together, one position a step, longest first."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, size = first[:-1][order], length[order]
    active = [int((size > t).sum()) for t in range(int(size[0]) if len(size) else 0)]
    alpha, beta, pairs = np.zeros_like(score), np.zeros_like(score), np.zeros((2, 2))
    log_z = np.zeros(len(length))

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for t, m in enumerate(active):
        at = start[:m] + t
        alpha[at] = score[at] if t == 0 else score[at] + lse(alpha[at - 1][:, :, None] + trans, 1)
    for t in range(len(active) - 2, -1, -1):
        at = start[:active[t + 1]] + t
        beta[at] = lse(trans + (score[at + 1] + beta[at + 1])[:, None, :], 2)
    full = length > 0
    log_z[full] = lse(alpha[first[1:][full] - 1], 1)
    z = np.repeat(log_z, length)
    marginal = np.exp(alpha + beta - z[:, None])
    inner = np.ones(len(score), bool)
    inner[first[:-1][full]] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = alpha[at - 1][:, :, None] + trans + (score[at] + beta[at])[:, None, :] - z[at][:, None, None]
        pairs = np.exp(joint).sum(axis=0)
    return marginal, pairs, log_z


@dataclass
class QualityModel:
    """State weights (DIM x 2), transitions (2 x 2) and the document curve (a, b)."""

    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    rate: float

    def line_marginals(self, c: Chains) -> np.ndarray:
        """P(good) of every line."""
        score = (state_features(c) @ self.weights).astype(float)
        return forward_backward(score, c.first, self.trans)[0][:, 1]

    def figure(self, c: Chains) -> np.ndarray:
        """Length-weighted mean marginal of every document; NaN without a line."""
        good = self.line_marginals(c)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[c.first])
        with np.errstate(invalid="ignore", divide="ignore"):
            return sums(good * c.size) / sums(c.size)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Score of every text; a text without a word scores 0."""
        if not np.isfinite(self.rate):
            return np.full(len(texts), 0.5)
        mean = np.clip(self.figure(Chains.of(texts)), 1e-6, 1 - 1e-6)
        a, b = self.curve
        with np.errstate(invalid="ignore"):
            out = 1 / (1 + np.exp(-(a + b * np.log(mean / (1 - mean)))))
        return np.where(np.isnan(mean), 0.0, out)


def fit_chain(c: Chains, label: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> QualityModel:
    """Maximises the mean conditional log likelihood of the documents' labels (every line has
    its document's label) by Adam on the full sample; then the document curve by Newton's steps."""
    x, length = state_features(c), np.diff(c.first)
    y = np.repeat(label, length).astype(int)
    docs = max(1, int((length > 0).sum()))
    inner = np.ones(len(y), bool)
    inner[c.first[:-1][length > 0]] = False
    seen_pairs = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen_pairs, (y[at - 1], y[at]), 1)
    target = np.eye(2, dtype=np.float32)[y]
    # each document counts as one, however many lines it has
    share = np.repeat(1 / np.maximum(1, length), length).astype(np.float32)[:, None]
    params = np.zeros(DIM * 2 + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, t = params[:DIM * 2].reshape(DIM, 2), params[DIM * 2:].reshape(2, 2)
        marginal, pairs, _ = forward_backward((x @ w.astype(np.float32)).astype(float), c.first, t)
        gw = x.T @ (share * (target - marginal.astype(np.float32))) / docs - decay * w
        gt = (seen_pairs - pairs) / max(1, len(y)) - decay * t
        g = np.concatenate([gw.ravel(), gt.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (0.5 ** (3 * step / rounds)) * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model = QualityModel(params[:DIM * 2].reshape(DIM, 2).astype(np.float32), params[DIM * 2:].reshape(2, 2), (0.0, 1.0), float(label.mean()))
    mean = model.figure(c)
    have = ~np.isnan(mean)
    p = np.clip(mean[have], 1e-6, 1 - 1e-6)
    z, target1 = np.log(p / (1 - p)), label[have]
    design, theta = np.stack([np.ones_like(z), z], 1), np.array([0.0, 1.0])
    for _ in range(25):
        q = 1 / (1 + np.exp(-design @ theta))
        hess = design.T @ (design * (q * (1 - q))[:, None]) + 1e-2 * np.eye(2)
        theta = theta + np.linalg.solve(hess, design.T @ (target1 - q) - 1e-2 * (theta - [0.0, 1.0]))
    theta[1] = max(theta[1], 1e-3)  # more good lines never lower a score
    model.curve = (float(theta[0]), float(theta[1]))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 8_000, max_lines: int = 150_000) -> QualityModel:
    """Fits on at most ``max_rows`` labelled documents (those with the smallest hash of doc_id) and
    as many of them as have ``max_lines`` lines together.

    ``labels``: doc_id and label (1 good); null ids or labels are left out, of repeated ids the
    lowest label counts. With one class or none, every score is 0.5 or that class.
    """
    spark = docs.sparkSession
    chosen = (labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, label, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, sizes = line_figures(text or "")
                if rows and len(rows) <= max_lines:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], pa.int64()), pa.array([label], pa.int32()), pa.array([len(rows)], pa.int64()),
                         pa.array([np.array(rows, np.float32).tobytes()], pa.binary()), pa.array([np.array(sizes, float).tobytes()], pa.binary())],
                        names=["doc_id", "label", "n", "x", "size"])

    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")
    rows = Scratch(spark, "quality").save(train.mapInArrow(figures, "doc_id bigint, label int, n bigint, x binary, size binary"), "lines")
    # the sample's line counts: at most max_rows numbers
    counts = rows.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    inside = counts[counts.n.cumsum() <= max_lines]
    if not len(inside):
        return QualityModel(np.zeros((DIM, 2), np.float32), np.zeros((2, 2)), (0.0, 1.0), float("nan"))
    last = int(inside.doc_id.iloc[-1])
    edge = F.xxhash64(F.lit(last).cast("bigint"))
    h = F.xxhash64("doc_id")
    sample = rows.where((h < edge) | ((h == edge) & (F.col("doc_id") <= last))).orderBy(h, "doc_id").toArrow()
    first = np.concatenate([[0], np.cumsum(sample["n"].to_numpy())]).astype(np.int64)
    x = np.concatenate([np.frombuffer(b, np.float32) for b in sample["x"].to_pylist()]).reshape(-1, len(CUTS))
    size = np.concatenate([np.frombuffer(b, float) for b in sample["size"].to_pylist()])
    return fit_chain(Chains(x, size, first), sample["label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and, unless ``keep_text``, without the text.
    One narrow pass over whole texts; null and empty texts score 0; a column named ``score`` is replaced."""
    kept = [c for c in docs.columns if c not in (text, "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = part if keep_text else part.select(part.schema.names[:-1])
                scores = model.score(part.column(part.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(scores, pa.float64())], names=[*own.schema.names, "score"])

    bounded_batches(docs.sparkSession)
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text).alias(text))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:None if keep_text else -1])
    return source.mapInArrow(run, f"{fields}score double")


def held_out_fold(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels outside the held-out fold."""
    return read(spark, sf_dir, "labels").where(~held_out_fold()).select("doc_id", F.col("quality").alias("label"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", held_out_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Base figures and rates are computed inside each row (array functions, no shuffle of words).
A rule is a cutoff for each rate; a document is rejected if any rate is above its cutoff. The rules tried are the steps of
``PATH``, fixed beforehand: each tightens one cutoff of the step before, so a document has a first step that rejects it.
For each stratum the steps are tested in order on the labelled holdout, the joint rule each time: a step is valid if the exact
binomial test rejects "a good document of the stratum is rejected with probability above ``risk``" at level ``delta`` /
strata, and the walk ends at the first that is not (fixed-sequence testing needs no correction over the steps; the strata
are corrected for by Bonferroni's share). So with probability 1 - ``delta`` at most ``risk`` of the good documents
of every stratum at once are rejected, by all rates together. Of the valid steps, the one with the most rejected bad
documents against rejected good ones is chosen; a stratum with no useful valid step rejects nothing. A stratum
needs ln(``delta`` / strata) / ln(1 - ``risk``) good documents for any (477 by default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.common import SEPARATOR_CHARS, Scratch, let, read, word_array

SYMBOLS = "#*$%&|<>"
#: Rates and their grids, loosest cutoff first; a document is rejected above the cutoff.
GRIDS = {
    "symbol_rate": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeat_rate": [0.2, 0.17, 0.14, 0.11, 0.08, 0.05, 0.03, 0.01],
    "capital_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "exclaim_rate": [1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "same_word_rate": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5],
    "word_length": [30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0],
}
#: The steps: every rate's first cutoff in turn, then every rate's second, and so on.
PATH = [(rate, grid[step]) for step in range(max(map(len, GRIDS.values()))) for rate, grid in GRIDS.items() if step < len(grid)]
#: Word counts that part the strata; each part is halved by whether the text has non-ASCII letters.
LENGTHS = (100, 400)
N_STRATA = 2 * (len(LENGTHS) + 1)


def repeated_words(words: Column, k: int = 5) -> Column:
    """How many words lie in a ``k``-word window that occurs twice or more in ``words``.

    Windows are compared by a 64-bit hash chained over their words. Rows whose window hashes
    are all distinct end there; others sort (hash, position) and sum the covered words.
    """
    n = F.size(words) - F.lit(k - 1)
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(words[i + j] for j in range(k))))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: let(
            F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j:
                         ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"]))
                         | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == s[j]["h"]))),
                         lambda j: s[j]["i"])),
            lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("bigint"), lambda total, j:
                                  total + F.when(j == F.size(p) - 1, F.lit(k))
                                  .otherwise(F.least(F.lit(k), p[F.least(j + 1, F.size(p) - 1)] - p[j])))))

    return F.when(n < 1, F.lit(0).cast("bigint")).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h))))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base figures, rates and stratum of every document; one narrow pass over whole texts.
    Null and empty texts count as no words and have all rates 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(key).alias("doc_id"), t.alias("t"))
    source = source.withColumn("words", word_array(F.col("t")))
    source = source.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SEPARATOR_CHARS)) != ""))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    strip = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    base = source.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        (F.length("t") - strip(SEPARATOR_CHARS)).cast("bigint").alias("word_chars"),
        strip(SYMBOLS).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.size(F.array_distinct("words")).alias("n_distinct"),
        strip("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÇÑÍÓÁÀÂÎÔÛÚ").alias("n_capitals"), strip("!").alias("n_exclaim"),
        (F.octet_length("t") > F.length("t")).cast("int").alias("wide"))
    n, lengths = F.col("n_words"), sum((F.col("n_words") >= x).cast("int") for x in LENGTHS)
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (lengths * 2 + F.col("wide")).alias("stratum"),
        part(F.col("n_symbols"), F.col("word_chars")).alias("symbol_rate"),
        part(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_rate"),
        part(F.col("n_repeat_words"), n).alias("repeat_rate"),
        part(F.col("n_capitals"), F.col("word_chars")).alias("capital_rate"),
        part(F.col("n_exclaim"), n).alias("exclaim_rate"),
        F.when(n > 0, 1 - F.col("n_distinct") / n).otherwise(F.lit(0.0)).alias("same_word_rate"),
        part(F.col("word_chars"), n).alias("word_length"),
        ((n < 10) | (100 * F.col("n_repeat_words") > 20 * n)).alias("base_failed"))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x), x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7)
    back = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046728 + series - back


def binomial_below(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly summed from the k-th term down; 1 where k is n * p or more
    (no test can reject there). Terms shrink at least geometrically, so those beyond
    40 * (sqrt(k) + 1) are below the rounding error."""
    k, n = k.cast("double"), n.cast("double")
    top = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log1p(F.lit(-p))
    last = F.least(k, F.ceil(40 * (F.sqrt(k) + 1)).cast("double")).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        F.sequence(F.lit(0), last), zero,
        lambda a, j: F.struct((a["term"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")), lambda a: a["sum"])
    return F.when((n <= 0) | (k >= n * p), F.lit(1.0)).otherwise(F.exp(top) * total)


def first_rejection() -> Column:
    """The first step of ``PATH`` that rejects a document; its length for one that passes all."""
    firsts = []
    for rate in GRIDS:
        steps = [(k, c) for k, (r, c) in enumerate(PATH) if r == rate]
        found = F.when(F.col(rate) > steps[0][1], steps[0][0])
        for k, c in steps[1:]:
            found = found.when(F.col(rate) > c, k)
        firsts.append(found.otherwise(len(PATH)))
    return F.least(*firsts)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05,
            cost: float = 10.0) -> DataFrame:
    """The chosen steps: (stratum, step, good, false, caught, p_value); at most ``N_STRATA`` rows: documents whose first
    rejecting step is ``step`` or an earlier one are rejected. ``labels`` has doc_id and quality (1 good, 0 bad); rows
    without either are left out, of repeated doc_ids the worst label counts. ``cost``: how many rejected bad
    documents one rejected good one must buy."""
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    held = measured.where("NOT base_failed").join(truth, "doc_id").select("stratum", "quality", first_rejection().alias("step"))
    # N_STRATA x (steps + 1) rows at most, whatever the input
    counts = held.groupBy("stratum", "step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    by_stratum = Window.partitionBy("stratum")
    so_far = by_stratum.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tests = (counts.select("stratum", "step", F.sum("good").over(by_stratum).alias("n"), F.sum("good").over(so_far).alias("false"), F.sum("bad").over(so_far).alias("caught"))
             .where(F.col("step") < len(PATH)).withColumn("p_value", binomial_below(F.col("false"), F.col("n"), risk)))
    walked = tests.withColumn("worst", F.max("p_value").over(so_far)).where(F.col("worst") <= delta / N_STRATA)
    gain = F.col("caught") - cost * F.col("false")
    best = F.max_by(F.struct("step", F.col("n").alias("good"), "false", "caught", "p_value"), F.struct(gain, -F.col("step")))
    return walked.where(gain > 0).groupBy("stratum").agg(best.alias("best")).select("stratum", "best.*")


def rule_of(step: int) -> dict[str, float]:
    """The cutoffs that hold at a step of ``PATH``."""
    return dict(PATH[:step + 1])


def apply_cutoffs(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """Adds ``kept``: not base_failed, and not rejected by the step of its stratum. ``chosen`` has at most
    ``N_STRATA`` rows, and so is broadcast."""
    steps = chosen.select("stratum", F.col("step").alias("last"))
    joined = measured.join(F.broadcast(steps), "stratum", "left")
    rejected = F.coalesce(first_rejection() <= F.col("last"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("last")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """Figures, rates and verdict of every document. ``docs`` may have any further columns;
    repeated rows are judged each; without labels (or with too few for any test) only the base
    rules reject. The figures are saved once and read for the cutoffs and the verdicts."""
    scratch = Scratch(docs.sparkSession, "rules")
    measured = scratch.save(measure(docs), "measured")
    return apply_cutoffs(measured, scratch.save(cutoffs(measured, labels, risk, delta), "cutoffs"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

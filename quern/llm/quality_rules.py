"""Quality rules with risk-controlled cutoffs.

A row of counts is made of each whole text. Per stratum and metric, the cutoffs of a fixed grid are tested one
after another from loose to strict: an exact binomial test on labelled good documents has to show that a cutoff
rejects at most the metric's part of ``risk``, and the last one before the first failure is taken. The order is
fixed beforehand, so a sequence as a whole has the error of one test; the sequences, one for each stratum and metric,
share ``delta`` (Bonferroni), and the metrics share ``risk``. Where not even the loosest cutoff can be shown to be
safe, the metric rejects nothing in that stratum: with 4 strata, and none of its good documents over a cutoff, a
stratum needs 459 of them (``least_labels``).

Defined results: a null or empty text has no words, fails the base rule and is not kept; a null stratum is a
stratum of its own; texts are never shortened; repeated rows are judged each, but a doc_id is calibrated on once, by
its row of least counts, so that trials are independent; labels without a document, and documents without a label,
take no part in the calibration; several labels of a document count as good if one is. An empty table gives an empty
result. Extra columns of the input are not carried.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, write_table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Cutoffs that are tested, per metric; a document over the cutoff is rejected.
GRID = {
    "symbol_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "dup_line_share": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "mean_word_chars": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    df = df.select(
        "doc_id",
        "stratum",
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"),
    )
    n = F.size("w")
    window = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)])))
    df = df.select(
        "doc_id",
        "stratum",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n.cast("long").alias("n_words"),
        window.alias("h"),
    )
    # Few texts have a window twice; only those are sorted.
    twice = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("h")
    at = F.transform("s", lambda x, j: F.when((x.h == F.get("s", j - 1).h) | (x.h == F.get("s", j + 1).h), x.i))
    df = df.withColumn("at", F.sort_array(F.filter(at, lambda i: i.isNotNull()))).drop("s")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a.total + p + WINDOW - F.greatest(a.end, p)).alias("total")),
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered.total, F.lit(0)).cast("long")).drop("at")


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def _metrics() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) of X binomial in n trials of p, exact but for floating point."""
    if n == 0 or k >= n or k > n * p:  # beyond the mean no test at a useful level can succeed
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, total)


def least_labels(sequences: int, risk: float, delta: float) -> int:
    """Good documents that a stratum needs for any cutoff, none of them being over it."""
    return math.ceil(math.log(delta / sequences) / math.log1p(-risk / len(GRID)))


def calibrate(counted: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> dict[str, dict[str, float]]:
    """Cutoffs by stratum and metric. Only a row of counts per stratum with labels enough reaches the driver."""
    good = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality")).where(F.col("quality") == 1)
    held = counted.where(~base_failed()).join(good, F.col("doc_id") == F.col("label_id"))
    held = held.groupBy("doc_id").agg(F.min(F.struct(*[c for c in counted.columns if c != "doc_id"])).alias("row")).select("row.*")
    metrics = _metrics()
    over = [F.sum((metrics[m] > t).cast("long")).alias(f"{m}_{i}") for m, grid in GRID.items() for i, t in enumerate(grid)]
    by_stratum = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *over)
    strata = by_stratum.count()
    if not strata:
        return {}
    sequences = strata * len(GRID)
    cutoffs: dict[str, dict[str, float]] = {}
    for row in by_stratum.where(F.col("n") >= least_labels(sequences, risk, delta)).collect():
        for m, grid in GRID.items():
            for i, t in sorted(enumerate(grid), key=lambda x: -x[1]):
                if at_most(row[f"{m}_{i}"], row["n"], risk / len(GRID)) > delta / sequences:
                    break
                cutoffs.setdefault(row["stratum"], {})[m] = t
    return cutoffs


def verdicts(counted: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    metrics = _metrics()
    over = F.lit(False)
    for m in GRID:
        by_stratum = [x for s, c in sorted(cutoffs.items()) if m in c for x in (F.lit(s), F.lit(c[m]))]
        if by_stratum:
            over = over | F.coalesce(metrics[m] > F.element_at(F.create_map(*by_stratum), F.col("stratum")), F.lit(False))
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over)


def filter_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The counts, base_failed and kept of every document. The counts, a few numbers a document, are written once."""
    counted, _ = write_table(spark, features(docs), "quality-counts")
    return verdicts(counted, calibrate(counted, labels, risk, delta))

"""Model-backed scores: pluggable scorers, perplexity reports, language and instruction checks, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import settle, ship

#: Makes, once a task, a function from texts to scores. A score is a number, a pair of a number and the tokens it was
#: taken over, or None where there is none. No model is part of this package.
Scorer = Callable[[], Callable[[list[str]], list]]
#: Makes, once a task, a function from texts to pairs of a language's code and its probability.
LanguageScorer = Callable[[], Callable[[list[str]], list[tuple[str, float] | None]]]
#: Makes, once a task, a function from a list of role and content pairs, and whether an answer is asked for, to ids.
ChatTokenizer = Callable[[], Callable[[list[tuple[str, str]], bool], list[int]]]


def estimated_tokens(column: Column) -> Column:
    """For scorers that don't count tokens: each Han, Kana or Hangul character, and each run of other characters that aren't white space."""
    wide = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"
    return F.regexp_count(column, F.lit(rf"[{wide}]|[^{wide}\s]+")).cast("long")


def with_score(df: DataFrame, column: Column, load: Scorer, name: str, tokens: str | None = None) -> DataFrame:
    """Adds a scorer's double and, if asked for, the tokens it was taken over. The model is loaded once for all batches of a task."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score = load()
        for s in batches:
            pairs = [x if isinstance(x, tuple) else (x, None) for x in score([x or "" for x in s])]
            yield pd.DataFrame({"score": pd.Series([p for p, _ in pairs], dtype="float64"), "tokens": pd.Series([n for _, n in pairs], dtype="Int64")})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    made = df.withColumn("scored_", F.pandas_udf(run, "score double, tokens long")(column))
    if tokens:
        made = made.withColumn(tokens, F.coalesce("scored_.tokens", F.when(F.col("scored_.score").isNotNull(), estimated_tokens(column))))
    return made.withColumn(name, F.col("scored_.score")).drop("scored_")


def with_language(df: DataFrame, column: Column, load: LanguageScorer, name: str) -> DataFrame:
    """Adds a struct of known, code and probability; known is false where the model can't be loaded, so that callers fall back."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            judge = load()
        except Exception:  # noqa: BLE001 - an optional model must not end the run
            judge = None
        for s in batches:
            found = [None] * len(s) if judge is None else judge([(x or "").replace("\n", " ") for x in s])
            code, sure = ([None if x is None else x[k] for x in found] for k in (0, 1))
            yield pd.DataFrame({"known": judge is not None, "code": pd.Series(code, dtype="object"), "probability": pd.Series(sure, dtype="float64")}, index=s.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return df.withColumn(name, F.pandas_udf(run, "known boolean, code string, probability double")(column))


def perplexity(losses: Column) -> Column:
    """exp of the mean of a record's token losses; null without any."""
    total = F.aggregate(losses, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(losses) > 0, F.exp(total / F.size(losses)))


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; zeros without any."""
    width = F.size(F.element_at(hidden, 1))
    add = lambda a, i: F.zip_with(a, F.get(hidden, i), lambda x, y: x + y * F.get(mask, i))
    at = F.sequence(F.lit(0), F.size(hidden) - 1)
    summed = F.aggregate(at, F.array_repeat(F.lit(0.0), width), add)
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return F.when(F.size(hidden) > 0, F.transform(summed, lambda x: x / count))


def effective_limit(limit: float, per_source: tuple[dict, ...], key: str = "ppl_max", source: str = "source") -> Column:
    """The limit of the first entry that has one and whose match the source contains."""
    out = None
    for e in per_source:
        if e.get("match") and e.get(key) is not None:
            hit = F.coalesce(text.contains_ignoring_case(F.col(source), e["match"]), F.lit(False))
            out = F.when(hit, float(e[key])) if out is None else out.when(hit, float(e[key]))
    return F.lit(float(limit)) if out is None else out.otherwise(float(limit))


def judge_perplexity(df: DataFrame, limit: float = 150.0, min_tokens: int = 32, per_source: tuple[dict, ...] = ()) -> DataFrame:
    """df: ppl, n_tokens, source. Adds scored, ppl_limit, ppl_fails; short and unscored rows pass."""
    scored = F.col("ppl").isNotNull() & (F.col("n_tokens") >= min_tokens)
    df = df.withColumns({"scored": scored, "ppl_limit": effective_limit(limit, per_source)})
    return df.withColumn("ppl_fails", F.col("scored") & (F.col("ppl") > F.col("ppl_limit")))


def ppl_stats(scored: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, mean, max and nearest-rank quantiles, rounded to two places, over all rows of each group.

    Distinct values are counted and range-partitioned; ranks are counts within a partition on top of the counts of
    the partitions before it, so no task holds more than a partition, whatever the groups' sizes.
    """
    spark = scored.sparkSession
    counts = scored.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x_")).agg(F.count(F.lit(1)).alias("c_"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = settle(counts.repartitionByRange(parts, *by, "x_").withColumn("part_", F.spark_partition_id()), "ppl-counts")
    sums = counts.groupBy(*by, "part_").agg(F.sum("c_").alias("in_part_"))  # a row for each part of each group
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before_": F.coalesce(F.sum("in_part_").over(earlier), F.lit(0)), "n_": F.sum("in_part_").over(Window.partitionBy(*by))}).drop("in_part_")
    upto = F.sum("c_").over(Window.partitionBy(*by, "part_").orderBy("x_")) + F.col("before_")
    ranked = counts.join(sums, [*by, "part_"]).withColumn("upto_", upto)
    at = lambda q: F.min(F.when(F.col("upto_") > F.bround(F.lit(q) * (F.col("n_") - 1), 0), F.col("x_")))
    two = lambda c: F.round(c, 2)
    return ranked.groupBy(*by).agg(
        F.sum("c_").alias("count"), two(F.min("x_")).alias("min"), two(F.sum(F.col("x_") * F.col("c_")) / F.sum("c_")).alias("mean"),
        *[two(at(q)).alias(name) for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))], two(F.max("x_")).alias("max"),
    )


def n_clusters(n: int) -> int:
    return min(n, min(64, max(4, int(math.sqrt(n) / 2))))


def clusters(df: DataFrame, vector: str, seed: int = 42) -> DataFrame:
    """Adds cluster, by distributed k-means under cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    if n < 2:
        return df.withColumn("cluster", F.lit(0))
    prepared = df.withColumn("features_", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=n_clusters(n), maxIter=20, seed=seed, distanceMeasure="cosine", featuresCol="features_", predictionCol="cluster").fit(prepared)
    return model.transform(prepared).drop("features_")


def mask_labels(full: Column, prompt: Column, limit: int) -> Column:
    """Labels of a sample: -100 over the prompt if the ids start with it, else all ids; cut at ``limit``."""
    aligned = F.slice(full, F.lit(1), F.size(prompt)) == prompt
    rest = F.slice(full, F.size(prompt) + 1, F.greatest(F.lit(0), F.size(full) - F.size(prompt)))
    labels = F.when(aligned, F.concat(F.array_repeat(F.lit(-100), F.size(prompt)), rest)).otherwise(full)
    return F.slice(labels, 1, limit)


def pad(values: Column, size: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), size - F.size(values))))


def training_samples(records: DataFrame, messages: Column, load: ChatTokenizer, limit: int = 1024) -> DataFrame:
    """records with input_ids and labels of those that can be trained on.

    A record is left out if its last message is no assistant's, if it can't be tokenised, or if cutting at ``limit``
    leaves no label.
    """
    ship(records.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = load()
        for s in batches:
            rows = []
            for turns in s:
                pairs = [(t["role"], t["content"]) for t in turns]
                try:
                    rows.append((list(encode(pairs, False)), list(encode(pairs[:-1], True))))
                except Exception:  # noqa: BLE001 - a record that a tokenizer refuses must not end the run
                    rows.append((None, None))
            yield pd.DataFrame(rows, columns=["full", "prompt"], index=s.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    df = records.withColumn("messages_", messages).where((F.size("messages_") > 0) & (F.element_at("messages_", -1).role == "assistant"))
    df = df.withColumn("ids_", F.pandas_udf(run, "full array<int>, prompt array<int>")("messages_")).where("ids_.full IS NOT NULL")
    df = df.withColumn("labels", mask_labels(F.col("ids_.full"), F.col("ids_.prompt"), limit)).withColumn("input_ids", F.slice("ids_.full", 1, limit))
    return df.where(F.exists("labels", lambda x: x != -100)).drop("messages_", "ids_")

"""Analytics over job status and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States after which a job doesn't change.
TERMINAL = ("succeeded", "failed", "cancelled", "canceled")


def normalise(raw: DataFrame, json: str) -> DataFrame:
    """jobId, status, terminal, model, fineTunedModel, createdAt, detail of a provider's JSON."""
    g = lambda p: F.get_json_object(json, p)
    status = F.lower(F.coalesce(g("$.status"), F.lit("unknown")))
    return raw.select(
        F.coalesce(g("$.id"), g("$.fine_tuning_job_id")).alias("jobId"), status.alias("status"), status.isin(*TERMINAL).alias("terminal"), g("$.model").alias("model"),
        F.coalesce(g("$.fine_tuned_model"), g("$.fineTunedModel")).alias("fineTunedModel"), F.coalesce(g("$.created_at"), g("$.createdAt")).alias("createdAt"), F.coalesce(g("$.error.message"), g("$.message")).alias("detail"),
    )


def status_changes(df: DataFrame, job: str, order: list[str], status: str) -> DataFrame:
    """Rows whose status differs from the job's previous one; the first is one."""
    before = F.lag(status).over(Window.partitionBy(job).orderBy(*order))
    return df.withColumn("before_", before).where(~F.col("before_").eqNullSafe(F.col(status)) | F.col("before_").isNull()).drop("before_")


def error_runs(df: DataFrame, job: str, order: list[str], failed: Column, stop: int = 3) -> DataFrame:
    """Adds run (failures in a row, reset by success) and stopped (the run has reached ``stop``)."""
    w = Window.partitionBy(job).orderBy(*order)
    marked = df.withColumn("failed_", failed.cast("int"))
    marked = marked.withColumn("island_", F.sum(1 - F.col("failed_")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum("failed_").over(Window.partitionBy(job, "island_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).withColumn("stopped", F.col("run") >= stop).drop("failed_", "island_")


def probe_markers(line: Column) -> dict[str, Column]:
    """Numbers and states that a probe prints as __NAME=value."""
    at = lambda k: F.nullif(F.regexp_extract(line, rf"__{k}=([^\s]*)", 1), F.lit(""))
    return {"bytes": at("BYTES").cast("long"), "exit": at("EXIT").cast("int"), "state": at("STATE"), "pid_state": at("PIDSTATE")}


def list_view(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """What a list of jobs shows: the first ``limit``, without detail."""
    return jobs.drop("detail").limit(limit)


def tail(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The last ``n`` lines of a log, in order."""
    return lines.orderBy(F.desc(order)).limit(n).orderBy(order)


def until_terminal(polls: DataFrame, job: str, order: list[str], status: str) -> DataFrame:
    """Polls up to and including each job's first one in a state after which it doesn't change."""
    done = F.lower(F.col(status)).isin(*TERMINAL).cast("int")
    before = F.sum(done).over(Window.partitionBy(job).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return polls.withColumn("before_", F.coalesce(before, F.lit(0))).where("before_ = 0").drop("before_")

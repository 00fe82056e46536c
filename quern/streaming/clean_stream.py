"""Incremental cleaning: micro-batches against tables of seen keys and kept hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import trim
from ..operators import dedupe, rules, validate
from ..session import settle
from ..sources import jsonl


class CleanStream:
    """State between batches, all in shared storage: the format lock, exact keys, and hashes of kept rows.

    A batch is written under its number, so a batch that runs again after a failure replaces itself.
    """

    def __init__(self, spark: SparkSession, state: str, out: str, options: rules.Options | None = None, source_hint: str = "") -> None:
        self.spark, self.state, self.out, self.hint = spark, state.rstrip("/"), out.rstrip("/"), source_hint
        self.options = options or rules.Options()

    def _table(self, name: str, schema: str, batch: int) -> DataFrame:
        """Rows of earlier batches."""
        try:
            df = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.state}/{name}")
        except Exception as e:  # noqa: BLE001 - no batch has been written
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return df.where(F.col("batch") < batch).drop("batch")

    def process(self, lines: DataFrame, batch: int) -> None:
        o = self.options
        start = self._table("counts", "n long", batch).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        lines = settle(lines.where(trim(F.col("value")) != "").select(F.regexp_replace("value", "\r\\z", "").alias("raw"), F.monotonically_increasing_id().alias("at")), "stream-lines")
        numbered = settle(_numbered(lines, start), "stream-numbered")
        locked = self._table("format", "format string", batch).first()
        records = jsonl.records(numbered, self.hint)
        if locked:
            records = records.withColumn("format", F.when(F.col("format") == locked["format"], F.col("format")))
        judged = rules.verdicts(records, o, self._table("keys", "key string", batch), self._table("hashes", "simhash long", batch))
        early = F.coalesce(F.col("rule").isin("invalid", "empty_after_clean"), F.lit(False))
        judged = settle(judged, "stream-done")
        put = lambda df, name: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.state}/{name}/part={batch}")
        put(judged.agg(F.count(F.lit(1)).alias("n")), "counts")
        put(judged.where(~early).select(F.sha2(rules.dedupe_key(), 256).alias("key")).distinct(), "keys")
        fmt = judged.where("rule IS NULL OR rule <> 'invalid'").select("format").limit(1)
        put(fmt, "format")
        hashed = dedupe.with_simhash(judged.where("rule IS NULL").select(rules.joined_text().alias("t")), F.col("t"))
        put(hashed.where(F.col("n_tokens") >= o.simhash_min_tokens).select("simhash"), "hashes")
        judged.write.mode("overwrite").parquet(f"{self.out}/batch={batch}")

    def start(self, path: str, checkpoint: str) -> StreamingQuery:
        source = self.spark.readStream.option("lineSep", "\n").text(path)
        return source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _numbered(lines: DataFrame, start: int) -> DataFrame:
    """line_no after ``start``, in the order of ``at``: counts of partitions, then offsets."""
    from pyspark.sql import Window

    part = F.shiftright("at", 33)
    sizes = lines.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # a row a partition
    before, total = [], start
    for r in sizes:
        before.append((r["p"], total))
        total += r["n"]
    offsets = lines.sparkSession.createDataFrame(before, "p long, before long")
    return lines.withColumn("p", part).join(F.broadcast(offsets), "p").select((F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("at"))).alias("line_no"), "raw")


class ValidateStream:
    """Validation of a stream of lines: a row for each batch in shared storage, added up by summary().

    The format of the first record holds for all batches. A batch that runs again replaces its row.
    """

    def __init__(self, spark: SparkSession, state: str, most: int = 10) -> None:
        self.spark, self.state, self.most = spark, state.rstrip("/"), most

    def _earlier(self, batch: int | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.schema(f"batch long, {self.SCHEMA}").parquet(self.state)
        except Exception as e:  # noqa: BLE001 - no batch has been written
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return df if batch is None else df.where(F.col("batch") < batch)

    SCHEMA = "lines long, n_errors long, format string, chars long, preview string, errors array<struct<line: long, message: string>>"

    def process(self, lines: DataFrame, batch: int) -> None:
        past = self._earlier(batch)
        known = past.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("n"), F.min_by("format", F.when(F.col("format").isNotNull(), F.col("batch"))).alias("f")).first() if past is not None else None
        start, fmt = (known["n"], known["f"]) if known else (0, None)
        lines = settle(lines.where(trim(F.col("value")) != "").select(F.regexp_replace("value", "\r\\z", "").alias("raw"), F.monotonically_increasing_id().alias("at")), "stream-lines")
        found = validate.counted(validate.checked(settle(_numbered(lines, start), "stream-numbered"), fmt), self.most)
        found.select(F.lit(batch).cast("long").alias("batch"), *[f.split(" ")[0] for f in ("lines", "n_errors", "format", "chars", "preview", "errors")]).write.mode("overwrite").parquet(f"{self.state}/part={batch}")

    def summary(self) -> DataFrame:
        """As validate.summary(), over all batches so far."""
        past = self._earlier()
        return validate.added_up(self.spark.createDataFrame([], f"batch long, {self.SCHEMA}") if past is None else past, self.most)

    def start(self, path: str, checkpoint: str) -> StreamingQuery:
        source = self.spark.readStream.option("lineSep", "\n").text(path)
        return source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(polls: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Changes of a stream of polls (job, polled_at, status): the last status of each job is the state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def change(key: tuple, batches, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("polled_at")
        out = []
        for r in rows.itertuples(index=False):
            if r.status != last:
                out.append((key[0], r.polled_at, r.status))
                last = r.status
        state.update((last,))
        yield pd.DataFrame(out, columns=["job", "polled_at", "status"])

    made = polls.groupBy("job").applyInPandasWithState(change, "job string, polled_at timestamp, status string", "status string", "append", GroupStateTimeout.NoTimeout)
    return made.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

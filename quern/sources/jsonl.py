"""JSONL scan and sink with a global, deterministic numbering of non-blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.text import trim


def scan(spark: SparkSession, path: str, count_blank: bool = False) -> DataFrame:
    """line_no (1-based, blank lines not counted unless asked for), raw. Numbered in two passes: counts a split, then offsets.

    Only the counts of splits reach the driver; no window runs over all lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r\\z", "").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    there = trim(F.col("raw")) != ""
    lines = lines if count_blank else lines.where(there)
    before, total = [], 0
    for r in lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).orderBy("file", "block").collect():
        before.append((r["file"], r["block"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "file string, block long, before long")
    order = Window.partitionBy("file", "block").orderBy("at")
    return lines.join(F.broadcast(offsets), ["file", "block"]).select((F.col("before") + F.row_number().over(order)).alias("line_no"), "raw").where(there)


def records(lines: DataFrame, source_hint: str = "") -> DataFrame:
    """line_no, raw, v, format, source, turns, rest; format is null for what is no record."""
    df = lines.withColumn("v", formats.parse_json(F.col("raw")))
    df = df.withColumn("format", formats.detect(F.col("v")))
    tag = F.try_variant_get("v", "$.source", "variant")
    named = F.when(F.schema_of_variant(tag) == "STRING", F.try_variant_get("v", "$.source", "string"))
    source = F.when(F.col("format").isNull(), "").otherwise(F.coalesce(F.nullif(named, F.lit("")), F.lit(source_hint)))
    return df.select("line_no", "raw", "v", "format", source.alias("source"), formats.turns(F.col("v"), F.col("format")).alias("turns"), formats.rest_of_record(F.col("v")).alias("rest"))


def write(df: DataFrame, path: str, order: str = "line_no", value: str = "value") -> None:
    """Lines of a JSON column in order."""
    df.orderBy(order).select(F.col(value).alias("value")).write.mode("overwrite").text(path)


def guard(spark: SparkSession, source: str, target: str) -> None:
    """Refuse to write over the input, on whatever file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def whole(path: str) -> str:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return (fs.resolvePath(p) if fs.exists(p) else fs.makeQualified(p)).toString().rstrip("/")

    if whole(source) == whole(target):
        raise ValueError("the output must not be the input")

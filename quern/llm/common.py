"""What the operators of this subpackage share: table access and shared scratch space."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table, shared_folder, ship, spread, write_table

__all__ = ["BLANKS", "ascii_lower", "drop_table", "parallelism", "release", "shared_folder", "ship", "table", "trim", "write_table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: [^\x20\x09-\x0D]+ has these as separators.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def trim() -> None:
    """Give freed memory back to the system: workers live on, and what one stage has left else adds to the next one's."""
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done, and trim; else both stay."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

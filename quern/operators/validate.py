"""Validation of JSONL datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.text import trim, utf16_length
from ..session import settle


def checked(lines: DataFrame, locked: str | None = None) -> DataFrame:
    """lines: line_no, raw. line_no, format, parsed, chars, the head of raw, and error: invalid_json, unknown_shape or mixed_format.

    locked: the format of records that came before; else the first record's holds. A line is parsed once: what is asked
    of it later is read back from a table of these columns.
    """
    df = lines.withColumn("v_", formats.parse_json(trim(F.col("raw"))))
    df = df.select("line_no", formats.detect(F.col("v_")).alias("format"), F.col("v_").isNotNull().alias("parsed"), utf16_length(F.col("raw")).alias("chars"), F.left("raw", F.lit(400)).alias("head"))
    df = settle(df, "checked")
    first = locked or df.agg(F.min_by("format", F.when(F.col("format").isNotNull(), F.col("line_no"))).alias("f")).first()["f"]
    error = F.when(~F.col("parsed"), "invalid_json").when(F.col("format").isNull(), "unknown_shape").when(F.col("format") != F.lit(first), "mixed_format")
    return df.withColumn("error", error)


def counted(checked: DataFrame, most: int = 10) -> DataFrame:
    """lines, n_errors, format, chars, preview and errors (the first ``most``); one row, which added_up() can add to others."""
    at = F.when(F.col("format").isNotNull(), F.col("line_no"))
    chars = F.sum(F.when(F.col("parsed"), F.col("chars")).otherwise(0))
    whole = checked.agg(
        F.count(F.lit(1)).alias("lines"), F.count("error").alias("n_errors"), F.min_by("format", at).alias("format"),
        F.coalesce(chars, F.lit(0)).cast("long").alias("chars"), F.min_by("head", at).alias("preview"),
    )
    top = checked.where("error IS NOT NULL").orderBy("line_no").limit(most)
    errors = top.agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").cast("long").alias("line"), F.col("error").alias("message")))).alias("errors"))
    # Two rows of one line each: the joined pair is one row.
    return whole.withColumn("one", F.lit(1)).join(errors.withColumn("one", F.lit(1)), "one").drop("one")


def added_up(parts: DataFrame, most: int = 10) -> DataFrame:
    """valid, lines, format, errors, approx_tokens, preview of all parts: rows of counted() with batch."""
    at = F.when(F.col("format").isNotNull(), F.col("batch"))
    whole = parts.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("n_errors"), F.lit(0)).alias("n_errors"), F.min_by("format", at).alias("first"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.min_by("preview", at).alias("preview"),
        F.slice(F.sort_array(F.flatten(F.collect_list("errors"))), 1, most).alias("errors"),  # at most ``most`` a part
    )
    fmt = F.when(F.col("lines") == 0, "empty").otherwise(F.coalesce("first", F.lit("invalid")))
    tokens = F.floor(F.col("chars") / 4 + 0.5).cast("long")
    return whole.select(((F.col("n_errors") == 0) & (F.col("lines") > 0)).alias("valid"), "lines", fmt.alias("format"), "errors", tokens.alias("approx_tokens"), F.coalesce("preview", F.lit("")).alias("preview"))


def summary(checked: DataFrame, most: int = 10) -> DataFrame:
    """valid, lines, format, errors (the first ``most``), approx_tokens, preview; one row."""
    return added_up(counted(checked, most).withColumn("batch", F.lit(0).cast("long")), most)


def require_valid(lines: DataFrame, purpose: str = "use") -> dict:
    """The summary as a dictionary; ValueError, naming the first bad line, if the lines aren't a valid dataset."""
    found = summary(checked(lines)).first().asDict(recursive=True)
    if not found["valid"]:
        first = f"line {found['errors'][0]['line']}: {found['errors'][0]['message']}" if found["errors"] else "the file is empty"
        raise ValueError(f"refusing to {purpose} an invalid dataset ({first})")
    return found


def require_kept(summary: dict) -> dict:
    """The summary of a cleaning run; ValueError if nothing was kept."""
    if not summary["kept_lines"]:
        raise ValueError("cleaning removed every record")
    return summary

"""URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the host suffixes and path prefixes that a rule could name. The SHA-256 digest
of each expression is cut to a short prefix, which is equi-joined with the rules' short prefixes; the full
digest then confirms a match, and the longest matching rule decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and matches no rule; a URL
without a path has an empty path, which no rule path that starts with ``/`` fits. Repeated rows are judged
each. Among rules of equal length the one with the longer host wins, then ``block``. An empty table gives
an empty result; extra columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rules beyond this count are not broadcast; Spark then joins by shuffle and splits skewed partitions.
BROADCAST_RULES = 100_000
#: Hex digits of the digest in the equi-join.
SHORT = 8


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict. One row per distinct rule; ``block`` wins where both are given."""
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    r = r.where(F.col("r_host").isNotNull() & F.col("r_path").isNotNull()).groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    full = _digest(F.concat("r_host", F.lit("\n"), "r_path"))
    return r.withColumn("r_full", full).withColumn("r_short", F.substring("r_full", 1, SHORT))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``."""
    hashed = hashed_rules(rules)
    # Only shapes that occur among the rules can match: both sets are bounded by the longest rule.
    shapes = hashed.agg(
        F.collect_set(F.length("r_path")).alias("cuts"),
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("depths"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("row_", F.monotonically_increasing_id())
    if not shapes["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    known = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    n_labels = F.size(F.split("host", r"\."))
    suffixes = known(F.when(n_labels >= d, F.substring_index("host", ".", -d)) for d in sorted(shapes["depths"]))
    prefixes = known(F.when(F.length("path") >= c, F.substring("path", 1, c)) for c in sorted(shapes["cuts"]))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    wide = rows.select("row_", "page_id", "host", "path", F.explode_outer(pairs).alias("expression"))
    wide = wide.withColumn("full", _digest("expression")).drop("expression").withColumn("short", F.substring("full", 1, SHORT))

    right = F.broadcast(hashed) if shapes["n"] <= BROADCAST_RULES else hashed
    hit = wide.join(right, F.col("short") == F.col("r_short"), "left")
    name = F.concat("r_host", "r_path")
    match = F.when(
        F.col("full") == F.col("r_full"),
        F.struct(F.length(name).alias("size"), F.length("r_host").alias("host_size"), F.col("r_verdict").alias("verdict"), name.alias("rule")),
    )
    # The expansions of a row sit in one partition, so partial aggregation leaves one row a page to shuffle.
    best = hit.groupBy("row_", "page_id", "host", "path").agg(F.max(match).alias("m"))
    return best.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


#: The rules that the query op9_url_rules judges by.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def default_rules(spark) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")

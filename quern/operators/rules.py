"""Options, the rule chain and its verdicts: a record is dropped by its first failing rule."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text
from ..functions.hashing import bands
from ..session import settle, ship
from .dedupe import mark_keyed, near_blocked, with_simhash

#: All rules, in reporting order.
RULES = ("invalid", "empty_after_clean", "dedupe", "fuzzy_dupe", "min_chars", "max_chars", "repeat_ratio", "meaningful_ratio", "ends_assistant", "ppl", "lang", "inst", "semantic_dupe", "topic_downsample")
#: On which side of its threshold a numeric rule fails.
OVER = {"min_chars": False, "max_chars": True, "repeat_ratio": True, "meaningful_ratio": False, "ppl": True}


@dataclass(frozen=True)
class Options:
    """The defaults. A threshold of 0 turns its rule off."""

    dedupe: bool = True
    fuzzy_dedupe: bool = True
    simhash_distance: int = 8
    simhash_min_tokens: int = 10
    min_chars: int = 10
    max_chars: int = 20000
    repeat_ratio: float = 0.5
    min_meaningful_ratio: float = 0.2
    require_assistant_end: bool = True
    clean_text: bool = True
    merge_same_role: bool = True
    collapse_space: bool = False
    full_width_to_half: bool = True
    mask_pii: bool = True
    per_source: tuple[dict, ...] = field(default=())
    quarantine: bool = False
    quarantine_margin: float = 0.25
    quarantine_max: int = 5000

    @classmethod
    def read(cls, spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> Options:
        """From a JSON file on any file system. Keys named in ``required`` must be there."""
        given = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        if missing := [k for k in required if k not in given]:
            raise ValueError(f"missing options: {', '.join(missing)}")
        given["per_source"] = tuple(given.get("per_source") or ())
        return cls.of(**given)

    @classmethod
    def of(cls, **given) -> Options:
        """None never replaces a default."""
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(cls(), **{k: v for k, v in given.items() if v is not None})

    def get(self, name: str, source: str = "source") -> Column:
        """A record's value: of the first entry whose match its source contains, whatever the case, else the shared one."""
        out = None
        for entry in self.per_source:
            match = entry.get("match")
            if not isinstance(match, str) or not match:
                continue
            value = entry.get(name)
            value = F.lit(getattr(self, name) if value is None else value)
            hit = (F.col(source) != "") & text.contains_ignoring_case(F.col(source), match)
            out = F.when(hit, value) if out is None else out.when(hit, value)
        return F.lit(getattr(self, name)) if out is None else out.otherwise(F.lit(getattr(self, name)))

    def anywhere(self, name: str) -> bool:
        """Whether a toggle is on for some source."""
        return bool(getattr(self, name)) or any(e.get(name) for e in self.per_source)


def cleaned(records: DataFrame, o: Options) -> DataFrame:
    """Turns after text clean-up and merging."""
    each = lambda f: F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.field.alias("field"), f(t.text).alias("text"), t.extra.alias("extra")))

    def tidy(s: Column) -> Column:
        pick = lambda name, yes, no: F.when(o.get(name), yes).otherwise(no) if o.per_source else (yes if getattr(o, name) else no)
        s = pick("full_width_to_half", text.full_width_to_half(s), s)
        s = text.strip_urls(text.strip_tags(text.strip_control(text.unify_newlines(s))))
        s = pick("mask_pii", text.mask_pii(s), s)
        s = pick("collapse_space", text.collapse_spaces(s), s)
        return text.trim(text.collapse_newlines(s))

    if o.anywhere("clean_text"):
        records = records.withColumn("turns", F.when(o.get("clean_text"), each(tidy)).otherwise(F.col("turns")) if o.per_source else each(tidy))
    if o.anywhere("merge_same_role"):
        talk = F.col("format").isin("chat", "sharegpt")
        records = records.withColumn("turns", F.when(talk & o.get("merge_same_role"), formats.merge_same_role(F.col("turns"))).otherwise(F.col("turns")))
    return records


def measured(records: DataFrame) -> DataFrame:
    ship(records.sparkSession)
    return records.withColumn("m_", text.measures(F.transform("turns", lambda t: t.text))).select(*records.columns, "m_.*")


def _numeric(o: Options) -> list[tuple[str, str, Column, Column]]:
    """rule, metric, threshold, fails; in order."""
    t = {k: o.get(k) for k in ("min_chars", "max_chars", "repeat_ratio", "min_meaningful_ratio")}
    return [
        ("min_chars", "total_chars", t["min_chars"], (t["min_chars"] > 0) & (F.col("total_chars") < t["min_chars"])),
        ("max_chars", "total_chars", t["max_chars"], (t["max_chars"] > 0) & (F.col("total_chars") > t["max_chars"])),
        ("repeat_ratio", "worst_repeat", t["repeat_ratio"], (t["repeat_ratio"] > 0) & (F.col("worst_repeat") > t["repeat_ratio"])),
        ("meaningful_ratio", "meaningful", t["min_meaningful_ratio"], (t["min_meaningful_ratio"] > 0) & (F.col("meaningful") < t["min_meaningful_ratio"])),
    ]


def dedupe_key() -> Column:
    """What makes two cleaned records the same."""
    return F.concat_ws("\u0001", F.to_json("turns"), F.col("rest"))


def joined_text() -> Column:
    return F.array_join(F.transform("turns", lambda t: t.text), "\n")


def verdicts(records: DataFrame, o: Options | None = None, seen: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """records and their metrics, rule (null if kept), metric and threshold of numeric rules.

    seen (key: SHA-256 of the dedupe key) and earlier (simhash) are of rows that came before all of these: the ones that
    weren't invalid or empty, and the kept ones.

    records: line_no, format, source, turns, rest; a null format is no record. The format of the first record
    holds for all. The exact-duplicate key is taken before the thresholds, near duplicates are judged against
    kept rows only.
    """
    o = o or Options()
    first = records.agg(F.min_by("format", F.when(F.col("format").isNotNull(), F.col("line_no"))).alias("f")).first()["f"]
    df = cleaned(records.drop("v").withColumn("ok_", F.coalesce(F.col("format") == F.lit(first), F.lit(False))), o)
    early = F.when(~F.col("ok_"), "invalid")
    if o.anywhere("clean_text"):
        early = early.when(o.get("clean_text") & F.exists(formats.required(F.col("turns")), lambda t: t.text == ""), "empty_after_clean")
    df = measured(df).withColumns({"early_": early, "ends_": formats.ends_on_answer(F.col("turns"), F.col("format"))})
    if o.anywhere("dedupe"):
        # Rows that left earlier, or whose source turns the rule off, have keys of their own.
        unseen = F.col("early_").isNotNull() | ~o.get("dedupe")
        own = F.concat(F.lit("line "), F.col("line_no").cast("string"))
        df = df.withColumn("key_", F.sha2(F.when(unseen, own).otherwise(dedupe_key()), 256))
    # Text is cleaned, measured and digested once; the rules that follow read the figures back, and no text.
    df = settle(df, "measured")
    if o.anywhere("dedupe"):
        df = mark_keyed(df)
        if seen is not None:
            again = seen.select("key").distinct().withColumn("again_", F.lit(True))
            df = df.withColumn("key", F.when(~unseen, F.col("key_"))).join(again, "key", "left")
            df = df.withColumn("repeat", F.col("repeat") | F.coalesce("again_", F.lit(False))).drop("key", "again_")
        df = df.withColumn("early_", F.coalesce("early_", F.when(F.col("repeat"), "dedupe"))).drop("repeat", "key_")
    late = None
    for rule, _, _, fails in _numeric(o):
        late = F.when(fails, rule) if late is None else late.when(fails, rule)
    late = late.when(o.get("require_assistant_end") & ~F.col("ends_"), "ends_assistant")
    df = df.withColumn("late_", late)
    if o.anywhere("fuzzy_dedupe") and (o.simhash_distance > 0):
        df = settle(df, "judged")
        on = o.get("fuzzy_dedupe") & (o.get("simhash_distance") > 0) & F.col("early_").isNull()
        hashed = with_simhash(df.where(on).select("line_no", "late_", joined_text().alias("t")), F.col("t"))
        hashed = settle(hashed.where(F.col("n_tokens") >= o.simhash_min_tokens).select("line_no", "simhash", F.col("late_").isNull().alias("passes")), "hashes")
        if earlier is not None:
            # Kept rows that came before are nodes of their own with smaller numbers; only those that share a band matter.
            mine = hashed.select(F.explode(bands(F.col("simhash"))).alias("b")).select("b.band", "b.key").distinct()
            past = earlier.distinct().select("simhash", F.explode(bands(F.col("simhash"))).alias("b")).select("simhash", "b.band", "b.key").join(mine, ["band", "key"], "left_semi")
            past = past.select("simhash").distinct().select((-1 - F.monotonically_increasing_id()).alias("line_no"), "simhash", F.lit(True).alias("passes"))
            hashed = settle(hashed.unionByName(past), "hashes")
        found = near_blocked(hashed, o.simhash_distance)
        df = df.join(found, "line_no", "left").withColumn("early_", F.coalesce("early_", F.when(F.col("blocked"), "fuzzy_dupe"))).drop("blocked")
    rule = F.coalesce("early_", "late_")
    metric = threshold = F.lit(None).cast("double")
    for name, column, limit, _ in _numeric(o):
        metric = F.when(rule == name, F.col(column).cast("double")).otherwise(metric)
        threshold = F.when(rule == name, limit.cast("double")).otherwise(threshold)
    return df.withColumns({"metric": metric, "threshold": threshold, "rule": rule}).drop("ok_", "early_", "late_", "ends_")


def kept(judged: DataFrame) -> DataFrame:
    return judged.where("rule IS NULL")


def by_rule(judged: DataFrame) -> DataFrame:
    """rule, n over all rules, zeros included."""
    n = judged.where("rule IS NOT NULL").groupBy(F.col("rule").alias("r")).agg(F.count(F.lit(1)).alias("n"))
    names = judged.sparkSession.sql("SELECT explode(array(" + ", ".join(f"'{r}'" for r in RULES) + ")) AS rule")
    return names.join(n, F.col("rule") == F.col("r"), "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_source(judged: DataFrame) -> DataFrame:
    """source, count, kept, removed; rows without a source are (none), and so are invalid ones."""
    tag = F.when((F.col("source") == "") | F.col("source").isNull() | (F.col("rule") == "invalid"), "(none)").otherwise(F.col("source"))
    return judged.groupBy(tag.alias("source")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("rule").isNull()).alias("kept"), F.count_if(F.col("rule").isNotNull()).alias("removed"))


def totals(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count(F.lit(1)).alias("input_lines"), F.count_if(F.col("rule").isNull()).alias("kept_lines"), F.count_if(F.col("rule").isNotNull()).alias("removed_lines"))


def examples(judged: DataFrame, n: int = 10) -> DataFrame:
    """The first dropped rows; a top-k report."""
    return judged.where("rule IS NOT NULL").select("line_no", "rule").orderBy("line_no").limit(n)


#: Rules of the second stage, in the order in which they are applied.
SECOND = ("lang", "inst", "ppl", "semantic_dupe", "topic_downsample")


def marked_examples(judged: DataFrame, n: int = 10) -> DataFrame:
    """stage, line_no, rule, metric, source: the first ``n`` dropped by the rule chain in line order, then the first ``n``
    of the second stage in the order in which they were dropped, rule by rule. A top-k report."""
    place = F.array_position(F.array(*map(F.lit, SECOND)), F.col("rule"))
    rows = judged.where("rule IS NOT NULL").select(F.when(place > 0, 2).otherwise(1).alias("stage"), place.alias("place"), "line_no", "rule", "metric", F.nullif("source", F.lit("")).alias("source"))
    some = rows.where("stage = 1").orderBy("line_no").limit(n).unionByName(rows.where("stage = 2").orderBy("place", "line_no").limit(n))
    return some.orderBy("stage", "place", "line_no").drop("place")


def deviation(rule: Column, metric: Column, threshold: Column) -> Column:
    over = rule.isin(*[k for k, v in OVER.items() if v])
    return F.when(over, (metric - threshold) / threshold).otherwise((threshold - metric) / threshold)


def quarantine(judged: DataFrame, margin: float = 0.25, most: int = 5000) -> DataFrame:
    """Rows dropped by a numeric rule that lie close to its threshold; the first ``most`` in line order."""
    d = deviation(F.col("rule"), F.col("metric"), F.col("threshold"))
    numeric = F.col("rule").isin(*OVER) & (F.col("threshold") > 0) & F.col("metric").isNotNull() & ~F.isnan("metric")
    rows = judged.where(numeric).withColumn("d_", d).where((F.col("d_") > 0) & (F.col("d_") <= margin))
    record = F.to_json(F.struct("format", "source", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns")))
    out = rows.select("line_no", "rule", F.nullif("source", F.lit("")).alias("source"), text.round_half_up(F.col("metric"), 4).alias("metric"), "threshold", text.round_half_up(F.col("d_"), 4).alias("deviation"), F.lit("").alias("decision"), record.alias("record"))
    return out.orderBy("line_no").limit(most)


def rule_stats(quarantined: DataFrame) -> DataFrame:
    """Per rule: count, extremes, and the threshold that would let all of them through."""
    g = quarantined.where("metric IS NOT NULL").groupBy("rule").agg(F.count(F.lit(1)).alias("count"), F.min("metric").alias("min"), F.max("metric").alias("max"))
    return g.withColumn("suggested", F.when(F.col("rule").isin(*[k for k, v in OVER.items() if v]), F.col("max")).otherwise(F.col("min")))

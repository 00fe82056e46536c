"""The cleaning run: scan, verdicts, optional second stage, sinks and summary, as one lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, text
from ..operators import dedupe, rules, scoring, validate
from ..session import settle
from ..sources import jsonl
from . import report


@dataclass(frozen=True)
class SecondStage:
    """Checks that run, in this order, on what the rule chain kept; all off by default."""

    lang: bool = False
    allowed_langs: tuple[str, ...] = ("zh", "en")
    lang_model: scoring.LanguageScorer | None = None  # where it can't be loaded, scripts decide
    inst: bool = False
    ppl: scoring.Scorer | None = None
    ppl_max: float = 150.0
    ppl_min_tokens: int = 32
    vectors: DataFrame | None = None  # line_no, embedding
    semantic_sim: float | None = None
    topic_max_per_cluster: int | None = None


def second_stage(judged: DataFrame, s: SecondStage, o: rules.Options) -> DataFrame:
    """judged with rules lang, inst, ppl, semantic_dupe and topic_downsample filled in; first drop wins."""
    df = judged.withColumn("messages_", formats.messages(F.col("turns"), F.col("format")))
    joined = lambda roles: F.array_join(F.transform(F.filter("messages_", lambda m: m.role.isin(*roles)), lambda m: m.content), "")
    whole = F.array_join(F.transform("messages_", lambda m: m.content), "\n")
    if s.lang:
        df = df.withColumn("asked_", joined(("user", "system"))).withColumn("by_asked_", text.script_shares(F.col("asked_")))
        df = df.withColumn("shares_", F.coalesce(F.col("by_asked_"), text.script_shares(whole)))
        bad, sure = ~text.language_ok(F.col("shares_"), s.allowed_langs), F.greatest(*[F.col("shares_")[k] for k in text.LANGUAGES])
        if s.lang_model is not None:
            probe = F.when(F.col("asked_") != "", F.col("asked_")).otherwise(whole)
            df = scoring.with_language(df.withColumn("probe_", F.when(F.col("rule").isNull(), probe)), F.col("probe_"), s.lang_model, "model_")
            told = (text.trim(F.col("probe_")) != "") & F.col("model_.code").isNotNull()
            bad = F.when(F.col("model_.known"), told & ~F.col("model_.code").isin(*s.allowed_langs)).otherwise(bad)
            sure = F.when(F.col("model_.known"), F.col("model_.probability")).otherwise(sure)
        bad = F.col("rule").isNull() & bad
        df = df.withColumn("bad_", F.coalesce(bad, F.lit(False))).withColumn("metric", F.when(F.col("bad_"), text.round_half_up(sure, 4)).otherwise(F.col("metric")))
        df = df.withColumn("rule", F.when(F.col("bad_"), "lang").otherwise(F.col("rule"))).drop("asked_", "by_asked_", "shares_", "bad_", "probe_", "model_")
    if s.inst:
        df = df.withColumn("rule", F.when(F.col("rule").isNull() & (F.size(formats.instruction_flags(F.col("messages_"))) > 0), "inst").otherwise(F.col("rule")))
    if s.ppl is not None:
        df = settle(df.withColumn("whole_", whole), "second-stage")
        tried = df.where("rule IS NULL").select("line_no", "whole_", F.lit(True).alias("tried"))
        df = df.join(scoring.with_score(tried, F.col("whole_"), s.ppl, "ppl", "n_tokens").drop("whole_"), "line_no", "left")
        df = scoring.judge_perplexity(df, s.ppl_max, s.ppl_min_tokens, o.per_source)
        df = df.withColumns({"metric": F.when(F.col("ppl_fails"), F.col("ppl")).otherwise(F.col("metric")), "threshold": F.when(F.col("ppl_fails"), F.col("ppl_limit")).otherwise(F.col("threshold")), "rule": F.when(F.col("ppl_fails"), "ppl").otherwise(F.col("rule"))}).drop("whole_")
    if s.vectors is not None and (s.semantic_sim or s.topic_max_per_cluster):
        df = settle(df, "second-stage")
        left = df.where("rule IS NULL").select("line_no").join(s.vectors, "line_no")
        if s.semantic_sim:
            found = settle(dedupe.semantic_duplicates(left, "line_no", "embedding", s.semantic_sim), "semantic")
            df = df.join(found, "line_no", "left").withColumn("rule", F.when(F.col("blocked"), "semantic_dupe").otherwise(F.col("rule"))).drop("blocked")
            left = left.join(found.where("NOT blocked").select("line_no"), "line_no")
        if s.topic_max_per_cluster:
            over = dedupe.topic_cap(scoring.clusters(left, "embedding"), "cluster", "line_no", s.topic_max_per_cluster).select("line_no", "over_cap")
            df = df.join(over, "line_no", "left").withColumn("rule", F.when(F.col("over_cap"), "topic_downsample").otherwise(F.col("rule"))).drop("over_cap")
    return df.drop("messages_")


@dataclass
class CleanResult:
    judged: DataFrame
    options: rules.Options

    @property
    def kept(self) -> DataFrame:
        return rules.kept(self.judged)

    @property
    def quarantine(self) -> DataFrame:
        return rules.quarantine(self.judged, self.options.quarantine_margin, self.options.quarantine_max)

    def summary(self) -> dict:
        t = rules.totals(self.judged).first().asDict()
        first = self.judged.where("rule IS NULL OR rule <> 'invalid'").select("format").first()
        return t | {
            "format": first["format"] if first else "empty",
            "by_rule": {r["rule"]: r["n"] for r in rules.by_rule(self.judged).collect()},
            "by_source": {r["source"]: {k: r[k] for k in ("count", "kept", "removed")} for r in rules.by_source(self.judged).collect()},
            "examples": [r.asDict() for r in rules.marked_examples(self.judged).drop("stage").collect()],
        }


def clean(records: DataFrame, o: rules.Options | None = None, second: SecondStage | None = None) -> CleanResult:
    o = o or rules.Options()
    judged = rules.verdicts(records, o)
    if second is not None:
        judged = second_stage(judged, second, o)
    return CleanResult(settle(judged, "verdicts"), o)


def clean_file(spark: SparkSession, path: str, out: str, o: rules.Options | None = None, second: SecondStage | None = None, dry_run: bool = False) -> dict:
    """Clean a JSONL file into another; quarantine files stand beside the output. Returns the summary."""
    jsonl.guard(spark, path, out)
    o = o or rules.Options()
    records = settle(jsonl.scan(spark, path), "lines")
    result = clean(jsonl.records(records, path), o, second)
    # The raw line brings back what the verdicts don't carry: the record's other keys.
    rows = result.kept.select("line_no", "format", "turns").join(records.select("line_no", "raw"), "line_no")
    lines = rows.select("line_no", formats.to_record(formats.parse_json(F.col("raw")), F.col("format"), F.col("turns")).alias("value"))
    lines = settle(lines, "cleaned-lines")
    if not dry_run:
        jsonl.write(lines, out)
    written = jsonl.scan(spark, out) if not dry_run else lines.select("line_no", F.col("value").alias("raw"))
    valid = validate.summary(validate.checked(written)).first()
    found = result.summary() | {"dry_run": dry_run, "output_valid": valid["valid"] or valid["lines"] == 0, "output": "" if dry_run else out}
    if second is not None:
        found["second_stage"] = report.second_stage(result.judged, second)
        if not dry_run:
            report.write_json(spark, found["second_stage"], f"{out}.second-stage.json")
    if o.quarantine:
        held = settle(result.quarantine, "quarantine")
        report.write_quarantine(held, f"{out}.quarantine")
        report.write_text(spark, report.quarantine_html(held, f"Quarantine of {path}", found), f"{out}.quarantine.html")
        found["quarantine"] = held.count()
    return found

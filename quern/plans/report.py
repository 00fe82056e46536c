"""Quarantine and score reports: JSONL, CSV, HTML and text."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import preview
from ..operators import rules, scoring

COLUMNS = ("line_no", "rule", "source", "metric", "threshold", "deviation", "decision")
QUARANTINE = "line_no long, rule string, source string, metric double, threshold double, deviation double, decision string, record string"


def csv_rows(quarantined: DataFrame) -> DataFrame:
    return quarantined.select(F.col("line_no").alias("line"), *COLUMNS[1:], preview(F.col("record"), 400).alias("record_preview"))


def write_quarantine(quarantined: DataFrame, path: str) -> None:
    """JSONL and CSV for a reviewer, in line order."""
    quarantined.orderBy("line_no").write.mode("overwrite").json(f"{path}.jsonl")
    csv_rows(quarantined).orderBy("line").write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}.csv")


def read_quarantine(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """The rows of a quarantine file, perhaps edited since: malformed lines are left out, the first ``most`` in line order stay."""
    rows = spark.read.schema(QUARANTINE).option("mode", "DROPMALFORMED").json(path)
    return rows.where("line_no IS NOT NULL").orderBy("line_no").limit(most)


def write_text(spark: SparkSession, value: str, path: str) -> None:
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).removesuffix("\n")


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    write_text(spark, json.dumps(value, ensure_ascii=False), path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def second_stage(judged: DataFrame, stage) -> dict:
    """The report of the second stage: totals, drops by rule, counts of what could not be scored, perplexities, examples.

    judged: what clean.second_stage() made of the rows. A row whose scorer gave neither score nor tokens was not tokenised;
    one with a score over fewer tokens than the least was too short to be judged.
    """
    own = judged.where("rule IS NULL OR rule IN " + repr(rules.SECOND))
    by_rule = {r["rule"]: r["n"] for r in own.where("rule IS NOT NULL").groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = own.count()
    first = own.select("format").first()
    found = {"total": total, "kept": total - sum(by_rule.values()), "dropped": {r: by_rule.get(r, 0) for r in rules.SECOND}, "format": first["format"] if first else "empty"}
    found |= {"skipped_tokenization": 0, "skipped_ppl_short": 0, "ppl": {}, "by_source": {}, "suggested_ppl_max": None}
    if stage.ppl is not None:
        tried = own.where("tried")
        short = F.col("ppl").isNotNull() & (F.col("n_tokens") < stage.ppl_min_tokens)
        skipped = tried.agg(F.count_if(F.col("n_tokens").isNull() | (F.col("n_tokens") == 0)).alias("t"), F.count_if(short & (F.col("n_tokens") > 0)).alias("s")).first()
        scored = tried.where("scored").withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("(none)")))
        stats = scoring.ppl_stats(scored, "ppl").first()
        fails = {r["source"]: r["n"] for r in scored.groupBy("source").agg(F.count_if("ppl_fails").alias("n")).collect()}
        sources = {r["source"]: {"count": r["count"], "mean_ppl": r["mean"], "p90_ppl": r["p90"], "dropped_ppl": fails[r["source"]]} for r in scoring.ppl_stats(scored, "ppl", "source").collect()}
        has = bool(stats and stats["count"])
        found |= {"skipped_tokenization": skipped["t"], "skipped_ppl_short": skipped["s"], "ppl": stats.asDict() if has else {}, "by_source": sources, "suggested_ppl_max": stats["p90"] if has else None}
    found["examples"] = [{k: r[k] for k in ("line_no", "rule", "metric", "source")} for r in rules.marked_examples(own).collect()]
    found["skipped"] = [] if stage.ppl or stage.vectors is not None else ["no model: neither perplexity nor vectors were asked for"]
    return found


def as_text(found: dict) -> str:
    """A cleaning run in a line."""
    parts = [f"cleaned: {found['input_lines']} -> {found['kept_lines']} lines ({found['removed_lines']} removed, format {found['format']}, output {'valid' if found.get('output_valid') else 'not valid'})"]
    drops = ", ".join(f"{r}={n}" for r, n in found["by_rule"].items() if n)
    parts += [f"by rule: {drops}"] if drops else []
    if "second_stage" in found:
        parts.append("second stage: " + (", ".join(f"{r}={n}" for r, n in found["second_stage"]["dropped"].items() if n) or "nothing dropped"))
    parts += [f"quarantine: {found['quarantine']} rows"] if "quarantine" in found else []
    return " | ".join([*parts, "dry run, nothing written" if found["dry_run"] else f"wrote {found['output']}"])


#: Shows the rows of one rule, and orders rows by a column: by number where both cells are numbers, else by text.
_SCRIPT = """
const table = document.querySelector("table"), body = table.tBodies[0];
document.querySelector("select").onchange = e => {
  for (const row of body.rows) row.hidden = e.target.value !== "all" && row.dataset.rule !== e.target.value;
};
const order = {};
table.tHead.rows[0].onclick = e => {
  const at = e.target.cellIndex;
  const up = order[at] = !order[at];
  const value = row => row.cells[at].textContent.trim();
  const number = x => x === "" ? NaN : Number(x);
  const compare = (x, y) => isNaN(number(x)) || isNaN(number(y)) ? x.localeCompare(y, "zh") : number(x) - number(y);
  body.append(...[...body.rows].sort((a, b) => (up ? 1 : -1) * compare(value(a), value(b))));
};
"""


def quarantine_html(quarantined: DataFrame, title: str = "Quarantine", summary: dict | None = None) -> str:
    """One page, with a choice of rules and columns to order by; the rows are bounded by the quarantine's own limit."""
    e = lambda x: html.escape("" if x is None else str(x), quote=True)
    totals = "".join(f"<span>{e(k.replace('_', ' '))}: {e(summary[k])}</span> " for k in ("input_lines", "kept_lines", "removed_lines", "format")) if summary else ""
    cards = "".join(f"<li><b>{e(r['rule'])}</b> {r['count']} rows, {r['min']} to {r['max']}; suggested {r['suggested']}</li>" for r in rules.rule_stats(quarantined).orderBy("rule").collect())
    choices = "".join(f"<option>{e(r['rule'])}</option>" for r in quarantined.select("rule").distinct().orderBy("rule").collect())
    rows = "".join(
        f"<tr data-rule='{e(r['rule'])}'>" + "".join(f"<td>{e(r[k])}</td>" for k in COLUMNS) + f"<td title='{e((r['record'] or '')[:1000])}'>{e((r['record'] or '')[:240])}</td></tr>"
        for r in quarantined.orderBy("line_no").collect()
    )
    head = "".join(f"<th>{k}</th>" for k in (*COLUMNS, "record"))
    table = f"<table><thead><tr>{head}</tr></thead><tbody>{rows}</tbody></table>"
    return f"<!doctype html><meta charset=utf-8><title>{e(title)}</title><h1>{e(title)}</h1><p>{totals}</p><ul>{cards}</ul><select><option>all</option>{choices}</select>{table}<script>{_SCRIPT}</script>"

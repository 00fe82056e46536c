"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, language, licenses, near_duplicates, packing, pii, quality_rules, token_files, tool_calls, url_rules
from .common import table


def op1_packing(spark, sf_dir):
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.find(spark, table(spark, sf_dir, "documents"))


def op3_licenses(spark, sf_dir):
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op4_tool_calls(spark, sf_dir):
    return tool_calls.link(spark, *tool_calls.from_turns(table(spark, sf_dir, "conversations")))


def op5_quality_rules(spark, sf_dir):
    df = quality_rules.filter_documents(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_token_files(spark, sf_dir):
    path = token_files.file_set(spark, "tokens")
    token_files.write(spark, table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path)


def op7_decontamination(spark, sf_dir):
    return decontamination.find(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates.find(spark, table(spark, sf_dir, "documents"))


def op9_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.default_rules(spark))


def op10_language(spark, sf_dir):
    return language.identify(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_tool_calls": op4_tool_calls,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_rules": op9_url_rules,
    "op10_language": op10_language,
}

ORACLES = {
    "op9_url_rules": """
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT row_number() OVER () AS k, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path,
       arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY k
""",
}

"""The engine's own queries over the driver's tables, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, hashing, text
from ..functions.text import WHITE
from ..operators import dedupe, jobs, rules, scoring, validate
from ..session import settle, ship, spread
from . import clean as clean_plan

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


# --- SQL of the text functions ---------------------------------------------------------------------------

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " "


def _sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {to}, 'g')"


def _mask_sql(x: str) -> str:
    x = _sub(_sub(x, r"\b\d{17}[\dXx]\b", "'[ID]'"), r"\b1[3-9]\d{9}\b", "'[PHONE]'")
    return _sub(x, r"[\w.+-]+@[\w-]+\.[\w.]+", "'[EMAIL]'")


def _trim_sql(x: str) -> str:
    return _sub(x, rf"^[{WHITE}]+|[{WHITE}]+\z")


def _clean_sql(x: str) -> str:
    x = _sub(f"translate({x}, '{_WIDE}', '{_HALF}')", "\r\n?", "chr(10)")
    x = _mask_sql(_sub(_sub(_sub(x, text.CONTROL), text.TAG), text.URL))
    return _trim_sql(_sub(x, "\n{3,}", "chr(10) || chr(10)"))


def _utf16_sql(x: str) -> str:
    return f"(length({x}) + length({_sub(x, r'[^\x{10000}-\x{10FFFF}]')}))"


def _compact_sql(x: str) -> str:
    return _sub(x, rf"[{WHITE}]+")


def _meaningful_sql(x: str) -> str:
    c = _compact_sql(x)
    return f"CASE WHEN length({c}) = 0 THEN 0.0 ELSE length({_sub(c, r'[^\p{L}\p{N}]')})::DOUBLE / {_utf16_sql(c)} END"


_REPEATS = f"""
chars AS (SELECT doc_id, unnest(string_split(c, '')) AS ch, u FROM (SELECT doc_id, {_compact_sql('t')} AS c, {_utf16_sql(_compact_sql('t'))} AS u FROM src) WHERE u >= 5),
ratios AS (SELECT doc_id, max(n)::DOUBLE / any_value(u) AS r FROM (SELECT doc_id, ch, count(*) AS n, any_value(u) AS u FROM chars GROUP BY doc_id, ch) GROUP BY doc_id)"""


# --- 2.3, 2.10: projections and scalar functions ---------------------------------------------------------


@query(f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
def clean_text_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(f"SELECT page_id, {_trim_sql(_sub('html', text.TAG))} AS text FROM pages")
def strip_html_pages(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.trim(text.strip_tags(F.col("html"))).alias("text"))


@query(f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def mask_pii_documents(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.mask_pii(F.col("text")).alias("text"))


#: Inputs of branches that no table reaches: full width, masks, control characters, links, tags, newlines.
_LITERALS = ("１＋１＝２？", "第①题 ﬁle", "电话13800138000好", "a.b+c@example.com 11010119900307723X", "x<b>y\n</b> https://a.b/c?d)e", "a​b﻿c\x07d", "l1\r\nl2\rl3\n\n\n\nend", "  a  b\t\tc ", "a😀中")
_VALUES = ", ".join(f"({i}, {' || '.join(f'chr({ord(c)})' if c < ' ' else chr(39) + c + chr(39) for c in s)})" for i, s in enumerate(_LITERALS))


@query(f"SELECT k, {_clean_sql('s')} AS cleaned, {_sub('s', '[ \t]{2,}', chr(39) + ' ' + chr(39))} AS collapsed, {_utf16_sql('s')}::BIGINT AS units FROM (VALUES {_VALUES}) AS v(k, s)")
def text_literals(spark, sf_dir):
    """Of literals, not of a table: the branches that no table reaches."""
    rows = spark.createDataFrame(list(enumerate(_LITERALS)), "k int, s string")
    return rows.select("k", text.clean_text(F.col("s")).alias("cleaned"), text.collapse_spaces(F.col("s")).alias("collapsed"), text.utf16_length(F.col("s")).alias("units"))


@query(f"SELECT doc_id, {_utf16_sql('text')}::BIGINT AS total_chars, floor({_utf16_sql('text')} / 4.0 + 0.5)::BIGINT AS approx_tokens FROM documents")
def char_totals(spark, sf_dir):
    n = text.utf16_length(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", n.alias("total_chars"), F.floor(n / 4 + 0.5).cast("long").alias("approx_tokens"))


@query(f"SELECT doc_id, round({_meaningful_sql('text')}, 6) AS ratio FROM documents")
def meaningful_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(text.meaningful_ratio(F.array("text")), 6).alias("ratio"))


@query(f"WITH src AS (SELECT doc_id, text AS t FROM documents), {_REPEATS} SELECT src.doc_id, round(coalesce(r, 0.0), 6) AS ratio FROM src LEFT JOIN ratios ON src.doc_id = ratios.doc_id")
def repeat_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(text.worst_repeat_ratio(F.array("text")), 6).alias("ratio"))


_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN {x}::HUGEINT - 18446744073709551616 ELSE {x}::HUGEINT END)::BIGINT"


@query(f"SELECT doc_id, {_signed('h')} AS h FROM (SELECT doc_id, {_FNV.format(x='s')} AS h FROM (SELECT doc_id, lang || ' ' || source || ' ' || n_chars AS s FROM documents))")
def fnv1a64(spark, sf_dir):
    """Of lang, source and n_chars, a short text of each row."""
    ship(spark)
    return _docs(spark, sf_dir).select("doc_id", hashing.fnv1a64_udf(F.concat_ws(" ", "lang", "source", "n_chars")).alias("h"))


_SIMHASH = f"""
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM docs),
weights AS (SELECT doc_id, w, count(*) AS n FROM words GROUP BY doc_id, w),
vocab AS (SELECT w, {_FNV.format(x='w')} AS h FROM (SELECT DISTINCT w FROM weights)),
votes AS (SELECT doc_id, b, sum(CASE WHEN (h >> b) % 2 = 1 THEN n ELSE -n END) AS v FROM (SELECT doc_id, n, h::HUGEINT AS h FROM weights JOIN vocab USING (w)), (SELECT unnest(generate_series(0, 63)) AS b) GROUP BY doc_id, b),
hashes AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << b) ELSE 0 END)::HUGEINT AS h FROM votes GROUP BY doc_id),
sizes AS (SELECT doc_id, sum(n) AS n FROM weights GROUP BY doc_id)"""


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {_SIMHASH} SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_tokens, coalesce({_signed('h')}, 0) AS simhash FROM docs d LEFT JOIN hashes USING (doc_id) LEFT JOIN sizes USING (doc_id)")
def simhash(spark, sf_dir):
    return dedupe.with_simhash(_docs(spark, sf_dir), F.col("text")).select("doc_id", "n_tokens", "simhash")


@query(f"""WITH docs AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), {_SIMHASH},
f AS (SELECT doc_id, {_signed('h')} AS h FROM hashes JOIN sizes USING (doc_id) WHERE n >= 10),
b AS (SELECT doc_id, h, k, (h >> (16 * k)) & 65535 AS key FROM f, (SELECT unnest([0, 1, 2, 3]) AS k))
SELECT DISTINCT x.doc_id AS i, y.doc_id AS j FROM b x JOIN b y ON x.k = y.k AND x.key = y.key AND x.doc_id < y.doc_id WHERE bit_count(xor(x.h, y.h)) <= 8""")
def simhash_pairs(spark, sf_dir):
    return dedupe.near_pairs(_hashed(spark, sf_dir), 8)


def _hashed(spark, sf_dir):
    first = _docs(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("line_no"))
    h = dedupe.with_simhash(first, F.col("text"))
    return settle(h.where(F.col("n_tokens") >= 10).select("line_no", "simhash"), "hashes")


_SHARES = r"""
counts AS (SELECT doc_id, length(regexp_replace(text, '[^\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g')) AS han,
  length(regexp_replace(text, '[^\x{3040}-\x{30FF}]', '', 'g')) AS ja, length(regexp_replace(text, '[^\x{AC00}-\x{D7AF}]', '', 'g')) AS ko,
  len(regexp_extract_all(text, '[A-Za-z]+')) AS en,
  length(regexp_replace(text, '[\x00-\x20!-~\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF5E}\x{FE30}-\x{FE4F}\x{2013}\x{2014}\x{2018}\x{2019}\x{201C}\x{201D}\x{2026}\p{Nd}\x{B2}\x{B3}\x{B9}]', '', 'g')) AS other FROM documents),
shares AS (SELECT doc_id, (CASE WHEN ja > 0 THEN 0 ELSE han END)::DOUBLE / t AS zh, (CASE WHEN ja > 0 THEN ja + han ELSE 0 END)::DOUBLE / t AS ja, ko::DOUBLE / t AS ko, en::DOUBLE / t AS en, other::DOUBLE / t AS other
  FROM (SELECT *, nullif(han + ja + ko + en + other, 0) AS t FROM counts))"""


@query(f"WITH {_SHARES} SELECT doc_id, round(zh, 6) AS zh, round(ja, 6) AS ja, round(ko, 6) AS ko, round(en, 6) AS en, round(other, 6) AS other FROM shares")
def script_shares(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", text.script_shares(F.col("text")).alias("s"))
    return df.select("doc_id", *[F.round(F.col("s")[k], 6).alias(k) for k in text.LANGUAGES])


@query(f"""WITH {_SHARES} SELECT doc_id, coalesce((en = greatest(zh, ja, ko, en, other) AND greatest(zh, ja, ko) < en AND en >= 0.5) OR en >= 0.85, TRUE) AS ok,
CASE greatest(zh, ja, ko, en, other) WHEN zh THEN 'zh' WHEN ja THEN 'ja' WHEN ko THEN 'ko' WHEN en THEN 'en' WHEN other THEN 'other' END AS dominant FROM shares""")
def lang_check(spark, sf_dir):
    df = _docs(spark, sf_dir).select("doc_id", text.script_shares(F.col("text")).alias("s"))
    return df.select("doc_id", text.language_ok(F.col("s"), ("en",)).alias("ok"), text.dominant(F.col("s")).alias("dominant"))


@query("SELECT doc_id, CASE WHEN s = '' THEN 'run' ELSE s END AS slug, CASE WHEN length(text) > 240 THEN left(text, 240) || '…' ELSE text END AS preview FROM (SELECT doc_id, text, regexp_replace(regexp_replace(lower(left(text, 30)), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+\\z', '', 'g') AS s FROM documents)".replace("\\\\", "\\"))
def slugs_and_previews(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.slug(F.left("text", F.lit(30))).alias("slug"), text.preview(F.col("text"), 240).alias("preview"))


# --- conversations ---------------------------------------------------------------------------------------


def _chats(spark, sf_dir):
    return formats.chat_records(_table(spark, sf_dir, "conversations"))


def _joined(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(t.role, F.lit(": "), t.text)), "|")


@query("SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, '|' ORDER BY turn) AS record FROM conversations GROUP BY conv_id")
def chat_records(spark, sf_dir):
    return _chats(spark, sf_dir).select(F.col("line_no").alias("conv_id"), F.size("turns").cast("long").alias("n"), _joined(F.col("turns")).alias("record"))


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 'user' ELSE role END AS role, text FROM conversations),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM t)),
m AS (SELECT conv_id, g, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, g)
SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, '|' ORDER BY g) AS record FROM m GROUP BY conv_id""")
def merge_same_role(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    merged = formats.merge_same_role(F.col("turns"))
    return formats.chat_records(t).select(F.col("line_no").alias("conv_id"), merged.alias("m")).select("conv_id", F.size("m").cast("long").alias("n"), _joined(F.col("m")).alias("record"))


@query("SELECT conv_id, arg_max(role, turn) = 'assistant' AS ok FROM conversations GROUP BY conv_id")
def ends_assistant(spark, sf_dir):
    return _chats(spark, sf_dir).select(F.col("line_no").alias("conv_id"), formats.ends_on_answer(F.col("turns"), F.col("format")).alias("ok"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations)
SELECT conv_id, string_agg(role || ': ' || text, '|' ORDER BY (role <> 'system'), turn) AS messages FROM m WHERE role <> 'system' OR r = 1 GROUP BY conv_id""")
def messages_sharegpt(spark, sf_dir):
    df = _chats(spark, sf_dir).withColumn("format", F.lit("sharegpt"))
    made = formats.messages(F.col("turns"), F.col("format"))
    return df.select(F.col("line_no").alias("conv_id"), F.array_join(F.transform(made, lambda m: F.concat(m.role, F.lit(": "), m.content)), "|").alias("messages"))


def _as_alpaca(spark, sf_dir):
    part = lambda name, c, role: F.struct(F.lit(role).alias("role"), F.lit(name).alias("field"), c.alias("text"), F.lit("{}").alias("extra"))
    blank = F.when(F.col("doc_id") % 2 == 0, F.lit("  ")).otherwise(F.col("lang"))
    made = F.array(part("instruction", F.col("source"), "user"), part("input", blank, "user"), part("output", F.col("text"), "assistant")).cast(formats.TURNS)
    return _docs(spark, sf_dir).select("doc_id", F.lit("alpaca").alias("format"), made.alias("turns"))


@query("SELECT doc_id, 'user: ' || source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || lang END || '|assistant: ' || text AS messages FROM documents")
def messages_alpaca(spark, sf_dir):
    made = formats.messages(F.col("turns"), F.col("format"))
    return _as_alpaca(spark, sf_dir).select("doc_id", F.array_join(F.transform(made, lambda m: F.concat(m.role, F.lit(": "), m.content)), "|").alias("messages"))


@query("""WITH c AS (SELECT conv_id, arg_max(role, turn) AS last, trim(arg_max(text, turn), ' ') AS a, max(turn) AS m FROM conversations GROUP BY conv_id),
p AS (SELECT c.conv_id, trim(coalesce(string_agg(text, '' ORDER BY turn), ''), ' ') AS p FROM c LEFT JOIN conversations t ON t.conv_id = c.conv_id AND turn < m GROUP BY c.conv_id)
SELECT conv_id, CASE WHEN last <> 'assistant' THEN 'no_assistant_answer' ELSE concat_ws(',', CASE WHEN length(a) < 4 AND length(p) > 30 THEN 'answer_too_short' END,
 CASE WHEN regexp_matches(a, '[?？]\\z') AND length(a) < 50 THEN 'answer_is_question' END, CASE WHEN length(p) > 50 AND length(a)::DOUBLE / length(p) < 0.03 THEN 'answer_ratio_too_low' END) END AS flags
FROM c JOIN p USING (conv_id)""")
def inst_flags(spark, sf_dir):
    df = _chats(spark, sf_dir)
    flags = formats.instruction_flags(formats.messages(F.col("turns"), F.col("format")))
    return df.select(F.col("line_no").alias("conv_id"), F.concat_ws(",", flags).alias("flags"))


# --- 1.2, 2.11: formats and validation over rendered JSON ---------------------------------------------------

_LINES = {
    0: ("to_json(named_struct('messages', array(named_struct('role', 'user', 'content', text))))", "to_json({'messages': [{'role': 'user', 'content': text}]})::VARCHAR", "chat"),
    1: ("to_json(named_struct('prompt', source, 'completion', text))", "to_json({'prompt': source, 'completion': text})::VARCHAR", "prompt-completion"),
    2: ("to_json(named_struct('instruction', source, 'output', text))", "to_json({'instruction': source, 'output': text})::VARCHAR", "alpaca"),
    3: ("to_json(named_struct('conversations', array(named_struct('from', 'human', 'value', source), named_struct('from', 'gpt', 'value', text))))", "to_json({'conversations': [{'from': 'human', 'value': source}, {'from': 'gpt', 'value': text}]})::VARCHAR", "sharegpt"),
    4: ("concat('{\"prompt\":', doc_id, ',\"completion\":\"x\"}')", "'{\"prompt\":' || doc_id || ',\"completion\":\"x\"}'", None),
    5: ("concat('{\"prompt\":\"', doc_id)", "'{\"prompt\":\"' || doc_id", None),
}
_CASE = lambda k: " ".join(f"WHEN {i} THEN {v[k]}" for i, v in _LINES.items())


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), F.expr(f"CASE doc_id % 6 {_CASE(0)} END").alias("raw"))


@query("SELECT doc_id AS line_no, CASE WHEN text = '' AND doc_id % 6 < 4 THEN NULL ELSE CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {'NULL' if v[2] is None else repr(v[2])}" for i, v in _LINES.items()) + " END END AS format, doc_id % 6 <> 5 AS parsed FROM documents")
def detect_format(spark, sf_dir):
    v = formats.parse_json(F.col("raw"))
    return _lines(spark, sf_dir).withColumn("v", v).select("line_no", formats.detect(F.col("v")).alias("format"), F.col("v").isNotNull().alias("parsed"))


@query(f"""WITH l AS (SELECT doc_id, CASE doc_id % 6 {_CASE(1)} END AS raw FROM documents), u AS (SELECT doc_id, raw, doc_id % 6 <> 5 AS parsed, {_utf16_sql('raw')} AS n FROM l)
SELECT FALSE AS valid, count(*) AS lines, 'chat' AS format, count(*) FILTER (doc_id % 6 <> 0) AS n_errors, floor(sum(CASE WHEN parsed THEN n ELSE 0 END) / 4.0 + 0.5)::BIGINT AS approx_tokens FROM u""")
def validate_summary(spark, sf_dir):
    found = validate.checked(_lines(spark, sf_dir))
    s = validate.summary(found)
    n = found.agg(F.count("error").alias("n_errors")).withColumn("one", F.lit(1))
    return s.withColumn("one", F.lit(1)).join(n, "one").select("valid", "lines", "format", "n_errors", "approx_tokens")


# --- 2.4 to 2.9: the rule chain ----------------------------------------------------------------------------

_PLAIN = rules.Options.of(fuzzy_dedupe=False, min_chars=60, max_chars=4000, repeat_ratio=0.2, min_meaningful_ratio=0.9, quarantine=True)
_SOURCES = ({"match": "SRC1", "min_chars": 0, "max_chars": 2000}, {"match": "src2", "repeat_ratio": 0.15, "clean_text": False})


def _judged(spark, sf_dir, o=_PLAIN):
    return rules.verdicts(formats.text_records(_docs(spark, sf_dir), "doc_id", "text", "source"), o)


_VERDICT = f"""src AS (SELECT doc_id, source, {_clean_sql('text')} AS t FROM documents), {_REPEATS},
measured AS (SELECT src.*, {_utf16_sql('t')} AS n, coalesce(r, 0.0) AS r, {_meaningful_sql('t')} AS m, row_number() OVER (PARTITION BY (t = ''), t ORDER BY src.doc_id) AS k FROM src LEFT JOIN ratios ON src.doc_id = ratios.doc_id),
judged AS (SELECT *, CASE WHEN t = '' THEN 'empty_after_clean' WHEN k > 1 THEN 'dedupe' WHEN n < 60 THEN 'min_chars' WHEN n > 4000 THEN 'max_chars' WHEN r > 0.2 THEN 'repeat_ratio' WHEN m < 0.9 THEN 'meaningful_ratio' END AS rule FROM measured)"""


@query(f"WITH {_VERDICT} SELECT doc_id, rule FROM judged")
def verdict_first_fail(spark, sf_dir):
    return _judged(spark, sf_dir).select(F.col("line_no").alias("doc_id"), "rule")


@query(f"WITH {_VERDICT} SELECT a.rule, count(j.rule) AS n FROM (SELECT unnest({list(rules.RULES)}) AS rule) a LEFT JOIN judged j ON a.rule = j.rule GROUP BY a.rule")
def by_rule(spark, sf_dir):
    return rules.by_rule(_judged(spark, sf_dir))


@query(f"WITH {_VERDICT} SELECT source, count(*) AS count, count(*) FILTER (rule IS NULL) AS kept, count(*) FILTER (rule IS NOT NULL) AS removed FROM judged GROUP BY source")
def by_source(spark, sf_dir):
    return rules.by_source(_judged(spark, sf_dir))


@query(f"WITH {_VERDICT} SELECT count(*) AS input_lines, count(*) FILTER (rule IS NULL) AS kept_lines, count(*) FILTER (rule IS NOT NULL) AS removed_lines FROM judged")
def clean_totals(spark, sf_dir):
    return rules.totals(_judged(spark, sf_dir))


@query(f"WITH {_VERDICT} SELECT doc_id AS line_no, rule FROM judged WHERE rule IS NOT NULL ORDER BY doc_id LIMIT 10")
def drop_examples(spark, sf_dir):
    return rules.examples(_judged(spark, sf_dir))


@query(f"WITH {_VERDICT} SELECT DISTINCT rule FROM judged WHERE rule IS NOT NULL")
def distinct_rules(spark, sf_dir):
    return _judged(spark, sf_dir).where("rule IS NOT NULL").select("rule").distinct()


_QUARANTINE = f"""{_VERDICT}, q AS (SELECT doc_id, rule, source, metric, threshold, CASE WHEN rule IN ('max_chars', 'repeat_ratio') THEN (metric - threshold) / threshold ELSE (threshold - metric) / threshold END AS d FROM (
 SELECT *, CASE rule WHEN 'min_chars' THEN n WHEN 'max_chars' THEN n WHEN 'repeat_ratio' THEN r WHEN 'meaningful_ratio' THEN m END::DOUBLE AS metric, CASE rule WHEN 'min_chars' THEN 60 WHEN 'max_chars' THEN 4000 WHEN 'repeat_ratio' THEN 0.2 WHEN 'meaningful_ratio' THEN 0.9 END::DOUBLE AS threshold FROM judged) WHERE metric IS NOT NULL),
kept AS (SELECT doc_id AS line_no, rule, source, floor(metric * 10000 + 0.5) / 10000 AS metric, threshold, floor(d * 10000 + 0.5) / 10000 AS deviation FROM q WHERE d > 0 AND d <= 0.25 ORDER BY doc_id LIMIT 5000)"""


@query(f"WITH {_QUARANTINE} SELECT * FROM kept")
def quarantine_rows(spark, sf_dir):
    return rules.quarantine(_judged(spark, sf_dir)).select("line_no", "rule", "source", "metric", "threshold", "deviation")


@query(f"WITH {_QUARANTINE} SELECT rule, count(*) AS count, min(metric) AS min, max(metric) AS max, CASE WHEN rule IN ('max_chars', 'repeat_ratio') THEN max(metric) ELSE min(metric) END AS suggested FROM kept GROUP BY rule")
def rule_stats(spark, sf_dir):
    return rules.rule_stats(rules.quarantine(_judged(spark, sf_dir)))


@query(f"""WITH raw AS (SELECT doc_id, source, text FROM documents), src AS (SELECT doc_id, source, contains(source, 'src1') AS one, contains(source, 'src2') AND NOT contains(source, 'src1') AS two, CASE WHEN contains(source, 'src2') AND NOT contains(source, 'src1') THEN text ELSE {_clean_sql('text')} END AS t FROM raw), {_REPEATS},
measured AS (SELECT src.*, {_utf16_sql('t')} AS n, coalesce(r, 0.0) AS r, {_meaningful_sql('t')} AS m, row_number() OVER (PARTITION BY (t = '' AND NOT two), t ORDER BY src.doc_id) AS k FROM src LEFT JOIN ratios ON src.doc_id = ratios.doc_id)
SELECT doc_id, CASE WHEN t = '' AND NOT two THEN 'empty_after_clean' WHEN k > 1 THEN 'dedupe' WHEN NOT one AND n < 60 THEN 'min_chars' WHEN n > (CASE WHEN one THEN 2000 ELSE 4000 END) THEN 'max_chars' WHEN r > (CASE WHEN two THEN 0.15 ELSE 0.2 END) THEN 'repeat_ratio' WHEN m < 0.9 THEN 'meaningful_ratio' END AS rule FROM measured""")
def per_source_thresholds(spark, sf_dir):
    o = rules.Options.of(fuzzy_dedupe=False, min_chars=60, max_chars=4000, repeat_ratio=0.2, min_meaningful_ratio=0.9, per_source=_SOURCES)
    return _judged(spark, sf_dir, o).select(F.col("line_no").alias("doc_id"), "rule")


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS repeat FROM documents")
def exact_dedupe(spark, sf_dir):
    return dedupe.mark_repeats(_docs(spark, sf_dir), F.col("text"), "doc_id").select("doc_id", "repeat")


_NEAR = "len(list_filter(r.kept, lambda x: bit_count(xor(x, c.h)) <= 8 AND (" + " OR ".join(f"((xor(x, c.h) >> {16 * k}) & 65535) = 0" for k in range(4)) + "))) > 0"
#: Rows c(rn, doc_id, h, passes) one after another, as the rule is worded: near a kept row, or kept if it passes.
_GREEDY = f"""r AS (SELECT 0::BIGINT AS rn, 0::BIGINT AS doc_id, FALSE AS near, []::BIGINT[] AS kept
UNION ALL SELECT rn, doc_id, near, CASE WHEN passes AND NOT near THEN list_append(kept, h) ELSE kept END FROM (SELECT c.*, r.kept, {_NEAR} AS near FROM r JOIN c ON c.rn = r.rn + 1))"""


@query(f"""WITH RECURSIVE docs AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), {_SIMHASH},
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, {_signed('h')} AS h, TRUE AS passes FROM hashes JOIN sizes USING (doc_id) WHERE n >= 10), {_GREEDY}
SELECT doc_id, near AS fuzzy_dupe FROM r WHERE rn > 0""")
def fuzzy_dedupe(spark, sf_dir):
    h = _hashed(spark, sf_dir)
    found = dedupe.near_blocked(h.select("line_no", "simhash", F.lit(True).alias("passes")), 8)
    return found.select(F.col("line_no").alias("doc_id"), F.col("blocked").alias("fuzzy_dupe"))


@query(f"""WITH RECURSIVE src AS (SELECT doc_id, source, {_clean_sql('text')} AS t FROM documents), {_REPEATS},
measured AS (SELECT src.*, {_utf16_sql('t')} AS n, coalesce(r, 0.0) AS r, {_meaningful_sql('t')} AS m, row_number() OVER (PARTITION BY (t = ''), t ORDER BY src.doc_id) AS k FROM src LEFT JOIN ratios ON src.doc_id = ratios.doc_id),
judged AS (SELECT *, CASE WHEN t = '' THEN 'empty_after_clean' WHEN k > 1 THEN 'dedupe' END AS early, CASE WHEN n < 10 THEN 'min_chars' WHEN n > 20000 THEN 'max_chars' WHEN r > 0.5 THEN 'repeat_ratio' WHEN m < 0.2 THEN 'meaningful_ratio' END AS late FROM measured),
docs AS (SELECT doc_id, t AS text FROM judged WHERE early IS NULL), {_SIMHASH},
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id, {_signed('h')} AS h, late IS NULL AS passes FROM hashes JOIN sizes s USING (doc_id) JOIN judged USING (doc_id) WHERE s.n >= 10), {_GREEDY}
SELECT j.doc_id, coalesce(early, CASE WHEN near THEN 'fuzzy_dupe' END, late) AS rule, j.n::BIGINT AS total_chars FROM judged j LEFT JOIN r ON r.doc_id = j.doc_id AND r.rn > 0""")
def clean_documents(spark, sf_dir):
    """The whole chain with its defaults."""
    return _judged(spark, sf_dir, rules.Options()).select(F.col("line_no").alias("doc_id"), "rule", "total_chars")


@query()
def clean_conversations(spark, sf_dir):
    judged = clean_plan.clean(_chats(spark, sf_dir), rules.Options(), clean_plan.SecondStage(lang=True, allowed_langs=("en", "other"), inst=True)).judged
    return judged.select(F.col("line_no").alias("conv_id"), "rule", "total_chars")


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_clean_sql('text')} AS text FROM conversations), i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM t)),
m AS (SELECT conv_id, g, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text FROM i GROUP BY conv_id, g),
c AS (SELECT conv_id, bool_or(text = '') AS e, string_agg(role || ':' || text, '|' ORDER BY g) AS key, arg_max(role, g) AS last, sum({_utf16_sql('text')}) AS n FROM m GROUP BY conv_id),
k AS (SELECT *, row_number() OVER (PARTITION BY e, key ORDER BY conv_id) AS r FROM c)
SELECT conv_id, CASE WHEN e THEN 'empty_after_clean' WHEN r > 1 THEN 'dedupe' WHEN n < 10 THEN 'min_chars' WHEN n > 20000 THEN 'max_chars' WHEN last <> 'assistant' THEN 'ends_assistant' END AS rule, n::BIGINT AS total_chars FROM k""")
def verdict_conversations(spark, sf_dir):
    o = rules.Options.of(fuzzy_dedupe=False, repeat_ratio=0.0, min_meaningful_ratio=0.0)
    return rules.verdicts(_chats(spark, sf_dir), o).select(F.col("line_no").alias("conv_id"), "rule", "total_chars")


# --- second stage --------------------------------------------------------------------------------------------


@query("SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.3")
def cosine_pairs(spark, sf_dir):
    return dedupe.cosine_pairs(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3).select("i", "j")


@query()
def semantic_dedupe(spark, sf_dir):
    return dedupe.semantic_duplicates(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3)


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) > 20 AS over_cap FROM embeddings")
def topic_cap(spark, sf_dir):
    return dedupe.topic_cap(_table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", "vec_id", 20)


@query()
def topic_clusters(spark, sf_dir):
    return dedupe.topic_cap(scoring.clusters(_table(spark, sf_dir, "embeddings"), "embedding"), "cluster", "vec_id", 20).select("vec_id", "cluster", "over_cap")


def _scored(spark, sf_dir):
    """A stand-in for perplexity, n_chars % 997: no model is part of this package, so these queries show the rules and reports only."""
    ppl = (F.col("n_chars") % 997).cast("double") / 4
    df = _docs(spark, sf_dir).select("doc_id", "source", ppl.alias("ppl"), F.floor(F.col("n_chars") / 40).cast("long").alias("n_tokens"))
    return scoring.judge_perplexity(df, 150.0, 32, ({"match": "src3"}, {"match": "SRC1", "ppl_max": 100}))


_PPL = """p AS (SELECT doc_id, source, (n_chars % 997)::DOUBLE / 4 AS ppl, n_chars // 40 >= 32 AS scored, CASE WHEN contains(source, 'src1') THEN 100.0 ELSE 150.0 END AS lim FROM documents)"""
_RANK = lambda q: f"round(s[round_even({q} * (n - 1), 0)::BIGINT + 1], 2)"


@query(f"WITH {_PPL} SELECT doc_id, scored, scored AND ppl > lim AS ppl_fails FROM p")
def ppl_filter(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "scored", "ppl_fails")


@query(f"WITH {_PPL}, g AS (SELECT count(*) AS n, list_sort(list(ppl)) AS s, avg(ppl) AS a FROM p WHERE scored) SELECT n AS count, round(s[1], 2) AS min, round(a, 2) AS mean, {_RANK(0.5)} AS p50, {_RANK(0.9)} AS p90, {_RANK(0.95)} AS p95, {_RANK(0.99)} AS p99, round(s[n], 2) AS max FROM g")
def ppl_report(spark, sf_dir):
    return scoring.ppl_stats(_scored(spark, sf_dir).where("scored"), "ppl")


@query(f"WITH {_PPL}, g AS (SELECT source, count(*) AS n, list_sort(list(ppl)) AS s, avg(ppl) AS a, count(*) FILTER (ppl > lim) AS d FROM p WHERE scored GROUP BY source) SELECT source, n AS count, round(a, 2) AS mean_ppl, {_RANK(0.9)} AS p90_ppl, d AS dropped_ppl FROM g")
def ppl_by_source(spark, sf_dir):
    df = _scored(spark, sf_dir).where("scored")
    stats = scoring.ppl_stats(df, "ppl", "source").select("source", "count", F.col("mean").alias("mean_ppl"), F.col("p90").alias("p90_ppl"))
    return stats.join(df.groupBy("source").agg(F.count_if("ppl_fails").alias("dropped_ppl")), "source")


@query("SELECT doc_id, list_transform(list_concat(list_transform(range(least(len(w), 5)), lambda i: -100), list_transform(w[6:], lambda x: length(x)))[1:60], lambda x: x::INTEGER) AS labels, list_concat(list_transform(w[1:60], lambda x: length(x)::INTEGER), list_transform(range(greatest(0, 60 - len(w))), lambda i: 0))::INTEGER[] AS ids FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def label_mask(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x))
    df = _docs(spark, sf_dir).select("doc_id", ids.alias("full")).withColumn("prompt", F.slice("full", 1, 5))
    return df.select("doc_id", scoring.mask_labels(F.col("full"), F.col("prompt"), 60).alias("labels"), scoring.pad(F.slice("full", 1, 60), F.lit(60), 0).alias("ids"))


# --- jobs ----------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def status_changes(spark, sf_dir):
    return jobs.status_changes(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""WITH f AS (SELECT event_id, user_id, ts, (value < 50)::INT AS bad FROM events), i AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM f)
SELECT event_id, r::BIGINT AS run, r >= 3 AS stopped FROM (SELECT event_id, sum(bad) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r FROM i)""")
def error_runs(spark, sf_dir):
    return jobs.error_runs(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50).select("event_id", "run", "stopped")


@query("SELECT 'job-' || event_id AS jobId, lower(event_type) AS status, lower(event_type) IN ('succeeded', 'failed', 'cancelled', 'canceled') AS terminal, NULL::VARCHAR AS model FROM events")
def normalise_jobs(spark, sf_dir):
    raw = _table(spark, sf_dir, "events").select(F.to_json(F.struct(F.concat(F.lit("job-"), "event_id").alias("fine_tuning_job_id"), F.upper("event_type").alias("status"))).alias("json"))
    return jobs.normalise(raw, "json").select("jobId", "status", "terminal", "model")

"""What grows with the input: sides sent by the driver, pairs that are made, texts looked at."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import dedupe
from quern.plans import catalogue

from .test_engine import sequential
from .test_runs import hashes


def test_no_exploded_rows_are_sent_by_the_driver(spark, tmp_path):
    """Files of few bytes hold many rows, and bands make them four times as many."""
    spark.range(5000).selectExpr("id AS line_no", "id * 7919 AS simhash").write.parquet(str(tmp_path / "h"))
    df = dedupe.near_pairs(spark.read.parquet(str(tmp_path / "h")), 8)
    joins = [x for x in df._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x]
    assert [x for x in joins if "Inner" in x] and not [x for x in joins if "Inner" in x and "Broadcast" in x]


@pytest.mark.parametrize("first, last", [(3, 0), (40, 25), (256, 4000)])
def test_greedy_removal_makes_pairs_with_kept_rows_only(spark, monkeypatch, first, last):
    def never(*_, **__):
        raise AssertionError("all near pairs are made")

    monkeypatch.setattr(dedupe, "near_pairs", never)
    rows = [(i, h, i % 5 != 2) for i, h in enumerate(hashes(random.Random(6), 5))]
    df = spark.createDataFrame(rows, "line_no long, simhash long, passes boolean")
    got = {r.line_no: r.blocked for r in dedupe.near_blocked(df, 8, first=first, last=last).collect()}
    assert got == sequential(rows) and any(got.values())


def test_cosine_of_floats_as_sql_rounds_it(spark, tmp_path):
    """Pairs whose cosine is a float's rounding from the threshold."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 64)).astype(np.float32)
    file = str(tmp_path / "e.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(file)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{file}/*.parquet'")
    every = "SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding, b.embedding) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"
    values = sorted({r[2] for r in c.sql(every).fetchall()})
    for least in values[:: len(values) // 12]:
        want = set(c.sql(f"SELECT i, j FROM ({every}) WHERE s >= {least!r}::FLOAT").fetchall())
        i, j, _ = dedupe._similar(x, x, least)
        assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b} == want
    df = spark.read.parquet(file)
    assert {(r.i, r.j) for r in dedupe.cosine_pairs(df, "vec_id", "embedding", least, 4, 9).collect()} == want


@pytest.mark.parametrize("size", [64, 640, 1 << 20])
@pytest.mark.parametrize("least", [0.3, 0.9, 0.9999])
def test_semantic_duplicates_in_rounds(spark, least, size):
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.2 * rng.standard_normal((20, 8)) for c in 3 * rng.standard_normal((4, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(rng.permutation(x))] + [(900, None), (901, []), (902, [0.0] * 8)]
    u = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:-3]}
    kept, want = [], {900: False, 901: False, 902: False}
    for i, v in u.items():
        want[i] = any(v @ w >= least for w in kept)
        if not want[i]:
            kept.append(v)
    df = spark.createDataFrame(rows, "k long, v array<double>")
    assert {r.k: r.blocked for r in dedupe.semantic_duplicates(df, "k", "v", least, size).collect()} == want


def test_semantic_duplicates_make_no_pairs_of_near_rows(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "cosine_pairs", lambda *_, **__: 1 / 0)
    df = spark.range(3000).selectExpr("id AS k", "array(1.0D, id % 3, id % 2) AS v")
    assert dedupe.semantic_duplicates(df, "k", "v", 0.9999, 2400).where("NOT blocked").count() == 6


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """Each character at both ends and inside, most of them by themselves, others in a row."""
    codes = [k for k in (*range(1, 0x3400), *range(0x9F00, 0xAE00), *range(0xD700, 0xD800), *range(0xF800, 0x10400), *range(0x1F000, 0x1F800), *range(0x2EB00, 0x2EF00)) if not 0xD800 <= k < 0xE000]
    rng = random.Random(7)
    rows = [chr(k) + "x1" + chr(k) + "y" + chr(k) for k in codes] + ["".join(chr(rng.choice(codes)) for _ in range(rng.randrange(60))) for _ in range(500)] + ["", " ", "aaaa", "a a a a a"]
    file = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4).write.parquet(file)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{file}/*.parquet'")
    return spark.read.parquet(file), c


def test_texts_of_any_character_are_cleaned_as_sql_does(odd_texts):
    df, c = odd_texts
    want = c.sql(f"SELECT doc_id, {catalogue._trim_sql(catalogue._sub('text', text.CONTROL))} FROM documents").fetchall()
    got = df.select("doc_id", text.trim(text.strip_control(F.col("text")))).collect()
    assert dict(map(tuple, got)) == dict(want)


@pytest.mark.parametrize("name, column", [("meaningful_ratio", text.meaningful_ratio), ("repeat_ratio", text.worst_repeat_ratio), ("char_totals", lambda x: text.measures(x).total_chars)])
def test_texts_of_any_character_are_measured_as_sql_does(odd_texts, name, column):
    df, c = odd_texts
    want = {r[0]: r[1] for r in c.sql(catalogue.SQL[name]).fetchall()}
    got = df.select("doc_id", F.round(column(F.array("text")), 6)).collect()
    assert {k: round(v, 6) for k, v in got} == pytest.approx(want, abs=1e-6)


def test_scripts_are_counted_as_by_patterns(odd_texts):
    """By the patterns that were used before, and by no string for each match."""
    df, _ = odd_texts
    n = lambda p: F.regexp_count("text", F.lit(p))
    white = text.WHITE.replace(r"\x{FEFF}", "")
    neutral = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in text.NEUTRAL) + "]"
    han, kana, hangul = n(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"), n(r"[\x{3040}-\x{30FF}]"), n(r"[\x{AC00}-\x{D7AF}]")
    quiet = n(rf"[A-Za-z\p{{Nd}}\x{{B2}}\x{{B3}}\x{{B9}}!-/:-@\[-`{{-~\x{{1C}}-\x{{1F}}\x{{85}}{white}]") + n(neutral) - n(r"[\x{3000}\x{A0}]")
    want = {"zh": F.when(kana > 0, 0).otherwise(han), "ja": F.when(kana > 0, kana + han).otherwise(kana), "ko": hangul, "en": n("[A-Za-z]+"), "other": F.length("text") - quiet - han - kana - hangul}
    wrong = df.withColumn("c", text.script_counts("text")).where(~(F.struct(*[F.col("c")[k].alias(k) for k in want]) == F.struct(*[v.cast("long").alias(k) for k, v in want.items()])))
    assert not wrong.collect()
    assert "regexp" not in df.select(text.script_shares(F.col("text")), text.meaningful_ratio(F.array("text")))._jdf.queryExecution().optimizedPlan().toString()


def test_rules_read_no_text_once_it_is_measured(spark, sf):
    plan = catalogue.QUERIES["verdict_first_fail"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "turns" not in plan


def test_lines_are_parsed_once(spark, sf):
    plan = catalogue.QUERIES["validate_summary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan.replace("invalid_json", "")


def test_cleaning_of_conversations_makes_no_near_pairs(spark, sf, monkeypatch):
    monkeypatch.setattr(dedupe, "near_pairs", lambda *_, **__: 1 / 0)
    assert catalogue.QUERIES["clean_conversations"](spark, sf).count()

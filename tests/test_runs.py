"""Second stage, reports, gates, streams and near duplicates at scale, against in-code fixtures and sequential models."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import formats
from quern.operators import dedupe, jobs, rules, scoring, validate
from quern.plans import clean, report, training
from quern.sources import jsonl
from quern.streaming.clean_stream import CleanStream, ValidateStream

from .test_engine import DIRTY, OTHER, QA, chat, dropped, judged, sequential, write_lines


def hashes(rng, copies):
    """Hashes of which many share a band, many are near, and some are equal."""
    mask, out = 2**64 - 1, []
    for band in (0x1234, 0x00FF):
        base = rng.getrandbits(64) & ~0xFFFF | band
        for _ in range(150):
            h = base
            for b in rng.sample(range(16, 64), rng.randrange(12)):
                h ^= 1 << b
            out += [h & mask] * rng.randrange(1, copies)
    out += [rng.getrandbits(64) for _ in range(60)]
    rng.shuffle(out)
    return [h - (1 << 64) if h >> 63 else h for h in out]


@pytest.mark.parametrize("bucket", [20, 100_000])
def test_near_rows_of_a_hot_band_and_of_equal_hashes(spark, bucket):
    rows = [(i, h, i % 5 != 2) for i, h in enumerate(hashes(random.Random(6), 5))]
    df = spark.createDataFrame(rows, "line_no long, simhash long, passes boolean")
    got = {r.line_no: r.blocked for r in dedupe.near_blocked(df, 8, bucket).collect()}
    assert got == sequential(rows)
    near = dedupe.near_pairs(df, 8, bucket=bucket).collect()
    u = [h & (2**64 - 1) for _, h, _ in rows]
    share = lambda a, b: any((a >> 16 * k) & 65535 == (b >> 16 * k) & 65535 for k in range(4))
    want = {(i, j) for j in range(len(u)) for i in range(j) if (u[i] ^ u[j]).bit_count() <= 8 and share(u[i], u[j])}
    assert len(near) == len(want) and {tuple(r) for r in near} == want


@pytest.mark.parametrize("least", [0.3, 0.95])
def test_cosine_pairs_in_blocks(spark, least):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.2 * rng.standard_normal((60, 8)) for c in 3 * rng.standard_normal((4, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for j in range(len(u)) for i in range(j) if u[i] @ u[j] >= least}
    for pivots, block in ((256, 4000), (5, 7), (1, 1000)):
        got = dedupe.cosine_pairs(df, "k", "v", least, pivots, block).collect()
        assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    assert dedupe.cosine_pairs(df.where("k > 899"), "k", "v", least).count() == 0
    assert not any(r.blocked for r in dedupe.semantic_duplicates(df.where("k > 899"), "k", "v").collect())


def test_topic_cap_and_quantiles_of_hot_groups(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), float(rng.randrange(40))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, c string, x double")
    seen, over = {}, {}
    for k, c, _ in rows:
        seen[c] = seen.get(c, 0) + 1
        over[k] = seen[c] > 300
    assert {r.k: r.over_cap for r in dedupe.topic_cap(df, "c", "k", 300, 4).collect()} == over
    for group in ((), ("c",)):
        for r in scoring.ppl_stats(df, "x", *group).collect():
            xs = sorted(x for _, c, x in rows if not group or c == r.c)
            assert (r["count"], r.min, r.max, r.mean) == (len(xs), xs[0], xs[-1], round(sum(xs) / len(xs), 2))
            assert [r.p50, r.p90, r.p95, r.p99] == [xs[round(q * (len(xs) - 1))] for q in (0.5, 0.9, 0.95, 0.99)]
    assert scoring.ppl_stats(df.limit(0), "x").first()["count"] is None


WORDS = "river stone cloud paper window garden bridge copper silver market winter summer letter doctor engine forest valley harbour candle mirror".split()


def near_chain(spark):
    """E is near A, A is near B, E isn't near B: texts found by search."""
    rng = random.Random(1)
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(60)]
    texts, at = [" ".join(base)], 0
    while len(texts) < 400:
        base[at % 60] = rng.choice(WORDS) + str(rng.randrange(50))
        at += 1
        texts.append(" ".join(base))
    one = lambda t: chat(("user", t), ("assistant", "It is an answer."))
    df = spark.createDataFrame([(i, f"{t}\nIt is an answer.") for i, t in enumerate(texts)], "k long, t string")
    h = {r.k: r.simhash & (2**64 - 1) for r in dedupe.with_simhash(df, F.col("t")).collect()}
    share = lambda a, b: any((a >> 16 * k) & 65535 == (b >> 16 * k) & 65535 for k in range(4))
    near = lambda a, b: (h[a] ^ h[b]).bit_count() <= 8 and share(h[a], h[b])
    e, a, b = next((e, a, b) for e in range(400) for a in range(e + 1, min(400, e + 40)) for b in range(a + 1, min(400, a + 40)) if near(e, a) and near(a, b) and not near(e, b))
    return [one(texts[k]) for k in (e, a, b)]


def test_stream_keeps_what_a_blocked_row_would_block(spark, tmp_path):
    records = near_chain(spark)
    assert dropped(judged(spark, tmp_path, records)) == [None, "fuzzy_dupe", None]
    (tmp_path / "in").mkdir()
    stream = CleanStream(spark, f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    for name, part in (("a", records[:1]), ("b", records[1:])):
        write_lines(tmp_path / "in" / f"{name}.jsonl", part)
        stream.start(f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("line_no").collect()
    assert [r.rule for r in got] == [None, "fuzzy_dupe", None]


def test_streaming_validation(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = ValidateStream(spark, f"file://{tmp_path}/state")
    assert stream.summary().first().format == "empty"
    parts = [[QA, "x"], [{"prompt": "p", "completion": "c"}, OTHER]]
    for name, part in zip("ab", parts, strict=True):
        write_lines(tmp_path / "in" / f"{name}.jsonl", part)
        stream.start(f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination(120)
    whole = validate.summary(validate.checked(jsonl.scan(spark, write_lines(tmp_path / "all.jsonl", sum(parts, []))))).first()
    assert stream.summary().first() == whole and [(e.line, e.message) for e in whole.errors] == [(2, "invalid_json"), (3, "mixed_format")]


def test_gates(spark, tmp_path):
    good = jsonl.scan(spark, write_lines(tmp_path / "a.jsonl", [QA, OTHER]))
    assert validate.require_valid(good)["lines"] == 2
    with pytest.raises(ValueError, match="line 2: invalid_json"):
        validate.require_valid(jsonl.scan(spark, write_lines(tmp_path / "b.jsonl", [QA, "x"])))
    with pytest.raises(ValueError, match="the file is empty"):
        validate.require_valid(jsonl.scan(spark, write_lines(tmp_path / "c.jsonl", [])))
    with pytest.raises(ValueError, match="every record"):
        validate.require_kept({"kept_lines": 0})


RECORDS = [
    (1, "hello there, my friend", "web"),
    (2, "你好世界你好世界你好，今天的天气很好。", "web"),
    (3, "a long sentence about rivers and the stones that lie in them", "code"),
    (4, "another sentence, about markets in winter", ""),
    (5, "short", ""),
    (6, "untokenised words in a row here", "web"),
]


def stage(spark, **more):
    records = formats.text_records(spark.createDataFrame(RECORDS, "k long, t string, s string"), "k", "t", "s")

    def load():
        return lambda xs: [None if "untokenised" in x else (float(len(x)), len(x) // 2) for x in xs]

    s = clean.SecondStage(ppl=load, ppl_max=50.0, ppl_min_tokens=12, **more)
    return clean.clean(records, rules.Options.of(fuzzy_dedupe=False, min_chars=3), s), s


def test_second_stage_report(spark):
    run, s = stage(spark)
    assert dropped(run.judged) == [None, None, "ppl", None, None, None]
    found = report.second_stage(run.judged, s)
    assert (found["total"], found["kept"], found["dropped"]["ppl"]) == (6, 5, 1)
    assert (found["skipped_tokenization"], found["skipped_ppl_short"]) == (1, 3)  # 11, 9 and 2 tokens
    assert found["ppl"]["count"] == 2 and found["suggested_ppl_max"] == found["ppl"]["p90"] == 60.0
    assert found["by_source"] == {"code": {"count": 1, "mean_ppl": 60.0, "p90_ppl": 60.0, "dropped_ppl": 1}, "(none)": {"count": 1, "mean_ppl": 41.0, "p90_ppl": 41.0, "dropped_ppl": 0}}
    assert found["examples"] == [{"line_no": 3, "rule": "ppl", "metric": 60.0, "source": "code"}]


def test_tokens_of_scripts_without_spaces(spark):
    df = spark.createDataFrame([("你好世界 abc, d",), ("かな",), ("",)], "t string")
    assert [r[0] for r in df.select(scoring.estimated_tokens(F.col("t"))).collect()] == [6, 2, 0]


def test_language_model_and_its_absence(spark):
    def model():
        return lambda xs: [("fr", 0.91) if "rivers" in x else ("en", 0.8) for x in xs]

    def absent():
        raise ImportError("no such model")

    found, _ = stage(spark, lang=True, allowed_langs=("en",), lang_model=model)
    assert [(r.rule, r.metric) for r in found.judged.where("line_no IN (2, 3)").orderBy("line_no").collect()] == [(None, None), ("lang", 0.91)]
    found, _ = stage(spark, lang=True, allowed_langs=("en",), lang_model=absent)
    by_script, _ = stage(spark, lang=True, allowed_langs=("en",))
    assert dropped(found.judged) == dropped(by_script.judged) and dropped(found.judged)[1] == "lang"


def test_examples_in_the_order_of_marking(spark):
    rows = [(i, "s", r, 1.0) for i, r in enumerate(["ppl", "lang", "dedupe", None, "inst", "invalid", "lang"])]
    df = spark.createDataFrame(rows, "line_no long, source string, rule string, metric double")
    assert [(r.stage, r.line_no, r.rule) for r in rules.marked_examples(df).collect()] == [(1, 2, "dedupe"), (1, 5, "invalid"), (2, 1, "lang"), (2, 6, "lang"), (2, 4, "inst"), (2, 0, "ppl")]
    many = spark.range(50).selectExpr("id AS line_no", "'' AS source", "CASE WHEN id % 2 = 0 THEN 'dedupe' ELSE 'lang' END AS rule", "0.0D AS metric")
    assert rules.marked_examples(many).count() == 20


def test_file_reports(spark, tmp_path):
    source = write_lines(tmp_path / "in.jsonl", [r for r, _ in DIRTY] + [{"messages": [{"role": "user", "content": "a" * 11 + "bcdefghij"}, {"role": "assistant", "content": "zyxwvut, and so on."}]}])
    out = f"{tmp_path}/out"
    found = clean.clean_file(spark, source, out, rules.Options.of(quarantine=True), clean.SecondStage(inst=True))
    assert found["output_valid"] and found["quarantine"] == 1
    assert report.as_text(found).startswith("cleaned: 13 -> 3 lines (10 removed, format chat, output valid) | by rule: invalid=2")
    page = report.read_text(spark, f"{out}.quarantine.html")
    assert "<script>" in page and "localeCompare" in page and "kept lines: 3" in page
    assert report.read_json(spark, f"{out}.second-stage.json")["kept"] == 3
    (tmp_path / "out.quarantine.jsonl" / "part-zz.json").write_text("{broken\n")
    assert [r.rule for r in report.read_quarantine(spark, f"{out}.quarantine.jsonl").collect()] == ["repeat_ratio"]
    dry = clean.clean_file(spark, source, f"{tmp_path}/dry", dry_run=True)
    assert dry["output_valid"] and not (tmp_path / "dry").exists() and report.as_text(dry).endswith("dry run, nothing written")
    none = clean.clean_file(spark, write_lines(tmp_path / "bad.jsonl", ["x"]), f"{tmp_path}/none")
    assert none["output_valid"] and none["kept_lines"] == 0
    with pytest.raises(ValueError):
        jsonl.guard(spark, source, f"file:{source}")


def test_blank_lines_can_count(spark, tmp_path):
    path = tmp_path / "b.jsonl"
    path.write_text("\na\n \r\nb\n")
    assert [(r.line_no, r.raw) for r in jsonl.scan(spark, str(path), count_blank=True).orderBy("line_no").collect()] == [(2, "a"), (4, "b")]


def test_options_from_a_file(spark, tmp_path):
    path = tmp_path / "o.json"
    path.write_text(json.dumps({"min_chars": 4, "max_chars": None, "per_source": [{"match": "x", "min_chars": 1}]}))
    o = rules.Options.read(spark, str(path), ("min_chars",))
    assert (o.min_chars, o.max_chars, o.per_source) == (4, 20000, ({"match": "x", "min_chars": 1},))
    with pytest.raises(ValueError, match="repeat_ratio"):
        rules.Options.read(spark, str(path), ("repeat_ratio",))


def test_training_runs(spark, tmp_path):
    source = write_lines(tmp_path / "in.jsonl", [QA, QA, OTHER])
    now = datetime(2026, 1, 2, 3, 4, 5)
    run = training.prepare(spark, source, str(tmp_path), "m", cleaned=True, name="My Run", now=now, epochs=2, lora_r=None)
    assert run["run_id"] == "2026-01-02T03-04-05-my-run" and run["samples"] == 2
    made = report.read_json(spark, f"{run['output_dir']}/config.json")
    assert made["num_epochs"] == 2 and "lora_r" not in made and jsonl.scan(spark, made["data_path"]).count() == 2
    with pytest.raises(TypeError):
        training.config("m", "d", "o", speed=1)
    with pytest.raises(ValueError):
        training.prepare(spark, write_lines(tmp_path / "bad.jsonl", ["x"]), str(tmp_path), "m")


def test_training_samples(spark):
    def load():
        def encode(turns, asks):
            if turns[0][1] == "refuse":
                raise ValueError("no")
            return [len(w) for _, c in turns for w in c.split()] + ([9] if asks and turns[0][1] == "off" else [])

        return encode

    talk = lambda *turns: [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(turns)]
    rows = [(1, talk("a bb", "ccc dddd e")), (2, talk("a")), (3, talk("refuse", "x")), (4, talk("a b c d", "e")), (5, talk("off", "ab c")), (6, [])]
    df = spark.createDataFrame(rows, "k int, m array<struct<role:string,content:string>>")
    got = {r.k: (r.input_ids, r.labels) for r in scoring.training_samples(df, F.col("m"), load, 4).collect()}
    assert got == {1: ([1, 2, 3, 4], [-100, -100, 3, 4]), 5: ([3, 2, 1], [3, 2, 1])}


def test_perplexity_and_pooling(spark):
    from math import exp

    df = spark.createDataFrame([([1.0, 3.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([], [], [])], "l array<double>, h array<array<double>>, m array<int>")
    got = df.select(scoring.perplexity(F.col("l")).alias("p"), scoring.mean_pool(F.col("h"), F.col("m")).alias("v")).collect()
    assert abs(got[0].p - exp(2)) < 1e-12 and got[0].v == [2.0, 3.0] and got[1].p is None and got[1].v is None


def test_logs_and_polls(spark):
    lines = spark.range(1, 30).selectExpr("id AS line_no", "concat('l', id) AS value")
    assert [r.value for r in jobs.tail(lines, 3).collect()] == ["l27", "l28", "l29"]
    polls = spark.createDataFrame([("a", 1, "running"), ("a", 2, "Succeeded"), ("a", 3, "succeeded"), ("b", 1, "failed"), ("b", 2, "running")], "job string, at int, status string")
    assert sorted((r.job, r.at) for r in jobs.until_terminal(polls, "job", ["at"], "status").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_one_job_and_a_limit():
    from quern.sources import rest

    asked = []
    client = lambda options: lambda path: asked.append(path) or ({"id": "j"} if path.endswith("/j") else {"data": [{"id": k} for k in range(5)]})
    read = lambda **o: [json.loads(r[0])["id"] for r in rest._Reader(o, client).read(None)]
    assert read(job="j") == ["j"] and read(limit="2") == [0, 1] and asked == ["fine_tuning/jobs/j", "fine_tuning/jobs?limit=2"]

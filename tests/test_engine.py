"""The cleaning engine against in-code fixtures and a sequential model."""

import json

import pytest
from pyspark.sql import functions as F

from quern.functions import formats, hashing, text
from quern.operators import dedupe, jobs, rules, scoring, validate
from quern.plans import catalogue, clean, report
from quern.sources import jsonl
from quern.streaming.clean_stream import CleanStream

QA = {"messages": [{"role": "user", "content": "How do I sort a list in Python?"}, {"role": "assistant", "content": "Call sorted on it, or its own sort method."}]}
OTHER = {"messages": [{"role": "user", "content": "Name three rivers."}, {"role": "assistant", "content": "Rhine, Loire and Ebro, for example."}]}


def chat(*turns):
    return {"messages": [{"role": r, "content": c} for r, c in turns]}


DIRTY = [
    (QA, None),
    (QA, "dedupe"),
    ("this is not json", "invalid"),
    ({"instruction": "do", "output": "done"}, "invalid"),
    (chat(("user", "ok"), ("assistant", "y")), "min_chars"),
    (chat(("user", "a" * 40), ("assistant", "b" * 40)), "repeat_ratio"),
    (chat(("user", "哈" * 12), ("assistant", "哈" * 12)), "repeat_ratio"),
    (chat(("user", "😀🎉😂🤣😊"), ("assistant", "😅😇🙂🙃😉😌")), "meaningful_ratio"),
    (chat(("user", "a question"), ("assistant", "an answer"), ("user", "one more question")), "ends_assistant"),
    (chat(("user", "https://example.com/a"), ("assistant", "https://example.com/b")), "empty_after_clean"),
    (chat(("user", "<b>看看这个</b> https://example.com 页面\x00​"), ("user", "还有这个"), ("assistant", "好的，这两个页面我都看过了。")), None),
    (OTHER, None),
]


def write_lines(path, records):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in records) + "\n\n", encoding="utf-8")
    return str(path)


def judged(spark, tmp_path, records, **o):
    lines = jsonl.scan(spark, write_lines(tmp_path / "in.jsonl", records))
    return rules.verdicts(jsonl.records(lines), rules.Options.of(**o))


def dropped(df):
    return [r.rule for r in df.select("line_no", "rule").orderBy("line_no").collect()]


def test_dirty_set(spark, tmp_path):
    df = judged(spark, tmp_path, [r for r, _ in DIRTY])
    assert dropped(df) == [w for _, w in DIRTY]
    assert sum(r.n for r in rules.by_rule(df).collect()) == 9 and rules.by_rule(df).count() == 14
    turns = df.where("line_no = 11").first().turns
    assert [t.text for t in turns] == ["看看这个  页面\n还有这个", "好的,这两个页面我都看过了。"]
    off = judged(spark, tmp_path, [r for r, _ in DIRTY], min_chars=0, max_chars=0)
    assert dropped(off).count(None) == 4


def test_file_to_file(spark, tmp_path):
    source = write_lines(tmp_path / "in.jsonl", [{**r, "extra": {"k": [1, 2]}} if isinstance(r, dict) else r for r, _ in DIRTY])
    found = clean.clean_file(spark, source, str(tmp_path / "out"), rules.Options.of(quarantine=True))
    out = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert found["kept_lines"] == 3 == len(out) and found["by_rule"]["invalid"] == 2
    assert out[0] == {**QA, "extra": {"k": [1, 2]}} and [m["role"] for m in out[1]["messages"]] == ["user", "assistant"]
    with pytest.raises(ValueError):
        clean.clean_file(spark, source, source)


def test_formats_and_validation(spark, tmp_path):
    records = [
        QA, {"prompt": "p", "completion": "c"}, {"instruction": "i", "output": "o", "input": None}, {"instruction": "i", "output": "o", "input": 5},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"conversations": [{"from": "gpt", "value": "a"}, {"from": "human", "value": "q"}]},
        {"messages": [{"role": "user", "content": 5}]}, {"messages": []}, '{"prompt":"p","completion":"c"}x', "[1]",
    ]
    lines = jsonl.scan(spark, write_lines(tmp_path / "f.jsonl", records))
    got = [r.format for r in jsonl.records(lines).orderBy("line_no").collect()]
    assert got == ["chat", "prompt-completion", "alpaca", None, "sharegpt", None, None, None, None, None]
    s = validate.summary(validate.checked(lines)).first()
    assert not s.valid and s.lines == 10 and s.format == "chat" and len(s.errors) == 9 and s.errors[0].line == 2
    one = jsonl.scan(spark, write_lines(tmp_path / "g.jsonl", [QA]))
    s = validate.summary(validate.checked(one)).first()
    raw = json.dumps(QA, ensure_ascii=False)
    assert s.valid and s.approx_tokens == int(len(raw) / 4 + 0.5) and s.preview == raw[:400]
    blank = jsonl.scan(spark, write_lines(tmp_path / "h.jsonl", ["", "  "]))
    s = validate.summary(validate.checked(blank)).first()
    assert not s.valid and s.format == "empty" and s.lines == 0


def test_sharegpt_roles_merge(spark, tmp_path):
    rec = {"conversations": [{"from": "human", "value": "第一个问题"}, {"from": "user", "value": "第二个问题"}, {"from": "gpt", "value": "这是一个很好的回答"}]}
    turns = judged(spark, tmp_path, [rec]).first().turns
    assert [t.text for t in turns] == ["第一个问题\n第二个问题", "这是一个很好的回答"] and turns[0].role == "human"


def test_scalars(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert one(text.clean_text, "１＋１＝２？") == "1+1=2?" and one(text.clean_text, "第①题 ﬁle") == "第①题 ﬁle"
    assert one(text.clean_text, "电话13800138000好 a.b+c@example.com 11010119900307723X") == "电话[PHONE]好 [EMAIL] [ID]"
    assert one(text.utf16_length, "a😀中") == 4
    assert hashing.fnv1a64("a中b") == 0xEA9EB3182EBA6E83 and hashing.simhash([]) == 0
    assert hashing.simhash_tokens("你a好B 吗1") == ["你好", "好吗", "吗", "a", "b", "1"]
    shares = spark.createDataFrame([("你好HTTP世界",), ("かな漢字",), ("123 !?",)], "s string").select(text.script_shares(F.col("s")).alias("x")).collect()
    assert shares[0].x.zh == 0.8 and shares[1].x.ja == 1.0 and shares[2].x is None


def test_per_source_and_quarantine(spark, tmp_path):
    rec = lambda n, s: {"prompt": "abcdefghij klmno"[:n], "completion": "pqrstu", "source": s}
    df = judged(spark, tmp_path, [rec(2, "Code-set"), rec(2, "web"), rec(14, "web"), {**rec(14, "web"), "completion": "vwxyz12345" * 5}], min_chars=15, max_chars=50, fuzzy_dedupe=False, per_source=({"match": "code", "min_chars": 3},))
    assert dropped(df) == [None, "min_chars", None, "max_chars"]
    a = "a" * 11 + "bcdefghij"
    df = judged(spark, tmp_path, [{"prompt": a, "completion": "zyxwvut"}, {"prompt": "q" * 30, "completion": "rs tuv"}], fuzzy_dedupe=False)
    q = rules.quarantine(df).collect()
    assert dropped(df) == ["repeat_ratio"] * 2 and [(r.line_no, r.metric, r.deviation) for r in q] == [(1, 0.55, 0.1)]
    page = report.quarantine_html(rules.quarantine(df))
    assert "repeat_ratio" in page and report.csv_rows(rules.quarantine(df)).columns[-1] == "record_preview"


def sequential(rows, distance=8):
    """Row by row, as the rule is worded: near a kept row that shares a band."""
    keptrows, out = [], {}
    for k, h, ok in rows:
        u = h & (2**64 - 1)
        near = any((u ^ v).bit_count() <= distance and any((u >> 16 * b) & 65535 == (v >> 16 * b) & 65535 for b in range(4)) for v in keptrows)
        out[k] = near
        if ok and not near:
            keptrows.append(u)
    return out


def test_greedy_matches_the_sequential_rule(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    h = dedupe.with_simhash(docs, F.col("text")).select(F.col("doc_id").alias("line_no"), "simhash", (F.col("doc_id") % 7 != 3).alias("passes"))
    rows = [(r.line_no, r.simhash, r.passes) for r in h.orderBy("line_no").collect()]
    got = {r.line_no: r.blocked for r in dedupe.greedy(h, dedupe.near_pairs(h, 8)).collect()}
    want = sequential(rows)
    assert {k for k, v in got.items() if v} == {k for k, v in want.items() if v} and any(want.values())


def test_second_stage(spark):
    rows = [(1, "hello there, my friend", 0.1), (2, "你好世界你好世界你好", 0.2), (3, "bonjour à tous mes amis", 0.3)]
    records = formats.text_records(spark.createDataFrame(rows, "k long, t string, x double"), "k", "t")
    load = lambda: lambda xs: [float(len(x)) for x in xs]
    r = clean.clean(records, rules.Options.of(fuzzy_dedupe=False), clean.SecondStage(lang=True, allowed_langs=("en",), ppl=load, ppl_max=22.5, ppl_min_tokens=1))
    assert dropped(r.judged) == [None, "lang", "ppl"]
    assert r.summary()["by_rule"]["ppl"] == 1
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "line_no long, embedding array<float>")
    r = clean.clean(records, rules.Options.of(fuzzy_dedupe=False), clean.SecondStage(vectors=vectors, semantic_sim=0.95))
    assert dropped(r.judged) == [None, "semantic_dupe", None]


def test_jobs_and_samples(spark):
    raw = spark.createDataFrame([('{"fine_tuning_job_id":"j","status":"SUCCEEDED","error":{"message":"m"}}',), ("{}",)], "json string")
    a, b = jobs.normalise(raw, "json").collect()
    assert (a.jobId, a.status, a.terminal, a.detail, b.status, b.terminal) == ("j", "succeeded", True, "m", "unknown", False)
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2]), ([1, 2, 3], [9])], "full array<int>, prompt array<int>")
    got = [r[0] for r in df.select(scoring.mask_labels(F.col("full"), F.col("prompt"), 3)).collect()]
    assert got == [[-100, -100, 3], [1, 2, 3]]


def test_stream_equals_batch(spark, tmp_path):
    records = [r for r, _ in DIRTY]
    source = tmp_path / "in"
    source.mkdir()
    write_lines(source / "a.jsonl", records)
    stream = CleanStream(spark, f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    stream.start(f"file://{source}", f"file://{tmp_path}/cp").awaitTermination(120)
    write_lines(source / "b.jsonl", [QA, chat(("user", "Something else entirely?"), ("assistant", "Yes, something new."))])
    stream.start(f"file://{source}", f"file://{tmp_path}/cp").awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("line_no").collect()
    assert [r.rule for r in got] == [w for _, w in DIRTY] + ["dedupe", None] and [r.line_no for r in got] == list(range(1, 15))


@pytest.mark.parametrize("name", ["verdict_first_fail", "merge_same_role", "script_shares", "status_changes", "label_mask", "validate_summary", "ppl_report", "fuzzy_dedupe", "clean_documents", "simhash_pairs"])
def test_queries_match_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = c.sql(catalogue.SQL[name])
    want = sorted(map(str, (dict(sorted(zip(rel.columns, r, strict=True))) for r in rel.fetchall())))
    got = sorted(map(str, (dict(sorted(r.asDict().items())) for r in catalogue.QUERIES[name](spark, sf).collect())))
    assert got == want


def test_job_source(monkeypatch):
    from quern.sources import rest

    client = lambda options: lambda path: {"data": [{"id": path, "n": options["n"]}]}
    reader = rest._Reader({"n": 1}, client)
    assert [json.loads(r[0]) for r in reader.read(reader.partitions()[0])] == [{"id": "fine_tuning/jobs", "n": 1}]
    assert rest.rows_of([{"a": 1}]) == [{"a": 1}] and rest.rows_of(None) == []
    monkeypatch.delenv("QUERN_TEST_KEY", raising=False)
    with pytest.raises(ValueError):
        rest.api_key("QUERN_TEST_KEY")


def test_number_of_clusters():
    assert [scoring.n_clusters(n) for n in (2, 100, 10_000, 10**6)] == [2, 5, 50, 64]

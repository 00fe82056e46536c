"""Brute-force versions, round trips and held-out accuracy of the operators that use Python tasks."""

import json
import re
import zlib

import numpy as np
import pytest

from quern.llm import language, licenses, packing, token_files, tokens, tool_calls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (None, "a b", "en", "s", 3),
    (4, "x\x1cy\x85z <|endoftext|> it's THE 'S Ünïcödé... ,,a.b!? 😀ß İΣ", "en", "s", 1),
    (5, "word another thing. " * 3000, "en", "s", 1),
    (6, "Released under the MIT License. the General\nPublic License, GNU general public license", "en", "s", 1),
    (6, "Released under the MIT License. the General\nPublic License, GNU general public license", "en", "s", 1),
    (7, "x " * 70 + "licensed under cc by-nc 4.0" + " y" * 70, "en", "s", 1),
    (8, "12345 !!! 678", "en", "s", 1),
    (9, "License license MIT licenses MIT-LICENSE é license", "en", "s", 1),
]


def documents(spark, sf, odd):
    return spark.createDataFrame(ODD, DOCS).withColumnsRenamed({"n_chars": "length"}) if odd else spark.read.parquet(f"{sf}/documents.parquet")


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_words_are_encoded_as_the_library_does(spark, sf):
    texts = [r[1] for r in ODD] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = tokens.Encoder(tokens.default_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library_ids(texts)


@pytest.mark.parametrize("odd", [True, False])
def test_packing(spark, sf, odd):
    docs = documents(spark, sf, odd)
    rows = docs.collect()
    want = []
    for r, ids in zip(rows, library_ids([r.text for r in rows]), strict=True):
        ids = [*ids, 0]
        want += [(r.doc_id, i, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for i, s in enumerate(range(0, len(ids), 2048))]
    got = packing.pack_documents(spark, docs).collect()
    key = lambda t: str(t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) * 1.1 + 1


def test_packing_in_shards_and_whole_sequences(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 100, 3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k int, length long")
    got = packing.pack(spark, pieces, capacity=100, shard=500).collect()
    assert sorted((r.k, r.length) for r in got) == list(enumerate(sizes))
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 100 and len(fill) <= 1.02 * sum(sizes) / 100 + 1
    assert packing.pack(spark, pieces.limit(0)).collect() == []
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    whole = packing.assemble(packing.pack_documents(spark, docs, keep_ids=True)).collect()
    a, b = (x + [0] for x in library_ids(["one two three", "four"]))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in whole] == [a + b]


def test_local_search_empties_a_bin():
    lengths = np.array([6, 5, 3, 6, 4, 4, 2])  # 30 in bins of 10: best fit needs three at least
    start = [[0, 2], [1, 4], [3, 6], [5]]
    got = packing.improve(lengths, start, 10)
    assert sorted(i for b in got for i in b) == list(range(7)) and len(got) == 3
    assert all(lengths[b].sum() <= 10 for b in got)


def test_local_search_leaves_no_exchange():
    lengths = np.random.default_rng(7).integers(600, 1101, 50_000)
    got = packing.improve(lengths, packing.best_fit(lengths, 2048), 2048)
    assert sorted(i for b in got for i in b) == list(range(50_000))
    home = np.empty(50_000, int)
    for b, items in enumerate(got):
        home[items] = b
    fill = np.bincount(home, weights=lengths).astype(int)
    assert fill.max() <= 2048
    for donor in np.flatnonzero(fill < 2048)[::40]:
        room = np.where((fill >= fill[donor]) & (np.arange(len(fill)) != donor), 2048 - fill, -1)
        own = lengths[got[donor]].tolist()
        assert min(own) > room.max()
        for give in own + [a + b for k, a in enumerate(own) for b in own[:k]]:
            gain = give - lengths
            assert not ((gain > 0) & (gain <= room[home])).any()


@pytest.mark.parametrize("odd", [True, False])
def test_token_files_round_trip(spark, sf, odd):
    docs = documents(spark, sf, odd)
    path = token_files.file_set(spark, "test")
    token_files.write(spark, docs, path)
    got = token_files.read(spark, path, keep_ids=True).collect()
    rows = docs.collect()
    want = [(r.doc_id, [*ids, 1]) for r, ids in zip(rows, library_ids([r.text for r in rows]), strict=True)]
    key = lambda t: str(t)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=key) == sorted(want, key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids) and 4 * r.n_tokens == len(r.ids)
        at += r.n_tokens
    order = [(-1 if r.doc_id is None else r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_empty_token_files(spark):
    path = token_files.file_set(spark, "test")
    token_files.write(spark, spark.createDataFrame([], DOCS), path)
    assert token_files.read(spark, path).count() == 0


def test_coder_starts_at_checkpoints():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.geometric(0.01, 400_000), 5000).astype(np.uint16)
    for n in (1, 1000, 1024, 1025, 400_000):
        part = ids[:n]
        c = token_files.Coder(token_files.scaled(np.bincount(part, minlength=5001)))
        stream, marks = c.encode(part)
        assert (c.decode(stream, marks, n) == part).all()
        step = token_files.EVERY * token_files.LANES
        for k in range(len(marks) // (8 * (token_files.LANES + 1))):
            assert (c.decode(stream, marks, n, k, k + 1) == part[k * step : (k + 1) * step]).all()
    p = np.bincount(ids) / len(ids)
    assert 8 * len(stream) / len(ids) < -(p[p > 0] * np.log2(p[p > 0])).sum() * 1.05 + 0.5
    with pytest.raises(AssertionError):
        assert (c.decode(b"\0" * len(stream), marks, n) == part).all()


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    step = max(len(t.split()) for _, t in licenses.TEMPLATES)
    score, labels = float(bool(base)), {x for _, x in base}
    for at in range(0, max(1, len(words) - step), step):
        block = set(words[at : at + 2 * step])
        for label, t in licenses.TEMPLATES:
            share = len(block & set(t.split())) / len(set(t.split()))
            if share >= licenses.SHARE - 1e-12:
                score, labels = max(score, share), labels | {label}
    starts = [i for i, _ in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(score, 9)


@pytest.mark.parametrize("odd", [True, False])
def test_licenses_match_brute_force(spark, sf, odd):
    docs = documents(spark, sf, odd)
    got = licenses.scan(spark, docs).collect()
    key = lambda t: str(t)
    assert sorted(((*r[:-1], round(r.score, 9)) for r in got), key=key) == sorted(((r.doc_id, *brute_licenses(r.text)) for r in docs.collect()), key=key)
    assert licenses.scan(spark, docs.limit(0)).count() == 0


def test_licenses_find_reworded_notices(spark):
    docs = spark.createDataFrame([(1, "w " * 37 + "Permission is hereby granted, gratis, to any person obtaining a copy of this Software and the associated documentation files" + " w" * 90), (2, "by the public")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(spark, docs).collect()}
    assert got == {1: "mit", 2: ""}


def test_language(spark, sf):
    docs = documents(spark, sf, False)
    got = language.identify(spark, docs).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.95 * len(held)
    odd = documents(spark, sf, True)
    pred = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(spark, odd).collect()]
    assert len(pred) == len(ODD) and all((p == "und") == (i in (1, 2, 3, 8)) and 0 <= s <= 1 for i, p, s in pred)
    kept = language.accepted(spark, odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, p, _ in pred if p != "und")
    assert {r.lang_pred for r in language.identify(spark, docs.withColumn("lang", docs.lang.substr(9, 0)).where("lang <> ''")).collect()} == set()
    assert language.identify(spark, docs.limit(0)).count() == 0


def test_language_mixture(spark, sf):
    docs = documents(spark, sf, False)
    langs, table = language.fit(spark, docs)
    text = {k: " ".join(r.text for r in docs.where(f"lang = '{k}' AND n_chars > 1500").limit(2).collect())[:3000] for k in langs}
    chosen, shares = language.mixture(language.trigram_counts(text["en"] + " " + text["de"]), table)
    assert {langs[i] for i in chosen} == {"en", "de"} and min(shares) > 0.3
    chosen, _ = language.mixture(language.trigram_counts(text["fr"]), table)
    assert [langs[i] for i in chosen] == ["fr"]


CALLS = [
    (1, 0, "user", '{"name":"f","arguments":{"b":1,"a":"é"},"id":"x"}'),
    (1, 1, "tool", '{"tool_call_id":"x","content":"r"}'),
    (1, 2, "user", '{"name":"f","arguments":"{\\"a\\": {\\"$ref\\": \\"x\\"}}","id":"y"}'),
    (1, 3, "user", '{"name":"f","arguments":{"a":{"$ref":"y"}},"id":"z"}'),
    (1, 4, "user", '{"name":"f","arguments":{"a":3},"id":"bad"}'),
    (1, 5, "user", '{"name":"g","arguments":{},"id":"none"}'),
    (2, 0, "user", "plain"),
    (2, 0, "user", "plain"),
    (2, 1, "assistant", "answer"),
    (2, 1, "assistant", "another"),
    (2, 2, "user", None),
    (2, 9, "assistant", None),
    (3, 0, "system", "s"),
    (None, None, "user", "{broken"),
    (4, 0, "user", '{"name":"f","arguments":{"a":{"$ref":"q"}},"id":"p"}'),
    (4, 1, "user", '{"name":"f","arguments":{"a":{"$ref":"p"}},"id":"q"}'),
    (4, 2, "user", '{"name":"f","arguments":{"a":{"$ref":"gone"}},"id":"s"}'),
]


def test_tool_calls(spark):
    turns = spark.createDataFrame(CALLS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS level")
    schemas = tool_calls.SCHEMAS | {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}, "b": {"type": "integer", "minimum": 0}}}}
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link(spark, *tool_calls.from_turns(turns), schemas).collect()}
    state = {k: (r.status, r.level, r.n_calls, r.n_results) for k, r in got.items()}
    assert state == {
        (1, "x"): ("linked", 0, 1, 1), (1, "y"): ("missing_result", 1, 1, 0), (1, "z"): ("missing_result", 2, 1, 0),
        (1, "bad"): ("invalid_arguments", 0, 1, 0), (1, "none"): ("invalid_arguments", 0, 1, 0),
        (2, "turn-0"): ("linked", 0, 2, 2), (2, "turn-2"): ("invalid_arguments", 0, 1, 0), (2, "turn-8"): ("orphan_result", 0, 0, 1),
        (None, "turn-null"): ("missing_result", 0, 1, 0), (4, "p"): ("cycle", None, 1, 0), (4, "q"): ("cycle", None, 1, 0), (4, "s"): ("missing_result", 0, 1, 0),
    }
    assert got[1, "x"].json == '{"arguments":{"a":"é","b":1},"id":"x","name":"f","result":"{\\"tool_call_id\\":\\"x\\",\\"content\\":\\"r\\"}"}'
    for r in got.values():
        assert tool_calls.canonical(json.loads(r.json)) == r.json
    assert tool_calls.link(spark, *tool_calls.from_turns(turns.limit(0))).count() == 0


def test_tool_calls_of_the_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = {(r.conv_id, r.turn, r.role): r.text for r in turns.collect()}
    got = tool_calls.link(spark, *tool_calls.from_turns(turns)).collect()
    want = {}
    for (c, t, role), text in rows.items():
        if role == "user":
            answer = rows.get((c, t + 1, "assistant"))
            line = {"arguments": {"text": text}, "id": f"turn-{t}", "name": "reply"} | ({"result": answer} if answer is not None else {})
            want[c, t] = ("linked" if answer is not None else "missing_result", json.dumps(line, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
        elif role == "assistant" and (c, t - 1, "user") not in rows:
            want[c, t] = ("orphan_result", json.dumps({"id": f"turn-{t - 1}", "result": text}, sort_keys=True, ensure_ascii=False, separators=(",", ":")))
    assert {(r.conv_id, r.turn): (r.status, r.json) for r in got} == want

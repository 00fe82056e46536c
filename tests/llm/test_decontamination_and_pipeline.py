"""Recall of the latent search against brute force, and the pipeline against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import decontamination as dec

from .test_native import base_spans
from .test_near_duplicates import brute_five


def every_pair(docs, items):
    """All windows against all items, without the latent space."""
    out = set()
    for n, text in docs:
        words = dec.words_of((text or "").encode())
        for item in items:
            if item.words and any(dec.judge(item, words, at, m * dec.STEP) for at in range(0, len(words), dec.STEP) for m in dec.WINDOWS):
                out.add((n, item.key))
    return out


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(12))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert dec.lcs(a, b) == t[-1, -1]


def test_recall_and_precision(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [dec.Item(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(2)
    for k, item in enumerate(items):  # verbatim, with a few words changed, and reworded around the answer
        host = rows[k % len(rows)][1].split()
        w = [x.decode() for x in item.words]
        for kind in range(3):
            v = [("zz" if kind and rng.random() < 0.1 * kind and i < len(w) - len(item.answer) else x) for i, x in enumerate(w)]
            rows.append((10_000 + 3 * k + kind, " ".join([*host[:90], *v, *host[90:180]])))
    rows += [(-1, None), (-2, ""), (-3, "the " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS text_")
    got = dec.find(spark, df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    want = every_pair(rows, items)
    assert found <= want and len(found) == len(got)
    assert len(found) >= 0.9 * len(want)
    assert {(10_000 + 3 * k, i.key) for k, i in enumerate(items) if i.words} <= found
    kept = dec.clean(spark, df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {n for n, _ in rows} - {n for n, _ in found}


@pytest.mark.parametrize("many", [200, 700])
def test_recall_does_not_fall_with_the_number_of_items(spark, sf, monkeypatch, many):
    monkeypatch.setattr(dec, "SAMPLE", 100)
    texts = [w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(w := dec.words_of((r.text or "").encode())) > 120]
    rng = random.Random(5)
    items, rows = [], [(-k, b" ".join(w).decode()) for k, w in enumerate(texts, 1)]
    for k in range(many):
        w = texts[k % len(texts)]
        at = rng.randrange(len(w) - 40)
        items.append((k, b" ".join(w[at : at + rng.randrange(30, 40)]).decode()))
        host = rng.choice(texts)
        for kind in range(2):  # verbatim, and with a fifth of the words changed
            v = [("zz" if kind and i % 5 == 2 else x) for i, x in enumerate(items[k][1].split())]
            rows.append((2 * k + kind, " ".join([*(x.decode() for x in host[:50]), *v, *(x.decode() for x in host[50:100])])))
    got = dec.find(spark, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    by_id = dict(rows)
    for kind in range(2):
        want = {(2 * k + kind, k) for k, text in items if every_pair([(0, by_id[2 * k + kind])], [dec.Item(k, text)])}
        assert len(want) > 0.9 * many and len(want & found) >= 0.9 * len(want)


def test_spaces_are_fitted_on_every_passage(spark, sf):
    """Frequencies and sums of all documents, however they are dealt; their directions against a plain SVD."""
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + k, " ".join(f"w{i}" for i in rng.integers(0, 300, 40))) for k in range(4_000)] + [(-1, None), (-2, "?!")]
    docs = spark.createDataFrame(rows, "id_ long, text_ string")
    got, again = dec.corpus_counts(docs.repartition(7)), dec.corpus_counts(docs.coalesce(1))
    df, passages = np.zeros(dec.BUCKETS, int), []
    for _, text in rows:
        b = dec._buckets(dec.words_of((text or "").encode()))
        df[np.unique(b)] += 1
        passages += [b[i : i + dec.FITTED] for i in range(0, len(b), dec.FITTED)]
    assert got.n == len(rows) and (got.df == df).all()
    assert (again.df == df).all() and np.allclose(got.sums, again.sums, atol=1e-3)
    idf = np.log((len(rows) + 1) / (df + 1)) + 0.05
    terms = np.flatnonzero(df)
    a = np.zeros((len(passages), len(terms)), np.float32)
    for k, b in enumerate(passages):
        t, n = np.unique(b, return_counts=True)
        a[k, np.searchsorted(terms, t)] = n * idf[t] / np.sqrt((n * n).sum())
    exact = rng.standard_normal((len(terms), 16)).astype(np.float32)
    for _ in range(20):
        exact, _ = np.linalg.qr(a.T @ (a @ exact))
    exact = exact @ np.linalg.svd(a @ exact, full_matrices=False)[2].T
    common = dec.common_directions(got.sums, idf)
    strength = (common * common).sum(axis=0)
    assert 0 < strength.sum() <= 1 and (np.diff(strength) <= 1e-6).all()
    basis = common[:, strength > 0] / np.sqrt(strength[strength > 0])
    for k in range(3):  # the strongest directions of all passages lie in the space
        assert np.linalg.norm(exact[:, k] @ basis[terms]) > 0.8


def test_empty_sides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(5)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert dec.find(spark, docs, bench.limit(0)).count() == 0 and dec.clean(spark, docs, bench.limit(0)).count() == 5
    assert dec.find(spark, docs.limit(0), bench).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "?!")], "item_id long, text string")
    assert dec.find(spark, docs, odd).count() == 0


def test_items_with_a_null_id(spark):
    texts = ["".join(f"{c}{i} " for i in range(35)) for c in "abc"]
    docs = spark.createDataFrame([(k, "start of it " + t + "and the end") for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, texts[0]), (7, texts[1])], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in dec.find(spark, docs, bench).collect()) == [(0, None), (1, 7)]
    assert [r.doc_id for r in dec.clean(spark, docs, bench).collect()] == [2]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    extra = docs.limit(3).selectExpr("doc_id + 90000 AS doc_id", "cast(NULL AS string) AS text", "lang", "source", "n_chars").union(docs.limit(1))
    docs = docs.union(extra)
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = corpus_pipeline.write_table(spark, stage(spark, docs, sf), name)
        out.append(docs)
    return out


def test_stages_match_brute_force(spark, sf, stages):
    docs, known, single, clean, masked, packed = ([tuple(r) for r in x.collect()] for x in stages)
    assert all(x.columns == stages[0].columns for x in stages[:5])
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert sorted(known, key=str) == sorted((r for r in docs if letters(r[1])), key=str)
    # Stages on word shingles take five words and 0.8.
    assert sorted(r[0] for r in single) == brute_five([r[:2] for r in known])
    assert {r for r in single} <= {r for r in known}
    items = [dec.Item(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {n for n, _ in every_pair([r[:2] for r in single], items)}
    assert sorted(clean) == sorted(r for r in single if r[0] not in bad)
    before = {r[0]: r for r in clean}
    for r in masked:
        assert (r[0], *r[2:4]) == (before[r[0]][0], *before[r[0]][2:4]) and r[4] == len(r[1]) and not base_spans(r[1])
        if r[1] != before[r[0]][1]:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE|SECRET)\]", r[1])
    assert {r[0] for r in masked} == set(before) == {r[0] for r in packed}


def test_the_stage_fits_its_spaces_on_all_documents(spark, tmp_path, monkeypatch):
    """In one pass for all blocks of items, and more documents than the sample had that is no longer drawn."""
    rng, n = random.Random(7), 3_500
    texts = [" ".join(f"w{rng.randrange(2_000)}" for _ in range(70)) for _ in range(n)]
    items = [(k, " ".join(texts[5 * k].split()[10:45])) for k in range(230)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    made, count = [], dec.corpus_counts
    monkeypatch.setattr(dec, "corpus_counts", lambda docs: made.append(count(docs)) or made[-1])
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert [c.n for c in made] == [n] and made[0].df.sum() == sum(len(set(dec._buckets(dec.words_of(t.encode())))) for t in texts)
    assert {r.doc_id for r in kept.collect()} == set(range(n)) - {5 * k for k, _ in items}


def test_what_the_driver_holds_for_the_stage(spark, sf):
    """The driver's arrays for two spaces; 102 MB with a random projection of its own for each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    bench = spark.createDataFrame([(k, " ".join(f"w{k}x{i}" for i in range(35))) for k in range(200)], "item_id long, text string")
    tracemalloc.start()
    try:
        dec.clean(spark, docs, bench)
        assert tracemalloc.get_traced_memory()[1] < 70e6
    finally:
        tracemalloc.stop()


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0

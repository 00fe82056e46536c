"""The n-gram Jaccard join against all pairs, on the small table and on planted groups."""

import random
import re

import pytest

import corpus_pipeline
from quern.llm import near_duplicates, shingles
from quern.llm.components import components

DOCS = "doc_id long, text string, lang string"


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    seen = set()
    for group in by.values():
        for k, i in enumerate(group):
            for j in group[:k]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def planted():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (4, "One", "a"), (5, "one", "a"), (6, "one two", "a"), (7, "two one", "a"), (None, "one two", "a"), (None, None, "a")]
    base = [word() for _ in range(120)]
    common = [word() for _ in range(60)]
    for k in range(60):  # a chain of small changes, and one passage that many share
        base[rng.randrange(120)] = word()
        rows.append((100 + k, " ".join(base), "b"))
        rows.append((300 + k, " ".join([*common, *[word() for _ in range(rng.randrange(1, 90))]]), "c"))
        rows.append((500 + k, " ".join([*base[:100], word(), *base[101:]]) + " end" * (k % 3), "d"))
    for k in range(40):  # short texts, sizes at the threshold
        rows.append((700 + k, " ".join(["x", "y", "z", *[f"w{i}" for i in range(k // 4)]]), "e"))
    return rows + rows[20:40]


@pytest.mark.parametrize("chain", [near_duplicates.CHAIN, 7])
def test_planted_groups(spark, monkeypatch, chain):
    monkeypatch.setattr(near_duplicates, "CHAIN", chain)
    rows = planted()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS n", "2 AS cid")
    got = near_duplicates.find(spark, docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert sorted((tuple(r) for r in near_duplicates.find(spark, docs).collect()), key=str) == want
    kept = near_duplicates.distinct(spark, docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for i, _, c in want if i == c})


def brute_five(rows):
    """Ids named by components at five words and 0.8, over all pairs of rows with text; ids are distinct."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, set()).add(i)
    for i, j in {(i, j) for group in by.values() for i in group for j in group if i < j}:
        both = len(sets[i] & sets[j])
        if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sorted({find(i) for i in sets})


def test_stage_links_at_five_words_and_eighty_hundredths(spark, sf):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for k in range(40):  # copies with one to four words changed: 5 words and 0.8 link some that 3 words and 0.9 don't
        w = [f"w{rng.randrange(1000)}" for _ in range(100)]
        v = list(w)
        for i in rng.sample(range(100), 1 + k % 4):
            v[i] = "zz"
        rows += [(50_000 + 2 * k, " ".join(w)), (50_001 + 2 * k, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_five(rows)
    assert want != sorted({c for i, _, c in brute(rows) if i == c})
    assert sorted(r.doc_id for r in corpus_pipeline.ngram_jaccard(spark, docs, sf).collect()) == want


def test_empty_table_and_shingles(spark):
    assert near_duplicates.find(spark, spark.createDataFrame([], DOCS)).count() == 0
    assert len(shingles.shingles("a b c d".encode())) == 2 and len(shingles.shingles(b"A b")) == 1
    assert (shingles.shingles("É a\x0bB".encode()) == shingles.shingles("É A b ".encode())).all()
    assert shingles.shingles("é a b".encode())[0] != shingles.shingles("É a b".encode())[0]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 501), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in components(spark, links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
    assert components(spark, links.limit(0)).count() == 0

"""Language ID by multilingual mixture inference.

Each language has smoothed likelihoods of hashed character trigrams. A document is a mixture: expectation-
maximisation estimates the share of each language, and languages join the document's set one by one while
the likelihood gained outweighs a penalty that grows with the logarithm of the document's length. The
prediction is the language of the largest share.

The model is fitted on a bounded sample of labelled rows (``most_rows``, spread over the languages); it is a
table of languages x ``BUCKETS`` numbers, 64 kB a language. Every document is scored on its whole text.

Defined results: a null text, or one without letters, is ``und`` with score 0; ties go to the language that
sorts first; a null doc_id counts as an empty string when the held-out part is chosen; repeated rows are
judged each; without labelled rows every document is ``und``; an empty table gives an empty result. Only
the columns named in ``carry`` are carried, so clashing names among the others don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, trim

BUCKETS = 1 << 14
#: Labelled rows that the likelihoods are fitted on, at most, over all languages (about, as rows are drawn by hash).
MOST_ROWS = 20_000
#: Neighbouring trigrams share characters, so a trigram counts as a third of an observation.
EVIDENCE = 1 / 3
ROUNDS = 12

_letters: np.ndarray | None = None


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)
    low = codes < 0x10000
    out = _letters[np.where(low, codes, 0)]
    if not low.all():
        out[~low] = [chr(c).isalpha() for c in codes[~low].tolist()]
    return out


def trigram_counts(text: str | None) -> np.ndarray | None:
    """Counts by bucket; None without letters. Other characters than letters are one space."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _is_letter(codes)
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    chars = np.where(letter, codes, 32)[keep].astype(np.uint64)
    chars = np.concatenate(([np.uint64(32)], chars, [np.uint64(32)] * (1 + (len(chars) < 2))))
    h = chars[:-2] * np.uint64(0x9E3779B97F4A7C15) + chars[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + chars[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def fit(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = MOST_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and likelihoods [bucket, language], from the rows that aren't held out."""
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, most_rows / len(sizes) / n)))])
    drawn = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 20)) / (1 << 20)
    sample = rows.where(drawn < F.element_at(share, F.col("lang"))).select("lang", "text").repartition(8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if (c := trigram_counts(text)) is not None:
                    total[lang] = total.get(lang, 0) + c
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "counts": pa.array([c.astype("<i8").tobytes() for c in total.values()], pa.binary())})

    langs = sorted(sizes)
    sums = {k: np.zeros(BUCKETS) for k in langs}
    for r in sample.mapInArrow(count, "lang string, counts binary").collect():  # 8 x languages rows at most
        sums[r["lang"]] += np.frombuffer(r["counts"], "<i8")
    table = np.stack([sums[k] for k in langs], axis=1) + 0.2
    return langs, table / table.sum(axis=0)


def mixture(counts: np.ndarray, likelihoods: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The chosen languages and the share of each."""
    at = np.flatnonzero(counts)
    c, p = counts[at] * EVIDENCE, likelihoods[at]
    n = c.sum()
    logs = c @ np.log(p)

    def em(of: list[int]) -> tuple[np.ndarray, float]:
        q, pi = p[:, of], np.full(len(of), 1 / len(of))
        for _ in range(ROUNDS):
            pi = pi * ((c / (q @ pi)) @ q) / n
        return pi, float(c @ np.log(q @ pi))

    best = int(np.argmax(logs))
    chosen, shares, ll = [best], np.ones(1), float(logs[best])
    if p.shape[1] == 1:
        return chosen, shares
    penalty = 0.5 * np.log(max(n, 2.0)) + 1.0
    everyone, _ = em(list(range(p.shape[1])))
    for k in np.argsort(-everyone, kind="stable").tolist():
        if k in chosen:
            continue
        pi, gained = em([*chosen, k])
        if gained - ll <= penalty:
            break
        chosen, shares, ll = [*chosen, k], pi, gained
    return chosen, shares


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))])


def judge(text: str | None, langs: list[str], likelihoods: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """The values of RESULT."""
    counts = trigram_counts(text) if langs else None
    if counts is None:
        return "und", 0.0, [], []
    chosen, shares = mixture(counts, likelihoods)
    order = sorted(range(len(chosen)), key=lambda i: (-shares[i], chosen[i]))
    return langs[chosen[order[0]]], float(min(1.0, shares[order[0]])), [langs[chosen[i]] for i in order], [float(shares[i]) for i in order]


def annotate(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``carry`` of docs, and lang_pred, score, languages and shares."""
    ship(spark)
    given = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("text_"))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                found = list(zip(*(judge(t, *model) for t in part.column("text_").to_pylist()), strict=True))
                kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], names=[*part.schema.names[:-1], *RESULT.names])

    out = given.mapInArrow(run, T.StructType([*fields, *RESULT.fields]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], *RESULT.names)


def identify(spark: SparkSession, docs: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the chosen languages with their shares, of every document."""
    out = annotate(spark, docs, fit(spark, docs, most_rows=most_rows), ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.concat_ws(",", "languages").alias("languages"))


def accepted(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language can be told."""
    model, at = fit(spark, docs, text_col=text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                part = b.slice(start, 1000)
                yield part.filter(pa.array([judge(t, *model)[0] != "und" for t in part.column(at).to_pylist()], pa.bool_()))
        trim()

    return docs.mapInArrow(run, docs.schema)

"""N-gram Jaccard join of documents by a grouped prefix join.

1. Every text becomes its set of hashed shingles of ``words`` words, 3 unless asked otherwise; equal sets are one class.
2. Two sets with Jaccard similarity t share a shingle among the first ``|x| - ceil(t|x|) + 1`` of each
   (prefix filter), whatever the global order. A first order puts the shingles with a low hash in front (``_pool``
   of all, somewhat more than a prefix), by the number of classes that hold them, rarest first: the others needn't
   be counted. A class whose prefix holds only shingles of its own has no partner and leaves; most do.
3. The classes that are left are ordered anew, by the frequencies of all their shingles among themselves.
   Classes with identical prefixes, size and bitmap are collapsed into one group. Groups that share a shingle
   are filtered by size, by its positions (what comes before the first common shingle is missing from the other
   set) and by their bitmaps (each bit that differs stands for a shingle that one set lacks), then expanded to
   their members, and each pair is verified on the whole sets.

Only components are asked for, so pairs within a component need no verification: a first round links
neighbours in each bucket, a linear number of pairs; the exact round then joins only members of different
components, those outside a bucket's most common component with all. Before it, the same join runs over parts of
large buckets, in which a member meets about ``MEETS`` others, and over a few members of each group: a linear number
of pairs that links most of what is left. So a bucket of thousands of near copies makes no square of pairs, and no
link between components is lost.

Defined results: null texts and texts without words have no shingles and link with nothing; texts of fewer
words than a shingle are one shingle; equal sets link even under different ids, and rows of one id with different
texts only if these are similar; a null doc_id is never a component's name unless it has no other; repeated rows are
returned each by ``find``; an empty table gives an empty result; texts are never shortened; extra columns are not
carried by ``find`` and all kept by ``distinct``, which keeps one row of each component, that of the smallest id (a null
one only if there is no other) and then of the smallest digest of the text, and one of repeated rows without words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, release, ship, trim, write_table
from .components import components
from .shingles import shingles

WORDS = 3
#: Similarity in hundredths.
SIMILARITY = 90
#: Members of a bucket that are put in order together in the first round.
CHAIN = 5_000
#: In the round before the exact one: members of a bucket that one meets, about, and pairs of members of two groups, at most.
MEETS, TRIES = 12, 8
#: 64-bit words of a set's bitmap, which bounds how much two sets differ.
MAP = 16
#: Bits of the map of ids whose texts are read again.
BITS = 1 << 24


def _pool(similarity: int) -> np.uint64:
    """Hashes below this are ordered by frequency: a tenth more of all than prefixes are."""
    return np.uint64(min((1 << 64) - 1, (1 << 64) * (110 - similarity) // 100))


def _prefix_size(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64()))


def _bitmap(s: np.ndarray) -> np.ndarray:
    there = np.zeros(64 * MAP, dtype=bool)
    there[(s % np.uint64(64 * MAP)).astype(np.int64)] = True
    return np.packbits(there, bitorder="little").view(np.uint64)


def _sets(spark: SparkSession, docs: DataFrame, similarity: int, words: int) -> DataFrame:
    """doc_id, key, n, cid (digest of the set; null if empty) and pool (shingles that the prefix is taken from)."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, cid, pool = [], [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    s = shingles(text, words)
                    n.append(len(s))
                    cid.append(hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() if len(s) else None)
                    low = int(np.searchsorted(s, _pool(similarity)))
                    pool.append(s[: max(low, _prefix_size(len(s), similarity) if len(s) else 0)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), _lists(pool)], names=["doc_id", "key", "n", "cid", "pool"])
        trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, key binary, n long, cid binary, pool array<long>")


def _full_sets(spark: SparkSession, given: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """nid, n, pool, bits: the whole sets of the classes wanted (nid, cid, rep), and their bitmaps.

    A bitmap of BITS hashed ids, 2 MB whatever the input, tells which rows to hash again; rows that it lets
    through by chance are dropped by the join, so it decides only how much is shuffled.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    bits = np.zeros(BITS // 8, np.uint8)
    h = wanted.select(at("rep").alias("h"))
    for r in h.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect():  # 512 rows at most
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h").to_numpy() - 1
            b = b.filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1))
            for at in range(0, b.num_rows, 200):
                sets = [shingles(t, words) for t in b.slice(at, 200).column("text").cast(pa.binary()).to_pylist()]
                sets = [s for s in sets if len(s)]
                cid = [hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(cid, pa.binary()), _lists(sets), _lists([_bitmap(x) for x in sets])], names=["k", "pool", "bits"])

    rows = given.select("text", at("doc_id").alias("h")).mapInArrow(run, "k binary, pool array<long>, bits array<long>")
    return wanted.join(rows, F.col("cid") == F.col("k")).dropDuplicates(["nid"]).select("nid", F.size("pool").cast("long").alias("n"), "pool", "bits")


def _need(n_a: Column, n_b: Column, similarity: int) -> Column:
    """Least size of an intersection."""
    return F.ceil(similarity * (n_a + n_b) / (100 + similarity))


def _survivors(classes: DataFrame, similarity: int) -> DataFrame:
    """nid of the classes whose prefix holds a shingle of another class. classes: nid, n, pool.

    A shingle that only one class holds names it, so counting those takes one aggregation, combined before the
    shuffle, and no join.
    """
    own = classes.select("nid", F.explode("pool").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"), F.min("nid").alias("nid"))
    own = own.where("df = 1").groupBy(F.col("nid").alias("k")).agg(F.count(F.lit(1)).alias("own"))
    d = F.col("n") - F.ceil(similarity * F.col("n") / 100) + 1
    left = classes.select("nid", "n", F.size("pool").alias("m")).join(own, F.col("nid") == F.col("k"), "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return left.where((F.col("own") < d) & (F.col("own") < F.col("m"))).select("nid")


def _prefixes(classes: DataFrame, similarity: int) -> DataFrame:
    """nid, n, d (prefix size), alone (prefix shingles of no other class), pre (the others, rarest first), last.

    classes: nid, n, pool (all shingles).
    """
    flat = classes.select("nid", F.explode("pool").alias("tok"))
    shared = flat.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = flat.join(shared, "tok").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("held"))
    held = held.join(classes.select("nid", "n"), "nid")
    d = F.col("n") - F.ceil(similarity * F.col("n") / 100) + 1
    need = (d - (F.col("n") - F.size("held"))).cast("int")
    held = held.select("nid", "n", d.alias("d"), need.alias("need"), "held").where("need > 0")
    held = held.withColumn("alone", (F.col("d") - F.col("need")).cast("int")).withColumn("held", F.slice("held", F.lit(1), F.col("need"))).drop("need")
    return held.select("nid", "n", "d", "alone", F.transform("held", lambda h: h.tok).alias("pre"), F.element_at("held", -1).alias("last"))


def _grouped(prefixes: DataFrame, full: DataFrame) -> DataFrame:
    """prefixes with bits and gid, which members of one group share."""
    text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
    made = prefixes.join(full.select("nid", "bits"), "nid")
    return made.withColumn("gid", F.unhex(F.md5(F.concat_ws(";", F.col("n").cast("string"), F.col("last.df").cast("string"), text("pre"), text("bits")))))


def _alike(n_a: Column, bits_a: Column, n_b: Column, bits_b: Column, similarity: int) -> Column:
    """Sets may be similar by their bitmaps: what differs is at most what may be missing from both."""
    differ = sum((F.bit_count(F.get(bits_a, i).bitwiseXOR(F.get(bits_b, i))) for i in range(MAP)), F.lit(0))
    return differ <= n_a + n_b - 2 * _need(n_a, n_b, similarity)


def _may_match(common: Column, similarity: int) -> Column:
    """Size and positional filters of a_ and b_: the prefix that ends first shows what the other set lacks."""
    need = _need(F.col("a_n"), F.col("b_n"), similarity)
    lacks = lambda x: (F.col(f"{x}_d") - common) > F.col(f"{x}_n") - need
    out = F.when(F.col("a_last") <= F.col("b_last"), lacks("a")).otherwise(F.lit(False)) | F.when(F.col("b_last") <= F.col("a_last"), lacks("b")).otherwise(F.lit(False))
    alike = _alike(F.col("a_n"), F.col("a_bits"), F.col("b_n"), F.col("b_bits"), similarity)
    return (100 * F.least("a_n", "b_n") >= similarity * F.greatest("a_n", "b_n")) & ~out & alike


def _side(w: DataFrame, x: str, *names: str) -> DataFrame:
    return w.select(*[F.col(k).alias(f"{x}_{k}") for k in ("nid", *names)])


def _verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs a, b whose whole sets are similar enough. Row by row in the JVM, so that no batch of long sets is held."""
    side = lambda x: sets.select(F.col("nid").alias(x), F.col("pool").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    alike = 100 * both >= similarity * (F.size("s_a") + F.size("s_b") - both)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(alike).select("a", "b")


def _first_round(w: DataFrame, similarity: int) -> DataFrame:
    """Pairs a, b of neighbours: a group's members with its first; leaders in each bucket, ordered by prefix."""
    leaders = w.groupBy("gid").agg(F.min("nid").alias("lead"))
    star = w.join(leaders, "gid").where("nid <> lead").select(F.col("lead").alias("a"), F.col("nid").alias("b"))
    lead = w.join(leaders, "gid").where("nid = lead")
    flat = lead.select("nid", "n", F.explode("pre").alias("tok"), F.element_at("pre", 1).alias("first"), F.element_at("pre", -1).alias("end"))
    big = flat.groupBy("tok").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    flat = flat.join(big, "tok").withColumn("salt", F.pmod(F.xxhash64("first"), F.ceil(F.col("size") / CHAIN)))
    chain = Window.partitionBy("tok", "salt").orderBy("n", "first", "end", "nid")
    near = flat.select(F.lag("nid").over(chain).alias("p"), "nid").where("p IS NOT NULL")
    near = near.select(F.least("p", "nid").alias("a_nid"), F.greatest("p", "nid").alias("b_nid")).distinct()
    names = ("n", "d", "pre", "last", "bits")
    near = near.join(_side(w, "a", *names), "a_nid").join(_side(w, "b", *names), "b_nid")
    near = near.where(_may_match(F.size(F.array_intersect("a_pre", "b_pre")), similarity))
    return star.union(near.select("a_nid", "b_nid"))


def _met(spark: SparkSession, w: DataFrame, roots: DataFrame, similarity: int, meets: int | None) -> tuple[DataFrame, DataFrame]:
    """nid, gid, comp of all members; and pairs of groups in different components that pass the filters: a_ and b_nid (the first members), gid, comp.

    meets: how many of a bucket one member meets, about; None: all.
    """
    comp = w.join(roots, w.nid == roots.node, "left").select(*w.columns, F.coalesce("root", "nid").alias("comp"))
    parts, _ = write_table(spark, comp, "near-parts")
    sub = parts.groupBy("gid", "comp").agg(F.min("nid").alias("sid"), F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("bits").alias("bits"), F.first("pre").alias("pre"))
    flat = sub.select("sid", "comp", "n", "alone", "bits", F.posexplode("pre").alias("i", "tok")).select("sid", "comp", "n", "tok", "bits", (F.col("alone") + F.col("i")).alias("pos"))
    per = flat.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("c"))
    mode = per.groupBy("tok").agg(F.max_by("comp", F.struct("c", "comp")).alias("mode"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size")).where("comps > 1").drop("comps")
    part = F.lit(0) if meets is None else F.pmod(F.xxhash64("sid"), F.ceil(F.col("size") / meets))
    rows, _ = write_table(spark, flat.join(mode, "tok").withColumn("part", part).drop("size"), "near-buckets")
    few = rows.where("comp <> mode").select("tok", F.col("part").alias("x_part"), F.col("sid").alias("x"), F.col("comp").alias("x_comp"), F.col("n").alias("x_n"), F.col("pos").alias("x_pos"), F.col("bits").alias("x_bits"))
    # Members outside a bucket's most common component meet all members; among themselves, once.
    need = _need(F.col("n"), F.col("x_n"), similarity)
    fits = (100 * F.least("n", "x_n") >= similarity * F.greatest("n", "x_n")) & (F.col("pos") <= F.col("n") - need) & (F.col("x_pos") <= F.col("x_n") - need)
    fits = fits & _alike(F.col("n"), F.col("bits"), F.col("x_n"), F.col("x_bits"), similarity)
    pair = (F.col("comp") != F.col("x_comp")) & ((F.col("comp") == F.col("mode")) | (F.col("sid") > F.col("x"))) & fits
    met = rows.withColumnRenamed("tok", "t").join(few, (F.col("t") == F.col("tok")) & (F.col("part") == F.col("x_part")) & pair)
    met = met.select(F.least("sid", "x").alias("a_nid"), F.greatest("sid", "x").alias("b_nid")).distinct()
    met = met.join(_side(parts, "a", "gid", "comp"), "a_nid").join(_side(parts, "b", "gid", "comp"), "b_nid")
    return parts.select("nid", "gid", "comp"), met


def _members(met: DataFrame, parts: DataFrame, tries: int | None = None) -> DataFrame:
    """Pairs a, b of members of the groups that meet: all, or the first ones and at most so many others for each pair of groups."""
    own = parts.withColumn("try", F.lit(0) if tries is None else F.pmod(F.xxhash64("nid"), F.lit(tries)))
    if tries is not None:
        own = own.groupBy("gid", "comp", "try").agg(F.min("nid").alias("nid"))
    side = lambda x: own.select(F.col("nid").alias(x), F.col("gid").alias(f"{x}_gid"), F.col("comp").alias(f"{x}_comp"), F.col("try").alias(f"{x}_try"))
    one = met.select("a_gid", "a_comp", "b_gid", "b_comp").distinct().join(side("a"), ["a_gid", "a_comp"]).withColumnRenamed("a_try", "b_try")
    pairs = one.join(side("b"), ["b_gid", "b_comp", "b_try"]).select("a", "b")
    return pairs if tries is None else pairs.union(met.select("a_nid", "b_nid")).distinct()


def _text_key(text: Column) -> Column:
    """Tells the texts of one id apart; a null is a text of its own."""
    return F.unhex(F.when(text.isNull(), "").otherwise(F.md5(text)))


def _rows(spark: SparkSession, docs: DataFrame, similarity: int, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, key, n_shingles, root (null without shingles) and component_id of every row."""
    text = F.col(text_col)
    given = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _text_key(text).alias("key"))
    sets, sets_at = write_table(spark, _sets(spark, given, similarity, words), "near-sets")
    rows, _ = write_table(spark, sets.select("doc_id", "key", "n", "cid"), "near-rows")
    one = sets.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("pool").alias("pool"))
    pools, pools_at = write_table(spark, one.withColumn("nid", F.monotonically_increasing_id()), "near-pools")
    drop_table(spark, sets_at)
    classes, _ = write_table(spark, pools.select("nid", "cid", "rep"), "near-classes")
    some, _ = write_table(spark, _survivors(pools, similarity), "near-some")
    drop_table(spark, pools_at)
    release(spark)

    full, full_at = write_table(spark, _full_sets(spark, given, classes.join(some, "nid", "left_semi"), words), "near-full")
    w, _ = write_table(spark, _grouped(_prefixes(full, similarity), full), "near-prefixes")
    release(spark)
    first, _ = write_table(spark, _verify(_first_round(w, similarity), full, similarity), "near-links")
    release(spark)
    roots = components(spark, first)
    for meets, tries in ((MEETS, TRIES), (None, None)):
        parts, met = _met(spark, w, roots, similarity, meets)
        more, _ = write_table(spark, _verify(_members(met, parts, tries), full, similarity), "near-links")
        if not more.isEmpty():
            roots = components(spark, more.union(roots.select("node", "root")))
    drop_table(spark, full_at)
    release(spark)

    named = classes.join(roots, F.col("nid") == F.col("node"), "left").select("cid", "rep", F.coalesce("root", "nid").alias("root"))
    names = named.groupBy("root").agg(F.min("rep").alias("component"))
    by_class = named.join(names, "root").select(F.col("cid").alias("k"), "root", "component")
    out = rows.join(by_class, F.col("cid") == F.col("k"), "left")
    own = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "root", own.alias("component_id"))


def find(spark: SparkSession, docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _rows(spark, docs, similarity, id_col, text_col, words).select("doc_id", "n_shingles", "component_id")


def distinct(spark: SparkSession, docs: DataFrame, similarity: int = SIMILARITY, words: int = WORDS) -> DataFrame:
    """One row of docs, all columns, for each component."""
    found, _ = write_table(spark, _rows(spark, docs, similarity, "doc_id", "text", words), "near-found")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    one = found.where("root IS NOT NULL").groupBy("root").agg(F.min(name).alias("name")).select("name.doc_id", "name.key")
    keep, _ = write_table(spark, one.union(found.where("root IS NULL").select("doc_id", "key").distinct()).select(F.col("doc_id").alias("k"), "key"), "near-keep")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), _text_key(F.col("text")).alias("t"))
    kept = given.join(keep, F.col("id").eqNullSafe(F.col("k")) & (F.col("t") == F.col("key")), "left_semi")
    if not found.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "t"])
    return kept.select("row.*")

"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of 32 and of 64 words, one every 16 words, over whole texts. Words are hashed into
``BUCKETS`` terms. One pass over all documents counts the terms' document frequencies and adds up a random
projection of all their passages (of ``FITTED`` words, without overlap): each one's counts, scaled to length one,
go with a random sign into one of ``SKETCH`` sums. Weighted by the frequencies, the sums are the sketch of a
randomised SVD of the TF-IDF matrix of the whole corpus, and its ``COMMON`` strongest directions, each less the
strength of the next one, which is the sketch's noise, are what documents have in common. The latent space is the
SVD of these and of the benchmark items, which weigh as much as the corpus so that the space tells items apart.
Every passage of every document is then projected; pairs of passage and item whose cosine reaches ``COSINE`` are candidates. A candidate is contaminated if the
longest common subsequence of the item's words and the text around the passage, found within a compact
stretch, covers ``VERBATIM`` of the item, or ``PARAPHRASE`` of it and nearly all of its answer, which is the
item's last sentence.

The items are the stated query set. Each block of ``ITEMS`` of them has a latent space of its own, whose rank is
above the number of its items, so that an item's share in its space doesn't fall as the benchmark grows.
``SPACES`` of these (8 MB each) go to the tasks together, against all documents, one pass each time. No text is
shuffled and no group is gathered.

Defined results: null texts, and texts or items without words, match nothing; items of equal text are all
reported; items with a null item_id are searched too and reported as null, one row a document; repeated rows
give one row each pair; an empty benchmark or table gives an empty result. The search isn't exact: tests measure
its recall against brute force, 0.9 at least.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import drop_table, ship, trim, write_table
from .licenses import words_of

BUCKETS = 1 << 14
STEP = 16
#: Blocks of STEP words in a window: powers of two.
WINDOWS = (2, 4)
RANK = 128
#: Not read: the spaces are fitted on all documents. A test sets it still.
SAMPLE = 3_000
#: Words of the passages that are fitted, sums that these are projected to, and directions taken of them.
FITTED, SKETCH, COMMON = 64, 256, 64
#: Words counted at a time, and pieces in which the tasks' counts are added up.
GROUP, SPLIT = 1 << 16, 32
#: Items that share a space: fewer than RANK, so that it holds each of them and what documents have in common.
ITEMS = 100
#: Spaces searched in one pass over the documents.
SPACES = 4
COSINE = 0.22
VERBATIM = 0.75
PARAPHRASE = 0.55
ANSWER = 0.8
#: Words projected at a time.
CHUNK = 64 * STEP


def _buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint32, len(words)) & np.uint32(BUCKETS - 1)


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return b.column("text_").cast(pa.binary()).to_pylist()


class Counts:
    """Of some documents: how many they are, how many hold a term, and the projection of their passages."""

    def __init__(self) -> None:
        self.n, self.df, self.sums = 0, np.zeros(BUCKETS, np.int64), np.zeros((BUCKETS, SKETCH), np.float32)

    def add(self, texts: list[np.ndarray], seeds: np.ndarray) -> None:
        """texts: terms of each; seeds: a random number for each, uint64. Copies with one seed go into the same sums."""
        self.n += len(texts)
        sizes = np.array([len(b) for b in texts], np.int64)
        if not sizes.sum():
            return
        passages = -(-sizes // FITTED)
        text = np.repeat(np.arange(len(texts)), passages)  # of each passage
        first = np.cumsum(passages) - passages
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys, n = np.unique((np.repeat(first, sizes) + at // FITTED) * BUCKETS + np.concatenate(texts), return_counts=True)
        passage, term = keys // BUCKETS, keys % BUCKETS
        self.df += np.bincount(np.unique(text[passage] * BUCKETS + term) % BUCKETS, minlength=BUCKETS)
        # A random number for each passage (SplitMix64).
        r = seeds[text] + (np.arange(len(text)) - first[text] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r = (r ^ (r >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        r = (r ^ (r >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        r ^= r >> np.uint64(31)
        scale = (1 - 2 * (r >> np.uint64(63)).astype(np.int64)) / np.sqrt(np.bincount(passage, n * n))
        column = (r % np.uint64(SKETCH)).astype(np.int64)
        np.add.at(self.sums.reshape(-1), term * SKETCH + column[passage], (n * scale[passage]).astype(np.float32))


def corpus_counts(docs: DataFrame) -> Counts:
    """Of all documents. docs: columns id_ and text_."""
    spark, rows = docs.sparkSession, BUCKETS // SPLIT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts, seeds, words = Counts(), [], [], 0
        for b in batches:
            for text, seed in zip(_texts(b), b.column("seed_").to_pylist(), strict=True):
                texts.append(_buckets(words_of(text)))
                seeds.append(seed)
                words += len(texts[-1])
                if words >= GROUP or len(texts) >= GROUP:
                    counts.add(texts, np.array(seeds, np.int64).view(np.uint64))
                    texts, seeds, words = [], [], 0
        counts.add(texts, np.array(seeds, np.int64).view(np.uint64))
        for k in range(SPLIT):
            part = slice(k * rows, (k + 1) * rows)
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "n": pa.array([counts.n], pa.int64()), "df": pa.array([counts.df[part].tobytes()], pa.binary()), "sums": pa.array([counts.sums[part].tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for k, n, df, sums in zip(*(b.column(c).to_pylist() for c in ("k", "n", "df", "sums")), strict=True):
                have = total.setdefault(k, [0, np.zeros(rows, np.int64), np.zeros(rows * SKETCH)])
                have[0] += n
                have[1] += np.frombuffer(df, np.int64)
                have[2] += np.frombuffer(sums, np.float32)
        for k, (n, df, sums) in total.items():
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "n": pa.array([n], pa.int64()), "df": pa.array([df.tobytes()], pa.binary()), "sums": pa.array([sums.astype(np.float32).tobytes()], pa.binary())})

    schema = "k int, n long, df binary, sums binary"
    # A task's sums are as large whatever it read, so there are few tasks; they are added up in pieces on the executors,
    # and the driver reads the result a few pieces at a time.
    few = docs.select("text_", F.xxhash64("id_", "text_").alias("seed_")).coalesce(spark.sparkContext.defaultParallelism)
    pieces, pieces_at = write_table(spark, few.mapInArrow(run, schema).repartition(SPLIT, "k").mapInArrow(add, schema), "corpus-counts")
    out = Counts()
    for r in pieces.coalesce(4).toLocalIterator():  # SPLIT rows
        part = slice(r["k"] * rows, (r["k"] + 1) * rows)
        out.n = r["n"]
        out.df[part] = np.frombuffer(r["df"], np.int64)
        out.sums[part] = np.frombuffer(r["sums"], np.float32).reshape(rows, SKETCH)
    drop_table(spark, pieces_at)
    return out


class Item:
    """A benchmark item's words, its answer's words, and masks for the bit-parallel common subsequence."""

    def __init__(self, key: int | None, text: str | None) -> None:
        self.key = key
        self.words = words_of((text or "").encode())
        parts = [p for p in re.split(r"[.?!\n]+", text or "") if words_of(p.encode())]
        self.answer = words_of(parts[-1].encode()) if len(parts) > 1 else self.words[-max(1, len(self.words) // 4) :]


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    masks: dict[bytes, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    ones = (1 << len(a)) - 1
    s = ones
    for w in b:
        m = masks.get(w)
        if m:
            u = s & m
            s = ((s + u) | (s - u)) & ones
    return len(a) - s.bit_count()


def compact(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """The best common subsequence within stretches of 1.5 times the item's length, and where its stretch begins."""
    size = len(item) + len(item) // 2 + 4
    there = frozenset(item)
    best = (0, 0)
    for at in range(0, max(1, len(text) - size // 3), max(1, size // 3)):
        part = [w for w in text[at : at + size] if w in there]
        if len(part) > best[0] and (n := lcs(item, part)) > best[0]:
            best = (n, at)
    return best


def judge(item: Item, words: list[bytes], at: int, size: int) -> tuple[float, int, str] | None:
    """Share of the item, place and kind, if the text around words[at:at + size] holds it."""
    lo = max(0, at - len(item.words))
    around = words[lo : at + size + len(item.words)]
    there = set(around)
    if sum(w in there for w in item.words) < PARAPHRASE * len(item.words):
        return None
    n, where = compact(item.words, around)
    share = n / len(item.words)
    if share >= VERBATIM:
        return share, lo + where, "verbatim"
    if share >= PARAPHRASE:
        stretch = around[where : where + len(item.words) * 3 // 2 + 4]
        if lcs(item.answer, stretch) >= ANSWER * len(item.answer):
            return share, lo + where, "paraphrase"
    return None


def _passages(b: np.ndarray, squares: np.ndarray, weighted: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First word, blocks a window, sums of the windows' projections, and their full norms, by chunks of a text.

    weighted, squares: each term's projection and squared length; the last row is nothing and fills up a block.
    """
    tail = STEP * (max(WINDOWS) - 1)
    for s in range(0, len(b), CHUNK):
        part = b[s : s + CHUNK + tail]
        n = -(-len(part) // STEP)
        part = np.concatenate((part, np.full(n * STEP - len(part), len(squares) - 1, part.dtype)))
        begin = np.arange(min(n, CHUNK // STEP))
        # Sums and squared lengths of one block, then of windows of twice as many each time; past the end there is nothing.
        sums = np.zeros((n + max(WINDOWS), weighted.shape[1]), np.float32)
        np.add.reduce(weighted.take(part, axis=0).reshape(n, STEP, -1), axis=1, out=sums[:n])
        norm = np.zeros(len(sums))
        norm[:n] = squares.take(part).reshape(n, STEP).sum(axis=1)
        m = 1
        while m < max(WINDOWS):
            sums[:-m] += sums[m:]
            norm[:-m] += norm[m:]
            m *= 2
            yield s, m, sums[begin], np.sqrt(norm[begin])


def _strongest(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of a narrow matrix, largest first, and what its columns are multiplied by for the left vectors' directions."""
    gram = np.zeros((a.shape[1], a.shape[1]))
    for at in range(0, len(a), 1024):
        part = a[at : at + 1024].astype(np.float64)
        gram += part.T @ part
    values, vectors = np.linalg.eigh(gram)
    return np.maximum(values[::-1], 0.0), vectors[:, ::-1]


def common_directions(sums: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """[BUCKETS, COMMON]: orthogonal, by strength; the squares add up to the documents' share of them, which is 1 at most. Overwrites sums."""
    sums *= idf[:, None].astype(np.float32)
    values, vectors = _strongest(sums)
    strength = np.maximum(values[:COMMON] - values[COMMON], 0.0) / np.maximum(values[:COMMON] * values.sum(), 1e-30)
    return sums @ (vectors[:, :COMMON] * np.sqrt(strength)).astype(np.float32)


def latent_space(common: np.ndarray, items: list[Item], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Orthonormal [BUCKETS, rank at most]: the SVD of the common directions and the items."""
    both = np.zeros((BUCKETS, COMMON + len(items)), np.float32)
    both[:, :COMMON] = common
    for k, item in enumerate(items, COMMON):
        terms, n = np.unique(_buckets(item.words), return_counts=True)
        v = n * idf[terms]
        both[terms, k] = v / np.sqrt((v * v).sum() * len(items))
    values, vectors = _strongest(both)
    there = np.flatnonzero(values[:rank] > 1e-9 * values[0])
    return both @ (vectors[:, there] / np.sqrt(values[there])).astype(np.float32)


class Index:
    """What a task needs to search: term weights, latent spaces and the projections of each space's items."""

    def __init__(self, blocks: list[list[Item]], idf: np.ndarray, spaces: list[np.ndarray]) -> None:
        self.items = [item for block in blocks for item in block]
        self.weighted = np.zeros((BUCKETS + 1, sum(one.shape[1] for one in spaces)), np.float32)
        np.concatenate(spaces, axis=1, out=self.weighted[:-1])
        self.weighted[:-1] *= idf[:, None].astype(np.float32)
        self.squares = np.append(idf * idf, 0.0)
        #: Terms of all items' words one after another, where each item's begin, and how many of them a text has to hold.
        self.terms = np.concatenate([_buckets(i.words) for i in self.items])
        sizes = np.array([len(i.words) for i in self.items])
        self.begin, self.least = np.cumsum(sizes) - sizes, PARAPHRASE * sizes
        self.parts: list[tuple[int, slice, np.ndarray, float]] = []
        first = column = 0
        for block, one in zip(blocks, spaces, strict=True):
            at = slice(column, column + one.shape[1])
            q = np.zeros((len(block), one.shape[1]), np.float32)
            for k, item in enumerate(block):
                b = _buckets(item.words)
                q[k] = self.weighted[b, at].sum(axis=0) / max(1e-9, float(np.sqrt(self.squares[b].sum())))
            # An item's cosine can't exceed the passage's share in the space times the item's.
            self.parts.append((first, at, q, float(np.sqrt((q * q).sum(axis=1)).max(initial=0.0))))
            first, column = first + len(block), at.stop

    def search(self, text: bytes | None) -> dict[int, tuple[float, float, int, str]]:
        """By item: cosine, share, place and kind of the best match in a whole text."""
        words = words_of(text)
        out: dict[int, tuple[float, float, int, str]] = {}
        if not words:
            return out
        b = _buckets(words)
        possible = None
        for s, m, whole, lengths in _passages(b, self.squares, self.weighted):
            for first, column, queries, most in self.parts:
                sums = whole[:, column]
                inside = np.sqrt(np.einsum("ij,ij->i", sums, sums))
                # Norms add up words as if all differed; a passage that repeats words is at least as long as its projection.
                norms = np.maximum(np.maximum(lengths, inside), 1e-9)
                able = np.flatnonzero(inside * most >= COSINE * norms)
                if not len(able):
                    continue
                if possible is None:
                    # What judge() looks at first, for all candidates of the text at once: an item of whose words it holds too few.
                    there = np.zeros(BUCKETS, dtype=bool)
                    there[b] = True
                    possible = np.add.reduceat(there[self.terms], self.begin, dtype=np.int64) >= self.least
                cosine = (sums[able] @ queries.T) / norms[able, None]
                for i, j in zip(*np.nonzero((cosine >= COSINE) & possible[first : first + len(queries)]), strict=True):
                    k = first + int(j)
                    found = judge(self.items[k], words, s + int(able[i]) * STEP, m * STEP)
                    if found and (k not in out or found[0] > out[k][1]):
                        out[k] = (float(cosine[i, j]), *found)
        return out


def indexes(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """One index for each pass over the documents. docs: columns id_ and text_."""
    counts = corpus_counts(docs)
    idf = np.log((counts.n + 1) / (counts.df + 1)) + 0.05
    common = common_directions(counts.sums, idf)
    del counts
    trim()
    rows = benchmark.select(F.col(item_col).alias("k"), F.col(text_col).alias("t")).orderBy("k", "t").toLocalIterator()
    blocks: list[list[Item]] = [[]]

    def made() -> Index:
        return Index(blocks, idf, [latent_space(common, block, idf) for block in blocks])

    for r in rows:
        item = Item(r["k"], r["t"])
        if not item.words:
            continue
        if len(blocks[-1]) == ITEMS:
            if len(blocks) == SPACES:
                yield made()
                blocks = []
            blocks.append([])
        blocks[-1].append(item)
    if blocks[0]:
        yield made()


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, share, first_word and kind of every contaminated pair."""
    ship(spark)
    given = _given(docs, id_col, text_col)
    kind, item_type = given.schema["id_"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind}, item_id {item_type.simpleString()}, cosine double, share double, first_word long, kind string"

    def searcher(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [(n, index.items[k].key, *found) for n, text in enumerate(_texts(b)) for k, found in index.search(text).items()]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    kinds = (to_arrow_type(item_type), pa.float64(), pa.float64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([b.column("id_").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "item_id", "cosine", "share", "first_word", "kind"])

        return run

    out = None
    for index in indexes(given, benchmark):
        part = given.mapInArrow(searcher(index), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("cosine", "share", "first_word", "kind"), F.struct("share", "cosine", "first_word")).alias("m")).select("doc_id", "item_id", "m.*")


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    ship(spark)
    names = docs.columns

    def keeper(index: Index, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not index.search(t) for t in b.column(at).cast(pa.binary()).to_pylist()], pa.bool_()))
            trim()

        return run

    out = docs
    for index in indexes(_given(docs, id_col, text_col), benchmark):
        out = out.mapInArrow(keeper(index, names.index(text_col)), docs.schema)
    return out

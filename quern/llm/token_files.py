"""Token files coded by a static range asymmetric numeral system (rANS).

Layout of a file set: ``tables`` holds the shared frequency table (one count a token id, scaled to 2^20),
``blocks`` independent blocks in ascending document order, and ``parts`` the number of ids in each part.
Both are Parquet, so they are written by Spark's committers and read on any file system. A block holds whole
documents. Its ids are dealt over 1,024 interleaved coders that share one stream of 32-bit words; every 128
rounds the coders' states and the place in the stream are kept, so a decoder can start at any of these
checkpoints. A CRC-32 over the stream is checked before decoding.

Counts are taken over all documents. A task holds one block and the documents of a batch; documents are
range-partitioned by id and content, so that repeated or null ids can't gather in one task.

Defined results: a null text is an empty text (only the end id); null ids come first; rows with one id are
in the order of their coded ids; an empty table gives an empty file set and result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import drop_table, parallelism, shared_folder, ship, trim, write_table

END_ID = 1
BITS = 20
LANES = 1024
EVERY = 128
#: Ids in a block, about: a block ends with the document that reaches this.
BLOCK = 1 << 18
#: Ids in a part, about.
PART = 1 << 23
_LOW = np.uint64(1 << 32)
_MASK32 = np.uint64(0xFFFFFFFF)
_B = np.uint64(BITS)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^BITS, at least 1 for every symbol that occurs, none of all of it."""
    total = 1 << BITS
    out = np.zeros(len(counts), dtype=np.int64)
    there = np.flatnonzero(counts)
    if not len(there):
        return out
    if len(there) == 1:  # a second symbol keeps the frequency below the whole
        out[there[0]] = total - 1
        out[(there[0] + 1) % len(out)] = 1
        return out
    exact = counts[there] * (total / counts.sum())
    out[there] = np.maximum(1, np.floor(exact)).astype(np.int64)
    short = total - int(out.sum())
    if short > 0:
        out[there[np.argmax(counts[there])]] += short
    for k in np.argsort(-out, kind="stable"):  # too much was given to rare symbols: the common ones pay
        if short >= 0:
            break
        pay = min(-short, int(out[k]) // 2)
        out[k] -= pay
        short += pay
    return out


class Coder:
    """Encodes and decodes blocks with one frequency table."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The stream; and checkpoints: for each, the place in the stream and the states."""
        rounds = -(-len(ids) // LANES)
        x = np.full(LANES, _LOW, dtype=np.uint64)
        chunks: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        words = 0
        f_all, c_all = self.freq[ids], self.start[ids]
        most = f_all << np.uint64(64 - BITS)
        for t in range(rounds - 1, -1, -1):
            at = slice(t * LANES, min((t + 1) * LANES, len(ids)))
            f, c = f_all[at], c_all[at]
            y = x[: len(f)]
            over = y >= most[at]
            out = y[over]
            chunks.append((out & _MASK32).astype("<u4"))
            words += len(out)
            y[over] = out >> np.uint64(32)
            q = y // f
            y[:] = (q << _B) + (y - q * f) + c
            if t % EVERY == 0:
                marks.append((words, x.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        kept = b"".join(np.uint64(words - w).astype("<u8").tobytes() + s.astype("<u8").tobytes() for w, s in reversed(marks))
        return stream.tobytes(), kept

    def decode(self, stream: bytes, checkpoints: bytes, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint ``first`` up to checkpoint ``last``, or to the end. n: ids in the block."""
        words = np.frombuffer(stream, "<u4").astype(np.uint64)
        kept = np.frombuffer(checkpoints, "<u8").reshape(-1, LANES + 1)
        if not n:
            return np.zeros(0, np.uint32)
        place, x = int(kept[first, 0]), kept[first, 1:].astype(np.uint64)
        begin, end = first * EVERY * LANES, n if last is None else min(n, last * EVERY * LANES)
        out = np.empty(end - begin, dtype=np.uint32)
        low = np.uint64((1 << BITS) - 1)
        for t in range(begin, end, LANES):
            m = min(LANES, end - t)
            y = x[:m]
            slot = y & low
            s = self.symbol[slot]
            out[t - begin : t - begin + m] = s
            y[:] = self.freq[s] * (y >> _B) + slot - self.start[s]
            need = np.flatnonzero(y < _LOW)
            y[need] = (y[need] << np.uint64(32)) | words[place : place + len(need)]
            place += len(need)
        return out


_coders: dict[bytes, Coder] = {}


def coder(table: bytes) -> Coder:
    """This worker's coder for a table of little-endian unsigned 32-bit frequencies."""
    if table not in _coders:
        _coders.clear()
        _coders[table] = Coder(np.frombuffer(table, "<u4").astype(np.int64))
    return _coders[table]


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, with END_ID after it, into a file set at path."""
    from tokenizers import Tokenizer

    ship(spark)
    tokenizer = tokenizer or tokens.default_path()
    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = "<u2" if size <= 1 << 16 else "<u4"
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"))
    end = END_ID.to_bytes(4, "little")

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(tokenizer)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [np.frombuffer(x + end, "<u4").astype(width).tobytes() for x in enc.encode(part.column("text_"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        trim()

    raw, raw_at = write_table(spark, given.mapInArrow(tokenize, "doc_id long, ids binary"), "ids")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for ids in b.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(ids, width), minlength=size) if len(ids) > 20_000 else 0
            short = b"".join(x for x in b.column("ids").to_pylist() if len(x) <= 20_000)
            total += np.bincount(np.frombuffer(short, width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    counts = np.zeros(size, dtype=np.int64)
    for r in raw.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        counts[r["id"]] = r["n"]
    table = scaled(counts).astype("<u4").tobytes()
    spark.createDataFrame([(table, BITS, LANES, EVERY)], "frequencies binary, bits int, lanes int, every int").coalesce(1).write.parquet(f"{path}/tables")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = coder(table), TaskContext.get().partitionId()
        ids: list[bytes] = []
        names: list[int | None] = []
        held = start = block = 0

        def made() -> pa.RecordBatch:
            stream, marks = c.encode(np.frombuffer(b"".join(ids), width))
            lengths = [len(x) // np.dtype(width).itemsize for x in ids]
            row = {"part": part, "block": block, "start": start, "doc_ids": names, "lengths": lengths, "stream": stream, "checkpoints": marks, "crc32": zlib.crc32(stream)}
            return pa.RecordBatch.from_pylist([row], schema=_BLOCKS)

        for b in batches:
            for name, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids.append(x)
                names.append(name)
                held += len(x) // np.dtype(width).itemsize
                if held >= BLOCK:
                    yield made()
                    start, block, held, ids, names = start + held, block + 1, 0, [], []
        if ids:
            yield made()

    parts = max(parallelism(spark), -(-int(counts.sum()) // PART))
    dealt = raw.withColumn("tie", F.xxhash64("ids")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids").drop("tie")
    blocks = dealt.mapInArrow(encode, "part int, block int, start long, doc_ids array<long>, lengths array<long>, stream binary, checkpoints binary, crc32 long")
    blocks.write.parquet(f"{path}/blocks")
    drop_table(spark, raw_at)
    sizes = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    sizes.groupBy("part").agg(F.sum("n").alias("n")).coalesce(1).write.parquet(f"{path}/parts")


_BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("stream", pa.binary()), ("checkpoints", pa.binary()), ("crc32", pa.int64())])


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if kept, ids, of every document of a file set."""
    ship(spark)
    table = bytes(spark.read.parquet(f"{path}/tables").first()["frequencies"])
    before, at = [], 0
    for r in spark.read.parquet(f"{path}/parts").orderBy("part").collect():  # a number for each part
        before.append((r["part"], at))
        at += r["n"]
    offsets = dict(before)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(table)
        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(name)[k] for name in b.schema.names}
                stream = row["stream"].as_py()
                if zlib.crc32(stream) != row["crc32"].as_py():
                    raise ValueError(f"block {row['part']}/{row['block']}: its checksum differs")
                lengths = np.array(row["lengths"].as_py(), dtype=np.int64)
                ids = c.decode(stream, row["checkpoints"].as_py(), int(lengths.sum())).astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                start = offsets[row["part"].as_py()] + row["start"].as_py() + ends - lengths
                each = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(start), pa.array(lengths), pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array(each if keep_ids else [None] * len(each), pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    out = spark.read.parquet(f"{path}/blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if keep_ids else out.drop("ids")


def file_set(spark: SparkSession, name: str) -> str:
    """A new place for a file set in the shared folder."""
    import uuid

    return f"{shared_folder(spark)}/quern/{name}-{uuid.uuid4().hex}"

"""Best-fit packing of token sequences with a swap-based local search.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Pieces are dealt
evenly into shards of bounded size. In each shard, best-fit decreasing fills bins; then bins that aren't full
are improved: the least filled gives documents away by moves, one-for-one and two-for-one exchanges with
fuller bins, each of which raises the sum of squared fills, until it is empty or no exchange is left. Bins
that stay underfull are dealt anew into fewer shards, until one shard is left, so the number of sequences
exceeds the total length divided by the capacity by little.

Defined results: a null text is an empty text, whose only token is the end mark; repeated rows are packed
each; a null doc_id is kept; an empty table gives an empty result. Only lengths travel; ids are kept on
request. The dealing is round robin, so that equal or hot keys can't gather in a shard.
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
from .common import drop_table, ship, trim, write_table

CAPACITY = 2048
END_ID = 0
#: Pieces in a shard, about; what one task holds in memory.
SHARD = 50_000
#: Bins with at most this many free places aren't opened again.
SLACK = 8


def cut(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if kept, ids (bytes of little-endian unsigned 32-bit numbers)."""
    ship(spark)
    path = path or tokens.default_path()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text_"))
    kind = given.schema["doc_id"].dataType.simpleString()
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for b in batches:
            rows, at = [], []
            for k, ids in enumerate(enc.encode(b.column("text_"))):
                ids += end
                for i, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    at.append(k)
                    rows.append((i, start // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
        trim()

    made = given.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return made if keep_ids else made.drop("ids")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the pieces of each bin. The fullest bin that still has room takes the next piece."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r is set if a bin has r free places
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = there >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                there ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > n:
            free[room - n].append(b)
            there |= 1 << (room - n)
    return bins


def _gives(own: list[int], size: np.ndarray) -> dict[int, list[int]]:
    """By total size: one piece of own, or two where no single one has that size."""
    by: dict[int, list[int]] = {}
    for x in own:
        by.setdefault(int(size[x]), []).append(x)
    out = {n: xs[:1] for n, xs in by.items()}
    sizes = sorted(by)
    for i, n in enumerate(sizes):
        for m in sizes[i:]:
            if n != m:
                out.setdefault(n + m, [by[n][0], by[m][0]])
            elif len(by[n]) > 1:
                out.setdefault(2 * n, by[n][:2])
    return out


def improve(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search between underfull bins, until a whole pass over the donors finds no exchange."""
    home = np.empty(len(lengths), dtype=np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    fill = np.bincount(home, weights=lengths, minlength=len(bins)).astype(np.int64)
    loose = np.flatnonzero(fill < capacity)
    # As many bins as can go at all.
    spare = int((capacity - fill[loose]).sum()) // capacity
    item = np.flatnonzero(np.isin(home, loose))
    item = item[np.argsort(lengths[item], kind="stable")]  # pieces of one size stand together
    size, at = lengths[item].astype(np.int64), home[item]
    sizes, starts = np.unique(size, return_index=True)
    ends = np.append(starts[1:], len(size))
    held: dict[int, list[int]] = {}
    for x, b in enumerate(at.tolist()):
        held.setdefault(b, []).append(x)
    changed = True
    while changed and spare > 0:  # an exchange may have made room for an earlier donor
        changed = False
        for donor in loose[np.argsort(fill[loose], kind="stable")].tolist():
            if not fill[donor] or spare <= 0:
                continue
            while fill[donor]:
                own = held[donor]
                room = capacity - fill
                room[(fill < fill[donor]) | (fill == 0)] = -1
                room[donor] = -1
                most = int(room.max())
                fits = [x for x in own if size[x] <= most]
                if fits:  # move: the fullest bin that has room
                    x = max(fits, key=lambda x: size[x])
                    give, to, back = [x], int(np.argmin(np.where(room >= size[x], room, capacity + 1))), []
                else:  # one-for-one or two-for-one, whichever gives most away
                    open_ = room[at]
                    top = np.maximum.reduceat(open_, starts)
                    gives = _gives(own, size)
                    totals = np.array(sorted(gives))
                    # For each size that may come back, the largest total that its roomiest bin can take instead.
                    best = np.searchsorted(totals, sizes + top, side="right") - 1
                    gain = np.where((top > 0) & (best >= 0), totals[best] - sizes, 0)
                    j = int(np.argmax(gain))
                    if gain[j] <= 0:
                        break
                    k = int(starts[j] + np.argmax(open_[starts[j] : ends[j]] >= gain[j]))
                    give, to, back = gives[int(totals[best[j]])], int(at[k]), [k]
                moved = int(size[give].sum() - size[back].sum())
                held[donor] = [x for x in own if x not in give] + back
                held[to] = [x for x in held[to] if x not in back] + give
                at[give], at[back] = to, donor
                fill[to] += moved
                fill[donor] -= moved
                changed = True
            if not fill[donor]:
                spare -= 1
    home[item] = at
    out: dict[int, list[int]] = {}
    for i, b in enumerate(home.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill, of each piece."""
    bins = improve(lengths, best_fit(lengths, capacity), capacity)
    seq, offset, fill = (np.zeros(len(lengths), dtype=np.int64) for _ in range(3))
    for b, items in enumerate(bins):
        n = lengths[items]
        ends = np.cumsum(n)
        seq[items], offset[items], fill[items] = b, ends - n, ends[-1]
    return seq, offset, fill


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The rows of pieces with sequence_id and offset. pieces: a column ``length`` of 1 to capacity, and any others."""
    ship(spark)
    left, left_at = write_table(spark, pieces, "pieces")
    names = pieces.columns
    done: list[DataFrame] = []
    n, turn = left.count(), 0
    while n:
        shards = -(-n // shard)

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            if not got:
                return
            t = pa.Table.from_batches(got).combine_chunks()
            seq, offset, fill = place(t.column("length").to_numpy(), capacity)
            seq += (turn << 48) + (TaskContext.get().partitionId() << 24)
            for name, x in (("sequence_id", seq), ("offset", offset), ("fill_", fill)):
                t = t.append_column(name, pa.array(x))
            yield from t.to_batches(max_chunksize=10_000)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields)
        packed, packed_at = write_table(spark, left.repartition(shards).mapInArrow(run, f"{schema}, sequence_id long, offset long, fill_ long"), "packed")
        again = packed.where(F.col("fill_") < capacity - SLACK).select(*names)
        turn += 1
        more = again.count() if shards > 1 else 0
        if not more or -(-more // shard) >= shards:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill_") >= capacity - SLACK))
        left, n = again, more
    if not done:
        return left.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    drop_table(spark, left_at)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("fill_")


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    return pack(spark, cut(spark, docs, capacity, keep_ids), capacity)


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of whole sequences, from pieces with ids: at most capacity tokens a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p.ids)).alias("ids"))

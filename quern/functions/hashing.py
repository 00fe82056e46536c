"""FNV-1a and SimHash. Spark has no FNV, so hashes are made in Arrow batches, one pass, no shuffle."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CJK = re.compile("[㐀-䶿一-鿿豈-﫿]")
_LATIN = re.compile("[a-z0-9]+")
#: The parameters of 64-bit FNV-1a.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


@lru_cache(maxsize=1 << 18)
def fnv1a64(token: str) -> int:
    """Over UTF-16 units."""
    h = OFFSET
    units = token.encode("utf-16-le", "surrogatepass")
    for lo, hi in zip(units[::2], units[1::2], strict=True):
        h = ((h ^ (lo | hi << 8)) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def simhash_tokens(text: str) -> list[str]:
    """CJK bigrams across gaps, the last one single; then lower-case Latin words and numbers."""
    cjk = _CJK.findall(text)
    pairs = [a + b for a, b in zip(cjk, [*cjk[1:], ""], strict=False)]
    return pairs + _LATIN.findall(text.lower())


def simhash(tokens: list[str]) -> int:
    """Bit pattern as a signed 64-bit number: a bit is set if its votes, weighted by frequency, are positive."""
    weights: dict[str, int] = {}
    for t in tokens:
        weights[t] = weights.get(t, 0) + 1
    if not weights:
        return 0
    hashes = np.fromiter(map(fnv1a64, weights), np.uint64, len(weights))
    w = np.fromiter(weights.values(), np.int64, len(weights))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = 2 * (w @ bits) - w.sum()
    return int(np.packbits(votes > 0, bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fnv1a64_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else (fnv1a64(x) ^ (1 << 63)) - (1 << 63)).astype("Int64")


@F.pandas_udf(T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("simhash", T.LongType())]))
def simhash_udf(s: pd.Series) -> pd.DataFrame:
    rows = [(len(t), simhash(t)) for t in (simhash_tokens(x or "") for x in s)]
    return pd.DataFrame(rows, columns=["n_tokens", "simhash"])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(h: Column) -> Column:
    """Four structs of band number and its 16 bits."""
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("key")) for k in range(4)])

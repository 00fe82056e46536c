"""Text functions as Column expressions. Those that change text run in the JVM; those that count characters go by Arrow
batches, since Spark's regexp_count makes a string of each match."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that the cleaning rules know, as the inside of a regex class.
WHITE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Characters that are always removed.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{200B}-\x{200F}\x{2028}\x{2029}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}]"
#: CONTROL, told from most other characters by two ranges before its own are tried.
_CONTROL = rf"[[^ -~\x{{2100}}-\x{{FEFE}}]&&{CONTROL}]"
TAG = r"<[^>]*>"
URL = rf"(?i)https?://[^{WHITE}<>\"')\]}}]+"
#: Masks, in the order of their application. Word characters are ASCII.
MASKS = (
    (r"(?<![A-Za-z0-9_])[0-9]{17}[0-9Xx](?![A-Za-z0-9_])", "[ID]"),
    (r"(?<![A-Za-z0-9_])1[3-9][0-9]{9}(?![A-Za-z0-9_])", "[PHONE]"),
    (r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+", "[EMAIL]"),
)
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
#: Ranges of characters that speak for no language.
NEUTRAL = ((0x3000, 0x303F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF5E), (0xFE30, 0xFE4F), (0x2013, 0x2014), (0x2018, 0x2019), (0x201C, 0x201D), (0x2026, 0x2026), (0xA0, 0xA0))
#: The characters of WHITE.
WHITES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LANGUAGES = ("zh", "ja", "ko", "en", "other")


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _where(s: Column, there: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """change(s) where a cheap look says that there is something to change; s is evaluated once."""
    return let(s, lambda x: F.when(there(x), change(x)).otherwise(x))


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"


def full_width_to_half(s: Column) -> Column:
    """U+FF01-FF5E and U+3000 only; other compatibility characters stay."""
    beyond_ascii = lambda x: F.octet_length(x) > F.length(x)
    there = lambda x: F.when(beyond_ascii(x), x.rlike(r"[\x{FF01}-\x{FF5E}\x{3000}]")).otherwise(False)
    return _where(s, there, lambda x: F.translate(x, _WIDE, "".join(chr(ord(c) - 0xFEE0) for c in _WIDE[:-1]) + " "))


def unify_newlines(s: Column) -> Column:
    return _where(s, lambda x: x.contains("\r"), lambda x: F.regexp_replace(x, "\r\n?", "\n"))


def strip_control(s: Column) -> Column:
    return F.regexp_replace(s, _CONTROL, "")


def strip_tags(s: Column) -> Column:
    return _where(s, lambda x: x.contains("<"), lambda x: F.regexp_replace(x, TAG, ""))


def strip_urls(s: Column) -> Column:
    return _where(s, lambda x: x.contains("://"), lambda x: F.regexp_replace(x, URL, ""))


def mask_pii(s: Column) -> Column:
    (number, mark), (phone, phone_mark), (mail, mail_mark) = MASKS
    numbers = lambda x: F.regexp_replace(F.regexp_replace(x, number, F.lit(mark)), phone, F.lit(phone_mark))
    s = _where(s, lambda x: x.rlike("[0-9]{11}"), numbers)
    return _where(s, lambda x: x.contains("@"), lambda x: F.regexp_replace(x, mail, F.lit(mail_mark)))


def collapse_spaces(s: Column) -> Column:
    return F.regexp_replace(s, "[ \t]{2,}", " ")


def collapse_newlines(s: Column) -> Column:
    return _where(s, lambda x: x.contains("\n\n\n"), lambda x: F.regexp_replace(x, "\n{3,}", "\n\n"))


def trim(s: Column) -> Column:
    """Of Unicode white space."""
    return F.btrim(s, F.lit(WHITES))


def clean_text(s: Column, half: bool = True, mask: bool = True, collapse: bool = False) -> Column:
    """The whole chain, in its fixed order."""
    s = full_width_to_half(s) if half else s
    s = strip_urls(strip_tags(strip_control(unify_newlines(s))))
    s = mask_pii(s) if mask else s
    s = collapse_spaces(s) if collapse else s
    return trim(collapse_newlines(s))


def utf16_length(s: Column) -> Column:
    return (F.length(s) + F.regexp_count(s, F.lit(ASTRAL))).cast("long")


def total_chars(texts: Column) -> Column:
    return F.aggregate(texts, F.lit(0).cast("long"), lambda a, s: a + utf16_length(s))


#: Kinds of characters, as bits.
_WHITE_, _GOOD, _HAN, _KANA, _HANGUL, _QUIET = (1 << k for k in range(6))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point. Letters and numbers are those of Unicode 15.0, as in SQL: CJK extension I came after it."""
    out = np.zeros(0x110000, np.uint8)
    mark = lambda bit, *ranges: [out.__setitem__(slice(a, b + 1), out[a : b + 1] | bit) for a, b in ranges]
    category = list(map(unicodedata.category, map(chr, range(0x110000))))
    out[[k for k, c in enumerate(category) if c[0] in "LN" and not 0x2EBF0 <= k <= 0x2EE5D]] |= _GOOD
    out[[k for k, c in enumerate(category) if c == "Nd"]] |= _QUIET
    out[[ord(c) for c in WHITES]] |= _WHITE_
    out[[ord(c) for c in WHITES if c != "\ufeff"]] |= _QUIET
    mark(_HAN, (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF))
    mark(_KANA, (0x3040, 0x30FF))
    mark(_HANGUL, (0xAC00, 0xD7AF))
    # Neutral: white space, digits of any script, ASCII punctuation, and NEUTRAL; ASCII letters count by word.
    mark(_QUIET, (0x1C, 0x1F), (0x21, 0x2F), (0x3A, 0x7E), (0x85, 0x85), (0xB2, 0xB3), (0xB9, 0xB9), *NEUTRAL)
    return out


def _counted(s: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, their numbers and their kinds."""
    codes = np.frombuffer(s.encode(), np.uint8) if s.isascii() else np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() < 1 << 16:
        n = np.bincount(codes)
        codes = np.flatnonzero(n)
        n = n[codes]
    else:
        codes, n = np.unique(codes, return_counts=True)
    return codes, n, _kinds()[codes]


@F.pandas_udf(T.StructType().add("total_chars", T.LongType()).add("worst_repeat", T.DoubleType()).add("meaningful", T.DoubleType()))
def measures(texts: pd.Series) -> pd.DataFrame:
    """Of arrays of texts: UTF-16 units; the largest share of one character in any text, 0 for texts of fewer than five
    units besides white space; letters and numbers among all units that aren't white space, pooled, 0 if there are none.
    A null text has no number of units, no letters and no repeats."""

    def measure(array: list[str | None] | None) -> tuple[int | None, float, float]:
        total, worst, good, solid, known = 0, 0.0, 0, 0, array is not None
        for s in () if array is None else array:
            if s is None:
                known = False
                continue
            codes, n, kinds = _counted(s)
            size = n * (1 + (codes > 0xFFFF))
            total += int(size.sum())
            there = kinds & _WHITE_ == 0
            units = int(size[there].sum())
            solid += units
            good += int(n[kinds & _GOOD != 0].sum())
            if units >= 5:
                worst = max(worst, float(n[there].max() / units))
        return total if known else None, worst, good / solid if known and solid else 0.0

    rows = list(map(measure, texts))
    return pd.DataFrame({"total_chars": pd.Series([r[0] for r in rows], dtype="Int64"), "worst_repeat": [r[1] for r in rows], "meaningful": [r[2] for r in rows]})


def worst_repeat_ratio(texts: Column) -> Column:
    """Largest share of one character in any text; 0 for texts of fewer than five UTF-16 units besides white space."""
    return measures(texts).worst_repeat


def meaningful_ratio(texts: Column) -> Column:
    """Letters and numbers among all characters that aren't white space, pooled over texts; 0 if there are none."""
    return measures(texts).meaningful


@F.pandas_udf(T.StructType([T.StructField(k, T.LongType()) for k in LANGUAGES]))
def script_counts(texts: pd.Series) -> pd.DataFrame:
    """Characters by script; Latin by words. Kana claims the Han characters beside it."""

    def count(s: str | None) -> tuple:
        if s is None:
            return (None,) * len(LANGUAGES)
        _, n, kinds = _counted(s)
        of = lambda bit: int(n[kinds & bit != 0].sum())
        han, kana, hangul = of(_HAN), of(_KANA), of(_HANGUL)
        letter = (np.frombuffer(s.encode("utf-8", "surrogatepass"), np.uint8) | 32) - np.uint8(97) < 26
        words = int(np.count_nonzero(letter[1:] > letter[:-1])) + int(letter[:1].sum())
        return 0 if kana else han, kana + han if kana else 0, hangul, words, int(n.sum()) - of(_HAN | _KANA | _HANGUL | _QUIET)

    rows = list(map(count, texts))
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype="Int64") for k, name in enumerate(LANGUAGES)})


def script_shares(s: Column) -> Column:
    """Struct of shares, null without script content."""

    def shares(c: Column) -> Column:
        total = sum((c[k] for k in LANGUAGES), F.lit(0))
        return F.when(total > 0, F.struct(*[(c[k] / total).alias(k) for k in LANGUAGES]))

    return let(script_counts(s), shares)


def dominant(shares: Column) -> Column:
    """The first language of the largest share."""
    top = F.greatest(*[shares[k] for k in LANGUAGES])
    out = F.when(shares[LANGUAGES[0]] == top, LANGUAGES[0])
    for k in LANGUAGES[1:]:
        out = out.when(shares[k] == top, k)
    return out


def language_ok(shares: Column, allowed: tuple[str, ...]) -> Column:
    top = F.greatest(*[shares[k] for k in LANGUAGES])
    known = sum((shares[k] for k in LANGUAGES if k in allowed), F.lit(0.0))
    return F.when(shares.isNull(), True).otherwise((dominant(shares).isin(*allowed) & (top >= 0.5)) | (known >= 0.85))


def round_half_up(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + 0.5) / 10**places


def contains_ignoring_case(s: Column, part: str) -> Column:
    return F.contains(F.lower(s), F.lit(part.lower()))


def preview(json: Column, most: int) -> Column:
    return F.when(F.length(json) > most, F.concat(F.left(json, F.lit(most)), F.lit("…"))).otherwise(json)


def slug(s: Column) -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9_-]+", "-"), r"^-+|-+\z", "")
    return F.when(made == "", "run").otherwise(made)

"""License scans as an exact set-similarity join of text blocks with license templates.

A block is a run of ``2 * L`` words, one every ``L`` words, ``L`` being the longest template's length, so any
place where a template could stand is inside a block. A block meets a template when it holds at least
``share`` of the template's distinct words. Words are ordered by their frequency over all documents, rarest
first; a block is a candidate only if it holds a word of the template's prefix (prefix filter), enough
distinct words (length filter), and enough words can still match after the first prefix word found
(positional filter). Candidates are verified, so the join is exact.

The templates are a parameter and go to every task, so their words are bounded by ``MOST_WORDS``; these are counted
in one aggregation whose size is that of the templates' vocabulary. Texts are read whole and never shuffled.
``find`` gives every block that meets a template, with its place and containment; ``scan`` sums them up by document.

Defined results: a null text is empty: no words, null first_word and last_word, empty labels, score 0. A
base phrase scores 1. Repeated rows are judged each, ties between words of one frequency go by the word, an
empty table gives an empty result, extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

#: What counts as a base phrase, and its label.
PHRASES = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
#: License notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
SHARE = 0.8
#: Words of all templates together, at most: they are sent to all tasks.
MOST_WORDS = 1_000_000
#: Separators become spaces, A-Z lower-case; bytes of characters beyond ASCII stay.
_WORDS = bytes(32 if c <= 0x2F or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

RESULT = "doc_id {id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text_").cast(pa.binary()).to_pylist()


def frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences of the templates' words over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(vocabulary, 0)
        for b in batches:
            for text in _texts(b):
                for w in words_of(text):
                    if w in seen:
                        seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text_").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class Matcher:
    """Templates in the global order of words, with an index of their prefixes."""

    def __init__(self, templates, share: float, counts: dict[bytes, int]) -> None:
        self.step = max((len(words_of(t.encode())) for _, t in templates), default=1)
        self.templates: list[tuple[str, list[bytes], int]] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, text in templates:
            ordered = sorted(set(words_of(text.encode())), key=lambda w: (counts.get(w, 0), w))
            need = max(1, ceil(share * len(ordered) - 1e-9))
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, ordered, need))
        self.keys = frozenset(self.prefix)

    def blocks(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """First word, template and containment of every block that meets the threshold."""
        if self.keys.isdisjoint(words):
            return []
        met: list[tuple[int, int, float]] = []
        first: dict[int, dict[int, int]] = {}  # block -> template -> least prefix position found
        last = max(0, (len(words) - 1) // self.step)
        for at, w in enumerate(words):
            if w in self.prefix:
                k = at // self.step
                for block in (k - 1, k) if k else (0,):
                    if block <= max(0, last - 1):
                        found = first.setdefault(block, {})
                        for t, i in self.prefix[w]:
                            found[t] = min(i, found.get(t, i))
        for block, found in sorted(first.items()):
            there = set(words[block * self.step : (block + 2) * self.step])
            for t, i in sorted(found.items()):
                _, ordered, need = self.templates[t]
                if len(there) < need or len(ordered) - i < need:
                    continue
                n = 0
                for j in range(i, len(ordered)):
                    if n + len(ordered) - j < need:
                        break
                    n += ordered[j] in there
                if n >= need:
                    met.append((block * self.step, t, n / len(ordered)))
        return met


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    starts, labels = [], set()
    at = -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return starts, labels
        for phrase, label in PHRASES.items():
            parts = phrase.split()
            if at + 1 >= len(parts) and words[at + 1 - len(parts) : at + 1] == parts:
                starts.append(at + 1 - len(parts))
                labels.add(label)


def _matcher(given: DataFrame, templates, share: float) -> Matcher:
    if sum(len(words_of(t.encode())) for _, t in templates) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words: scan with parts of them")
    vocabulary = frozenset(w for _, t in templates for w in words_of(t.encode()))
    return Matcher(templates, share, frequencies(given, vocabulary))


def find(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, block_word, n_words, template, label, containment of every block that meets a template."""
    ship(spark)
    given = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    matcher = _matcher(given, templates, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text in enumerate(_texts(b)):
                words = words_of(text)
                rows += [(k, at, len(words[at : at + 2 * matcher.step]), t, matcher.templates[t][0], c) for at, t, c in matcher.blocks(words)]
            if rows:
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column("id_").take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "block_word", "n_words", "template", "label", "containment"])

    return given.mapInArrow(run, f"doc_id {given.schema['id_'].dataType.simpleString()}, block_word long, n_words long, template int, label string, containment double")


def scan(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: words, base places and labels, all labels, and the best containment (1 for a base phrase)."""
    ship(spark)
    given = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"))
    matcher = _matcher(given, templates, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in _texts(b):
                words = words_of(text)
                starts, base = base_places(words) if text and b"license" in text.translate(_WORDS) else ([], set())
                met = matcher.blocks(words)
                score = max([1.0 * bool(base), *(c for _, _, c in met)])
                labels = base | {matcher.templates[t][0] for _, t, _ in met}
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column("id_"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return given.mapInArrow(run, RESULT.format(id=given.schema["id_"].dataType.simpleString()))

"""Token ids of whole texts by a public tokenizer, with words and pieces remembered between texts.

word_bpe_49k.json drops white space, lower-cases, and encodes each contraction, run of letters, digit and run of
other characters by itself, so the ids of a text are those of its pieces one after another. Pieces of a few
megabytes of texts are told apart by their bytes, Arrow numbers the distinct ones, each of these is looked up once,
and only new ones go through the tokenizer's BPE model. Texts with characters beyond ASCII and U+00C0 to U+00FF
are split at white space; their words go through the library and are remembered. Texts with separators that Python
and the tokenizer don't agree on are encoded whole by the library, and so is any text under a tokenizer that isn't
of this kind.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

assert sys.byteorder == "little" and array("I").itemsize == 4  # noqa: S101 - ids are kept as bytes in this form

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces remembered by a worker in each of two generations: a full table becomes the old one, from which those in
#: use come back. About 100 MB in all.
REMEMBER = 250_000
#: Longer pieces and words aren't remembered.
LONGEST = 64
#: Bytes of text that are taken apart at a time, or one text.
SPLIT = 8 << 20
#: Python splits words at these characters, the tokenizer doesn't; and what may begin a special token.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "<|")
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
#: Of each byte of a lower-cased text; 0xC3 and what follows it are letters.
_KIND = np.array([_BLANK if c in b" \t\n\x0b\f\r" else _DIGIT if 0x30 <= c <= 0x39 else _LETTER if 0x61 <= c <= 0x7A or c >= 0x80 else _OTHER for c in range(256)], np.uint8)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Remembered(dict):
    """Ids by piece or word; what is missing comes from the older generation or from ``learn``."""

    def __init__(self, learn: Callable) -> None:
        super().__init__()
        self.learn = learn
        self.old: dict = {}

    def __missing__(self, piece: bytes | str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.learn(piece)
            if len(piece) > LONGEST:
                return ids
        if len(self) >= REMEMBER:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def edges(data: np.ndarray, low: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where pieces, and runs of white space, begin, and the end. low: data in lower case. cuts: where texts begin, and the end."""
    n = len(low)
    kind = _KIND[low]
    edge = np.ones(n + 1, dtype=bool)
    edge[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cut = np.zeros(n + 3, dtype=bool)
    cut[cuts] = edge[cuts] = True
    # Contractions: an apostrophe that begins a run takes these letters with it.
    q = np.flatnonzero(low == ord("'"))
    q = q[edge[q] & ~cut[q + 1]]
    padded = np.concatenate((low, np.zeros(3, np.uint8)))
    a, b = padded[q + 1], padded[q + 2]
    is_ = lambda x, c: x == ord(c)
    one = is_(a, "s") | is_(a, "t") | is_(a, "m") | is_(a, "d")
    two = (((is_(a, "r") | is_(a, "v")) & is_(b, "e")) | (is_(a, "l") & is_(b, "l"))) & ~cut[q + 2]
    for at, size in ((q[one], 1), (q[two], 2)):
        edge[at + 1] = False
        edge[at + 1 + size] = True
    return np.flatnonzero(edge)


class Encoder:
    """encode(texts): the ids of each, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = json.dumps(spec.get("pre_tokenizer"))
        self.by_word = spec["model"]["type"] == "BPE" and '"add_prefix_space": false' in pre and "[^\\\\s" in pre and spec["model"].get("end_of_word_suffix") == "</w>" and spec.get("post_processor") is None
        model = self.tokenizer.model
        shown = {c: "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in range(256)} if self.by_word else {}
        self.pieces = Remembered(lambda p: b"" if _KIND[p[0]] == _BLANK else array("I", [t.id for t in model.tokenize(p.decode("utf-8", "replace").translate(shown))]).tobytes())
        self.words = Remembered(self._library)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _slow(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in _ODD):
            return self._library(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def _fast(self, data: np.ndarray, cuts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of each text, and which texts have to go the other way. cuts: where texts begin in data, and the end."""
        low = _LOWER[data]
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        low[after[(data[after] >= 0x80) & (data[after] <= 0x9E)]] |= 0x20
        begin = edges(data, low, cuts)
        runs = pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(begin.astype(np.int32)), pa.py_buffer(low)]).dictionary_encode()
        ids = list(map(self.pieces.__getitem__, runs.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), runs.indices.to_numpy()
        n = sizes[at]
        total = np.concatenate(([0], np.cumsum(n)))
        found = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - total[:-1], n) + np.arange(total[-1])].tobytes()
        ends = (4 * total[np.searchsorted(begin, cuts)]).tolist()
        other = (data >= 0xC4) | (data == 0xC2)
        other[after] |= (data[after] == 0x97) | (data[after] == 0xB7)  # the signs of multiplication and division
        other[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        return [found[i:j] for i, j in zip(ends, ends[1:], strict=False)], np.unique(np.searchsorted(cuts, np.flatnonzero(other), side="right") - 1)

    def _slices(self, texts: pa.Array) -> Iterator[pa.Array]:
        room = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SPLIT
        cuts = [0, *(np.flatnonzero(np.diff(room)) + 1).tolist(), len(texts)]
        return (texts.slice(i, j - i) for i, j in zip(cuts, cuts[1:], strict=False) if i < j)

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """A null is an empty text."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_word:
            return list(map(self._slow, texts.to_pylist()))
        out: list[bytes] = []
        for part in self._slices(texts):
            raw = part.cast(pa.binary())
            cuts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            if cuts[-1] == cuts[0]:
                out += [b""] * len(raw)
                continue
            data = np.frombuffer(raw.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
            found, slow = self._fast(data, cuts - cuts[0])
            for k in slow.tolist():
                found[k] = self._slow(part[k].as_py())
            out += found
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]

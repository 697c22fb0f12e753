"""Token ids of whole Arrow string columns by a public tokenizer file.

The tokenizers library encodes about 1 MB a second. The tokenizer of ``word_bpe_49k.json`` treats every piece
between its splits on its own, so each distinct piece is encoded by the library once per process and the texts
are put together from those ids in NumPy. Texts with characters whose normalisation is not plain (outside
Latin letters and common punctuation) or with a special token's string go through the library whole, and so does a
slice of texts with pieces that the library splits otherwise.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from framestride.llm.text import U, mix, powers, text_slices

#: Bytes of text that are put together at a time, distinct pieces kept per process, and ids after which all are forgotten.
SLICE_BYTES, PIECES, IDS = 1 << 18, 1 << 20, 1 << 23

#: Code points that the quick way handles besides those below 0x250, white space, and contractions.
_PUNCTUATION = ((0x2010, 0x2028), (0x2030, 0x205F), (0x20A0, 0x20C0))
_SPACES = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_LETTER, _DIGIT, _OTHER, _SPACE, _HARD = range(1, 6)
_LIMIT = 0x2100


@cache
def _classes() -> np.ndarray:
    kinds = np.full(_LIMIT + 1, _HARD, np.uint8)
    for first, last in ((0, 0x250), *_PUNCTUATION):
        for c in range(first, last):
            kind = unicodedata.category(chr(c))[0]
            kinds[c] = _SPACE if c in _SPACES else _LETTER if kind == "L" else _DIGIT if kind == "N" else _OTHER
    return kinds


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts, equal to ``encode(text, add_special_tokens=False)`` of the tokenizer file at ``path``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._special = special
        self._ends = np.zeros(self.library.get_vocab_size(), bool)
        for piece, i in self.library.get_vocab().items():
            self._ends[i] = piece.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, U)
        self._first = np.zeros(0, np.uint32)
        self._size = np.zeros(0, np.uint32)
        self._ids = np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new pieces, given by ascending keys and their bounds, and add them to the table."""
        if (len(self._known) + len(keys) > PIECES or len(self._ids) > IDS) and len(self._known):
            raise _Full
        size = ends - starts + 1
        total = np.concatenate([[0], np.cumsum(size)])
        spaced = points[np.minimum(np.repeat(starts - total[:-1], size) + np.arange(total[-1]), len(points) - 1)]
        spaced[total[1:] - 1] = 32
        encoded = self.library.encode_batch_fast([spaced.tobytes().decode("utf-32-le")], add_special_tokens=False)[0]
        ids = np.array(encoded.ids, np.uint32)
        last = np.flatnonzero(self._ends[ids])
        sizes = np.diff(last, prepend=-1)
        if len(last) != len(keys):
            raise _Otherwise
        first = len(self._ids) + last + 1 - sizes
        self._ids = np.concatenate([self._ids, ids])
        at = np.searchsorted(self._known, keys)
        self._known = np.insert(self._known, at, keys)
        self._first = np.insert(self._first, at, first.astype(np.uint32))
        self._size = np.insert(self._size, at, sizes.astype(np.uint32))

    def _pieces(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the pieces of lower-case code points."""
        kind = _classes()[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        fresh = np.ones(n, bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        fresh |= edge[:n]
        # An apostrophe alone before a letter takes a contraction with it.
        quote = np.flatnonzero((points[:-1] == 39) & fresh[:-1] & (kind[1:] == _LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
        if len(quote):
            padded = np.concatenate([points, np.zeros(2, points.dtype)])
            ends = np.concatenate([edge, np.ones(2, bool)])
            one, two = padded[quote + 1], np.where(ends[quote + 2], 0, padded[quote + 2])
            length = np.zeros(len(quote), np.int64)
            for text in _CONTRACTIONS:
                same = one == ord(text[0])
                if len(text) == 2:
                    same &= two == ord(text[1])
                length[same] = len(text)
            hit = length > 0
            quote, length = quote[hit], length[hit]
            fresh[quote + 1] = False
            after = quote + 1 + length
            inside = after < n
            fresh[after[inside]] = True
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], n)
        keep = kind[starts] != _SPACE
        starts, ends = starts[keep], ends[keep]
        return starts, ends, np.searchsorted(bounds, starts, "right") - 1

    def _quick(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        starts, ends, text = self._pieces(points, bounds)
        sums = np.zeros(len(points) + 1, U)
        power, inverse = powers(len(points) + 1)
        np.cumsum(mix(points.astype(U) * U(0xD1B54A32D192ED03) + U(7)) * power[: len(points)], out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * inverse[starts])
        unique, where, inverse_of = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, unique)
        new = np.ones(len(unique), bool)
        inside = at < len(self._known)
        new[inside] = self._known[at[inside]] != unique[inside]
        if new.any():
            try:
                self._learn(unique[new], points, starts[where[new]], ends[where[new]])
            except _Full:
                self._forget()
                return self._quick(texts)
            at = np.searchsorted(self._known, unique)
        slot = at[inverse_of]
        size, first = self._size[slot].astype(np.int64), self._first[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.repeat(first - total[:-1], size) + np.arange(total[-1])
        counts = np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64) if len(text) else np.zeros(len(texts), np.int64)
        return self._ids[index], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, concatenated (uint32), and the number of ids of each text."""
        plain, hard = [], []
        for i, t in enumerate(texts):
            low = t.lower()
            if low.isascii():
                easy = True
            else:
                points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
                easy = bool((_classes()[np.minimum(points, _LIMIT)] != _HARD).all())
            if easy and "<|" in t and any(s in t for s in self._special):
                easy = False
            (plain if easy else hard).append((i, low if easy else t))
        counts = np.zeros(len(texts), np.int64)
        parts: dict[int, np.ndarray] = {}
        try:
            ids, sizes = self._quick([t for _, t in plain]) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        except _Otherwise:
            plain, hard = [], list(enumerate(texts))
            ids, sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        counts[[i for i, _ in plain]] = sizes
        if not hard:
            return ids, counts
        for (i, _), chunk in zip(plain, np.split(ids, np.cumsum(sizes)[:-1])):
            parts[i] = chunk
        for i, t in hard:
            parts[i] = np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32)
            counts[i] = len(parts[i])
        return np.concatenate([parts[i] for i in range(len(texts))]), counts

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, row after the last, ids, ids per row)`` for slices of a string column; null is empty."""
        for first, last, texts in text_slices(column, SLICE_BYTES):
            yield first, last, *self.encode(texts)


class _Full(Exception):
    """The table of pieces would grow past its bound."""


class _Otherwise(Exception):
    """The library splits pieces otherwise than the quick way."""


@cache
def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    return Encoder(path)

"""Vectorised hashing of the tokens, n-grams and windows of an Arrow string column.

A token's hash is a polynomial over its bytes modulo 2**64 (every byte first mapped to a random word), taken from
prefix sums, so a batch costs a few numpy passes over its bytes and no Python object per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_WORDS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: White space and ASCII punctuation.
PUNCT = SPACE.copy()
PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
#: The tokens that PUNCT leaves, as a pattern.
WORD_PATTERN = r"[^\x09-\x0d !-/:-@\[-`{-~]+"
SPACE_PATTERN = r"[^\x09-\x0d ]+"

CHUNK_BYTES = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_power[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, x in enumerate((_BASE, _BACK)):
            a = np.full(size, x, np.uint64)
            a[0] = 1
            _power[k] = np.multiply.accumulate(a)
    return _power[0][:n], _power[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    at, n = 0, len(texts)
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


class Tokens:
    """Hashes of the tokens of the texts of one Arrow array; ``off[i]:off[i+1]`` are those of text i."""

    def __init__(self, texts: pa.Array, apart: np.ndarray = SPACE, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.utf8_lower(texts)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        n = len(self.bytes)
        inside = ~apart[self.bytes]
        cut = off[off < n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[cut] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        power, back = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_WORDS[self.bytes] * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))
        self.off = np.searchsorted(self.start, off)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``length`` tokens that stay inside a text, and the token at which each begins."""
        n = len(self.hash)
        if n < length:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        power, back = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * power[:n], out=total[1:])
        ends = np.repeat(self.off[1:], np.diff(self.off))
        at = np.flatnonzero(np.arange(n) + length <= ends)
        return mix((total[at + length] - total[at]) * back[at] + np.uint64(length)), at


def string_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hashes of the strings ``data[start:stop]`` of one array of bytes, as those of tokens."""
    power, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_WORDS[data] * power[: len(data)], out=total[1:])
    return mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def binaries(words: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Slices ``bounds[i]:bounds[i+1]`` of an array as a binary column, without a copy."""
    raw = np.ascontiguousarray(words)
    offsets = (bounds * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])

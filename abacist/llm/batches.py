"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than the six ASCII blanks. Texts are handled in
pieces of a quarter of a megabyte, so a task's memory does not follow its batch size.
Hashes have 64 bits: two different words or sequences of one corpus of 10**9
distinct ones collide with a probability of about 3 %, and only in figures that
compare them; nothing here decides on fewer bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 18
BLANKS = b" \t\n\v\f\r"

_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def table(chars: bytes) -> np.ndarray:
    """Which of the 256 byte values are among ``chars``."""
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd factor and of its inverse modulo 2**64, made as far as needed."""

    def __init__(self, factor: int, inverse: int):
        self.factors, self.made = (factor, inverse), (np.ones(1, np.uint64),) * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.made[0]) < n:
            size = max(n, 2 * len(self.made[0]))
            made = [np.full(size, f, np.uint64) for f in self.factors]
            for x in made:
                x[0] = 1
            self.made = tuple(map(np.cumprod, made))
        return self.made


class Sums:
    """Running weighted sums of 64-bit values: hashes of any stretch in constant time."""

    def __init__(self, values: np.ndarray, powers: Powers):
        forth, self.back = powers.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * forth[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


@dataclass
class Words:
    """The words of the texts of one piece; ``bounds[d]:bounds[d + 1]`` are those of text ``d``."""

    buffer: np.ndarray
    text_starts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


class Hasher:
    """Hashes of stretches of bytes, and of stretches of words."""

    def __init__(self):
        self.byte_values = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64)
        self.byte_powers, self.word_powers = Powers(_ODD, _ODD_INVERSE), Powers(_Q, _Q_INVERSE)

    def bytes_sums(self, buffer: np.ndarray) -> Sums:
        return Sums(self.byte_values[buffer], self.byte_powers)

    def words(self, words: Words) -> np.ndarray:
        return self.bytes_sums(words.buffer).of(words.starts, words.ends)

    def word_sums(self, hashes: np.ndarray) -> Sums:
        return Sums(hashes, self.word_powers)


def find_words(texts: list[bytes], blank: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Words of ``texts``; ``fold`` maps byte values before they are looked at."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if fold is not None:
        buffer = fold[buffer]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_starts = np.concatenate([[0], np.cumsum(sizes)])
    solid = np.concatenate([[False], ~blank[buffer], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    return Words(buffer, text_starts, starts, ends, np.searchsorted(starts, text_starts))


def pieces(texts: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) of neighbouring texts that together hold about ``size`` bytes."""
    at, held, used = 0, [], 0
    for i, text in enumerate(texts.cast(pa.binary())):
        value = text.as_py() or b""
        if held and used + len(value) > size:
            yield at, held
            at, held, used = i, [], 0
        held.append(value)
        used += len(value)
    if held:
        yield at, held


def ascii_lower() -> np.ndarray:
    """Byte values with A-Z lowered."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between neighbouring ``bounds``."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]

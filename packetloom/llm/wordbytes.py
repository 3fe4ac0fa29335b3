"""Vectorised hashing of the words of UTF-8 text, for use inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_SHINGLE = [pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(64)]
PIECE_BYTES = 1 << 20
_tables: list[np.ndarray] = []


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _tables or len(_tables[0]) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        _tables[:] = []
        for base in (_BASE, _BASE_INVERSE):
            power = np.ones(1, np.uint64)
            while len(power) < size:
                power = np.concatenate([power, power * np.uint64(pow(base, len(power), 1 << 64))])
            _tables.append(power)
    return _tables[0], _tables[1]


def pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE_BYTES, cut only after a blank."""
    begin = 0
    while len(data) - begin > PIECE_BYTES:
        end = begin + PIECE_BYTES
        found = max(data.rfind(b" ", begin, end), data.rfind(b"\n", begin, end))
        if found < 0:  # one word longer than a piece: go on to its end
            ahead = [p for p in (data.find(b" ", end), data.find(b"\n", end)) if p >= 0]
            found = min(ahead) if ahead else len(data) - 1
        yield data[begin:found + 1]
        begin = found + 1
    yield data[begin:]


def blank_mask(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw - np.uint8(9)) < 5)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of non-blank bytes."""
    edge = np.diff(np.concatenate([[0], (~blank_mask(raw)).view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes, freed of its place, then mixed."""
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of all words of a text, in order."""
    found = []
    for piece in pieces(data):
        raw = np.frombuffer(piece, np.uint8)
        found.append(hash_words(raw, *word_spans(raw)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; a shorter text is one shingle."""
    if len(words) == 0:
        return words
    take = min(width, len(words))
    total = np.zeros(len(words) - take + 1, np.uint64)
    for k in range(take):
        total += words[k:len(words) - take + 1 + k] * np.uint64(_SHINGLE[k])
    return np.unique(mix(total))

"""Word shingles of whole texts as 64-bit hashes, computed over byte arrays.

A word is a run of bytes other than space and 0x09-0x0D; the letters A-Z count
as a-z. Multi-byte UTF-8 sequences hold no such byte, so working on bytes and
on code points gives the same words."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
PIECE = 1 << 18

_TABLES: dict = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base & (2**64 - 1)))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _tables() -> dict:
    """The byte values, the powers of the base and of its inverse; made on
    first use in each process, the same everywhere."""
    if not _TABLES:
        rng = np.random.default_rng(20240229)
        value = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) | U64(1)
        value[65:91] = value[97:123]
        is_word = np.ones(256, dtype=bool)
        is_word[[0x20, *range(0x09, 0x0E)]] = False
        value[~is_word] = 0
        base = int(rng.integers(1 << 40, 1 << 62)) | 1
        inverse = pow(base, -1, 1 << 64)
        _TABLES.update(value=value, is_word=is_word, base=base, inverse=inverse,
                       up=_powers(base, PIECE + 1), down=_powers(inverse, PIECE + 1))
    return _TABLES


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _piece_hashes(data: np.ndarray) -> np.ndarray:
    t = _tables()
    word = t["is_word"][data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=U64)
    n = len(data)
    up, down = (t["up"], t["down"]) if n <= PIECE else (_powers(t["base"], n + 1), _powers(t["inverse"], n + 1))
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(t["value"][data] * up[:n], starts) * down[starts]
    return mix(sums)


def word_hashes(text: bytes) -> np.ndarray:
    """One hash per word, in order. Long texts go piece by piece, cut between
    words, so memory stays at a few times the longest word or ``PIECE``."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= PIECE:
        return _piece_hashes(data)
    is_word = _tables()["is_word"]
    out, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and is_word[data[end]]:  # finish the word at the cut
            gap = np.flatnonzero(~is_word[data[end:end + PIECE]])
            end = end + int(gap[0]) if len(gap) else min(end + PIECE, len(data))
        out.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; of fewer words, the whole
    sequence as one; of none, nothing."""
    n = len(words)
    if not n:
        return words
    size = min(width, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - size + 1, U64(size))
        for k in range(size):
            acc = acc * U64(0x9E3779B97F4A7C15) + words[k:n - size + 1 + k]
    return mix(acc)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text (null: none)."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode("utf-8")), width))

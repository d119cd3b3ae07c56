"""Hashes of words and of word shingles, over many texts at once.

Words are `[^\\x20\\x09-\\x0D]+` of the UTF-8 bytes with A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and how many words each text has."""
    b = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    ink = ~_SPACE[b]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    first = np.cumsum([0, *(len(x) + 1 for x in texts)])
    per_text = np.diff(np.concatenate([[0], np.cumsum(start)])[first])
    c, begin = _BYTE[b[ink]], (np.cumsum(ink) - 1)[start]
    if not len(begin):
        return np.zeros(0, np.uint64), per_text
    size = np.diff(np.append(begin, len(c)))
    k = np.arange(len(c)) - np.repeat(begin, size)
    power = np.cumprod(np.full(int(size.max()), _A, np.uint64))
    return mixed(np.add.reduceat(c * power[k], begin) + size.astype(np.uint64)), per_text


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than a shingle has make one shingle, none make none."""
    h, per_text = word_hashes(texts)
    power = np.cumprod(np.full(words, _A, np.uint64))
    rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words):
        rolled += h[j : j + len(rolled)] * power[j]
    rolled = mixed(rolled)
    out, at = [], 0
    for n in per_text.tolist():
        if n >= words:
            out.append(np.unique(rolled[at : at + n - words + 1]))
        elif n:
            out.append(mixed((h[at : at + n] * power[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out

"""Texts of a batch as one array of code points, and hashed character n-grams by their start."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_LETTER: np.ndarray | None = None
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


class Points(NamedTuple):
    value: np.ndarray  # uint32: every text with a space before and PAD spaces after
    start: np.ndarray  # of each text, at the space before it
    end: np.ndarray  # after its last character


PAD = 4


def letter_table() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(texts: list[bytes | None], lower: bool) -> Points:
    data = [(t or b"").decode("utf-8", "replace") for t in texts]
    if lower:
        data = [t.lower() for t in data]
    value = np.frombuffer("".join(f" {t}{' ' * PAD}" for t in data).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) for t in data], np.int64)
    start = np.concatenate([[0], np.cumsum(size + 1 + PAD)])[:-1].astype(np.int64)
    return Points(value, start, start + 1 + size)


def char_grams(value: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n characters from each position on; the last n - 1 positions read on from the start."""
    h = value * _FACTORS[0] + np.uint32(n)
    for j in range(1, n):
        h = (h ^ (h >> np.uint32(15))) * _FACTORS[1] + np.roll(value, -j) * _FACTORS[j]
    h = (h ^ (h >> np.uint32(13))) * _FACTORS[2]
    return (h >> np.uint32(32 - bits)).astype(np.int32)

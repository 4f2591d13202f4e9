"""Presence of hashed n-grams of code points: the features of the text classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np

DIMS = 2**14


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def only_letters(points: np.ndarray) -> np.ndarray:
    """Letters, with one space for each run of anything else and at both ends."""
    letter = _letters()[points]
    if not letter.any():
        return points[:0]
    spaced = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([[32], spaced[keep], [32] if letter[-1] else []]).astype(np.uint32)


def presence(texts: Sequence[str], lengths: Sequence[int], letters: bool, dims: int = DIMS) -> np.ndarray:
    """A row per text: 1 where the text has an n-gram of that hash, for all ``lengths`` n.  Whole texts are read."""
    rows = np.zeros((len(texts), dims), np.uint8)
    shift = np.uint64(64 - (dims.bit_length() - 1))
    for row, text in zip(rows, texts, strict=True):
        points = only_letters(code_points(text.lower())) if letters else code_points(text)
        points = points.astype(np.uint64)
        rolled = np.zeros(len(points), np.uint64)
        for n in range(1, max(lengths) + 1):
            if len(points) < n:
                break
            rolled = rolled[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            if n in lengths:
                row[(rolled * np.uint64(0x9E3779B97F4A7C15)) >> shift] = 1
    return rows

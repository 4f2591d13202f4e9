"""Hashes of any stretch of a byte string from running sums, in vector operations."""

from __future__ import annotations

import numpy as np

from trailsift.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(table: np.ndarray, factor: int, size: int) -> np.ndarray:
    if len(table) >= size:
        return table
    steps = np.full(max(size, 2 * len(table)), factor % 2**64, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def running(values: np.ndarray) -> np.ndarray:
    """Running sums that ``stretches`` turns into hashes; sums wrap at 64 bits."""
    global _powers, _inverses
    _powers = _grown(_powers, _BASE, len(values) + 1)
    _inverses = _grown(_inverses, pow(_BASE, -1, 2**64), len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers[: len(values)], out=sums[1:])
    return sums


def stretches(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per stretch; equal stretches have equal hashes wherever they are."""
    return mix64((sums[ends] - sums[starts]) * _inverses[starts])

"""Hashes of runs of hashed units (words or lines), with numpy."""

from __future__ import annotations

import numpy as np

from larkspur.llm.common import mix

BASE = np.uint64(0x9E3779B97F4A7C15 | 3)


def window_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size units, by place; by doubling, so in about 2 log2(size) passes."""
    n = len(units) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, width, part = BASE, 1, units  # part: hashes of runs of width units
        out, done, shift = None, 0, None
        rest = size
        while rest:
            if rest & 1:
                if out is None:
                    out, done = part[: len(units) - width + 1], width
                else:  # what is done, then this run behind it
                    m = len(units) - done - width + 1
                    out = out[:m] * power + part[done : done + m]
                    done += width
            rest >>= 1
            if rest:
                m = len(units) - 2 * width + 1
                part = part[:m] * power + part[width : width + m] if m > 0 else part[:0]
                power, width = power * power, width * 2
        return mix(out[:n])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """For each run of width keys, the place of its least key (the first of equals)."""
    n = len(keys) - width + 1
    best, place = keys[:n].copy(), np.arange(n)
    for j in range(1, width):
        here = keys[j : j + n]
        less = here < best
        np.copyto(best, here, where=less)
        place[less] = np.flatnonzero(less) + j
    return place

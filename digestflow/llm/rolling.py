"""Rolling hashes over byte arrays, vectorised, for Python workers."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(0x5EED).integers(0, 2**64, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The 64-bit polynomial hash of each run of ``width`` bytes of data (uint8), by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    part, span, out, done = _TABLE[data], 1, None, 0
    while True:
        if width & span:
            if out is None:
                out, done = part, span
            else:
                # the runs of ``done`` bytes, each followed by one of ``span``
                n = len(data) - done - span + 1
                out = out[:n] * np.uint64(pow(_BASE, span, 1 << 64)) + part[done : done + n]
                done += span
        if done == width:
            return mixed(out)
        n = len(data) - 2 * span + 1
        part = part[:n] * np.uint64(pow(_BASE, span, 1 << 64)) + part[span : span + n]
        span *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` elements of x."""
    part, span = x, 1
    while 2 * span <= width:
        part = np.minimum(part[: len(part) - span], part[span:])
        span *= 2
    n = len(x) - width + 1
    return np.minimum(part[:n], part[width - span : width - span + n])

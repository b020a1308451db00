"""Content-chosen sample positions of a byte string."""

from __future__ import annotations

import numpy as np

from docquarry.llm.common import mix

GRAM = 16
WINDOW = 64
PIECE = 1 << 18
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes that start at every place."""
    out, width = _TABLE[data], 1
    while width < GRAM:
        out = mix_step(out[:-width], out[width:], width)
        width *= 2
    return out


def mix_step(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    x = left * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + right
    return x ^ (x >> np.uint64(29))


def _sliding(values: np.ndarray, best) -> np.ndarray:
    width = 1
    while width < WINDOW:
        values = best(values[:-width], values[width:])
        width *= 2
    return values


def anchors(data: np.ndarray) -> np.ndarray:
    """Places whose gram hash is the least of some run of ``WINDOW`` places, in order.

    Whether a place is chosen depends only on the ``WINDOW - 1`` places on either side, and every run
    of ``WINDOW`` places holds a chosen one. Ties are all chosen. Long strings go piece by piece.
    """
    found = []
    count = len(data) - GRAM + 1
    if count < WINDOW:
        return np.zeros(0, dtype=np.int64)
    for start in range(0, count, PIECE):
        low, high = max(0, start - WINDOW + 1), min(count, start + PIECE + WINDOW - 1)
        h = gram_hashes(data[low: high + GRAM - 1])
        least = _sliding(h, np.minimum)
        edge = np.zeros(WINDOW - 1, dtype=np.uint64)
        most = _sliding(np.concatenate([edge, least, edge]), np.maximum)
        chosen = np.flatnonzero(most == h) + low
        found.append(chosen[(chosen >= start) & (chosen < start + PIECE)])
    return np.concatenate(found)

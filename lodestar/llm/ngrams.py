"""Hashed character n-grams of many texts at once, in numpy."""

from __future__ import annotations

# Odd multipliers of the rolling combinations.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def code_points(texts: list[str], edge: int = 2):
    """Code points of all texts with `edge` zeros around each; where each text's share starts, and the total."""
    import numpy as np

    gap = "\0" * edge
    parts = [gap + t + gap for t in texts]
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *map(len, parts)])
    return points, starts[:-1], starts[-1]


def hashed(points, order: int, bits: int):
    """One hash below 2**bits for each window of `order` code points; as many as points, the last few run into zeros."""
    import numpy as np

    n = len(points)
    out = np.full(n, (order * MULTIPLIERS[3]) & 0xFFFFFFFF, "u4")
    for i in range(order):
        shifted = points if i == 0 else np.concatenate([points[i:], np.zeros(i, "u4")])
        out ^= shifted[:n] + np.uint32(0x7F4A7C15)
        out *= np.uint32(MULTIPLIERS[i % len(MULTIPLIERS)])
        out ^= out >> np.uint32(15)
    return out & np.uint32(2**bits - 1)

"""Sample and approximate entropy of one series, counted in blocks of rows: exact, in bounded memory."""

from __future__ import annotations

import numpy as np


def _near(v: np.ndarray, m: int, r: float, strict: bool) -> np.ndarray:
    """For each window of ``m`` values the number of windows within ``r`` of it, itself included; by blocks of rows."""
    e = np.lib.stride_tricks.sliding_window_view(v, m)
    out = np.zeros(len(e), dtype=np.int64)
    step = max(1, 2_000_000 // len(e))
    for lo in range(0, len(e), step):
        d = np.zeros((len(e[lo : lo + step]), len(e)))
        for k in range(m):
            np.maximum(d, np.abs(e[lo : lo + step, k, None] - e[None, :, k]), out=d)
        out[lo : lo + step] = ((d < r) if strict else (d <= r)).sum(axis=1)
    return out


def sample_entropy(v: np.ndarray, m: int = 2) -> float:
    r = 0.2 * v.std()
    if len(v) < m + 2 or r == 0:
        return 0.0
    pairs = lambda size: (int(_near(v, size, r, True).sum()) - (len(v) - size + 1)) // 2
    b, a = pairs(m), pairs(m + 1)
    return float(-np.log(a / b)) if a and b else 0.0


def approximate_entropy(v: np.ndarray, m: int = 2) -> float:
    r = 0.2 * v.std()
    if r == 0:
        return 0.0
    phi = lambda k: float(np.log(_near(v, k, r, False) / (len(v) - k + 1) + 1e-10).mean())
    return abs(phi(m) - phi(m + 1))

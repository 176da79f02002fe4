"""Systems of many filters at once."""

from __future__ import annotations

import numpy as np


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(solutions, which exist) of stacked systems: a singular one, that of a filter that has diverged, leaves the others be; its solution is NaN."""
    try:
        return np.linalg.solve(a, b), np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        good = np.linalg.slogdet(a)[0] != 0
        out = np.full(np.broadcast_shapes(b.shape, (len(a), 1, 1)), np.nan)
        out[good] = np.linalg.solve(a[good], b[good])
        return out, good

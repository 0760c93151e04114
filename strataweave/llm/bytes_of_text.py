"""Texts as arrays, for vectorised passes."""

from __future__ import annotations

import numpy as np

# The code points that Unicode calls white space.
WHITE_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def is_space(cp: np.ndarray) -> np.ndarray:
    low = np.zeros(256, bool)
    low[WHITE_SPACE[WHITE_SPACE < 256]] = True
    hit = low[np.minimum(cp, 255)]
    wide = np.flatnonzero(cp >= 255)
    hit[wide] = np.isin(cp[wide], WHITE_SPACE)
    return hit

"""Whole-array steps shared by operators that run inside ``mapInArrow``."""

from __future__ import annotations

import numpy as np


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): the owners 0 0 2 2 2 and the places 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - np.repeat(first, counts)


def first_of_groups(group: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Indices of each group's first k rows by the given keys, most important key first."""
    rows = np.lexsort((*order[::-1], group))
    g = group[rows]
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.empty(0, dtype=np.int64)
    place = np.arange(len(g)) - np.repeat(head, np.diff(np.concatenate((head, [len(g)]))))
    return rows[place < k]

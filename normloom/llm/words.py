"""Words of many texts at once, as arrays of 64-bit hashes.

A word is a maximal run of letters or digits of the lower-cased text; an
underscore is neither.  The texts of an Arrow batch are laid end to end as code
points and cut, hashed and windowed by whole-array numpy steps, so that no
Python object is made per word or n-gram.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np

from normloom.functions.arrays import spread as spread

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@cache
def word_chars() -> np.ndarray:
    """For each code point whether it is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


_KEYS = mix(np.arange(1, 4097, dtype=np.uint64) * _STEP) | np.uint64(1)


def _position_keys(n: int) -> np.ndarray:
    """Random odd multipliers of the positions 0 .. n-1 in a word."""
    global _KEYS
    if n > len(_KEYS):
        _KEYS = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    return _KEYS


class Words(NamedTuple):
    """hashes: of all words, text after text; offsets: n+1 bounds of the texts' words."""

    hashes: np.ndarray
    offsets: np.ndarray


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def flat_words(texts: Iterable[str | None], slice_chars: int = 500_000) -> Words:
    """The words of the texts; null counts as an empty text.

    Works through slices of about ``slice_chars`` characters, which stay in the
    processor's cache; the result does not depend on them.
    """
    parts, part, size = [], [], 0
    for t in texts:
        part.append(t.lower() if t else "")
        size += len(part[-1]) + 1
        if size > slice_chars:
            parts.append(_flat(part))
            part, size = [], 0
    parts.append(_flat(part))
    shifts = np.cumsum([0] + [len(p.hashes) for p in parts])
    return Words(
        np.concatenate([p.hashes for p in parts]),
        np.concatenate([[0]] + [p.offsets[1:] + s for p, s in zip(parts, shifts)]).astype(np.int64),
    )


def _flat(low: list[str]) -> Words:
    ends = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, dtype=np.int64)
    codes = code_points("\n".join(low) + "\n") if low else np.zeros(0, dtype=np.uint32)
    inside = word_chars()[codes]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, stops = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.searchsorted(starts, ends))).astype(np.int64)
    if not len(starts):
        return Words(np.empty(0, dtype=np.uint64), offsets)
    lengths = stops - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (codes[inside].astype(np.uint64) + _STEP) * _position_keys(int(lengths.max()))[at]
    return Words(mix(np.add.reduceat(values, first)), offsets)


def window_hashes(words: Words, positions: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows within single texts, looking at ``positions`` only.

    Returns the hashes, the number of the text of each window and the index of
    its first word in ``words.hashes``.
    """
    hashes, offsets = words
    span = max(positions) + 1
    n = len(hashes) - span + 1
    if n <= 0:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), none, none
    keys = _position_keys(span)
    total = np.zeros(n, dtype=np.uint64)
    for p in positions:
        total += hashes[p : p + n] * keys[p]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    start = np.arange(n, dtype=np.int64)
    inside = start + span <= offsets[owner + 1]
    return mix(total[inside]), owner[inside], start[inside]

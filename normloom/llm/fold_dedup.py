"""Copies hidden by formatting: equal after folding case and skipping non-alphanumerics.

Two fields make a record; they may also be exchanged.  A lookup table over all
code points gives each character its folded form or says to skip it.  A field's
code points are looked up, window by window, and go straight into two rolling
polynomial hashes (mod two primes); no canonical string is made, kept or shuffled.  The record's key is
the unordered pair of its fields' hashes and lengths.

Rows are grouped by key through partial aggregation (a count and the smallest id;
a group of a third of all rows costs one row a task).  Then each row is compared
with its group's keeper by two pointers that skip in both texts; only rows that
share a key with others are sent for that.  Rows whose key agrees by accident are
grouped once more by the SHA-256 of their canonical text, so the result is exact.

Null counts as "": rows with both fields empty after folding are copies of one
another.  Rows with a null id are left out; repeated ids count as one row.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.tables import cut

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 69_069_069)
KEYS = ["k1", "k2", "k3", "k4", "size"]
#: Code points that are folded at once.
WINDOW = 1 << 18
#: Rows of two identifiers that may be broadcast (some 100 MB at most).
BROADCAST_ROWS = 4_000_000


@cache
def fold_table() -> np.ndarray:
    """Per code point: 0 to skip it, else the code point of its lower-case form."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        kept = [x for x in chr(c).lower() if x.isalnum()]
        if kept:
            table[c] = ord(kept[0])
    table[ord("ς")] = table[ord("Σ")]  # the final form is a matter of place, not of text
    return table


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(k: int, n: int) -> np.ndarray:
    """Powers of the base modulo the prime, grown by doubling."""
    p, base = np.uint64(PRIMES[k]), BASES[k]
    while len(_POWERS[k]) < n:
        step = np.uint64(pow(base, len(_POWERS[k]), PRIMES[k]))
        _POWERS[k] = np.concatenate((_POWERS[k], _POWERS[k] * step % p))
    return _POWERS[k]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts laid end to end, and where each ends."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, dtype=np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), ends


def field_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two hashes and the folded length of each text.

    The code points stream through the table in windows of ``WINDOW``; what is carried
    from one to the next is the open text's hashes and its number of kept characters.
    """
    codes, ends = _codes([t or "" for t in texts])
    n = len(texts)
    size = np.zeros(n, dtype=np.int64)
    totals = np.zeros((2, n), dtype=np.uint64)
    for lo in range(0, len(codes), WINDOW):
        hi = min(len(codes), lo + WINDOW)
        folded = fold_table()[codes[lo:hi]]
        kept = np.cumsum(folded != 0)  # a skipped character has value 0 and moves no place
        first, last = (int(np.searchsorted(ends, x, side="right")) for x in (lo, hi - 1))
        bounds = np.concatenate(([0], ends[first:last] - lo))  # where the window's texts begin
        before = np.concatenate(([0], kept))[bounds]
        owner = np.repeat(np.arange(first, last + 1), np.diff(np.concatenate((bounds, [hi - lo]))))
        place = np.maximum(kept - 1 - before[owner - first] + size[owner], 0)
        filled = np.flatnonzero(np.diff(np.concatenate((bounds, [hi - lo]))))
        for k in range(2):
            terms = folded.astype(np.uint64) * _powers(k, int(place.max(initial=0)) + 1)[place] % np.uint64(PRIMES[k])
            rows = first + filled
            totals[k, rows] = (totals[k, rows] + np.add.reduceat(terms, bounds[filled])) % np.uint64(PRIMES[k])
        size[first : last + 1] += np.diff(np.concatenate((before, [kept[-1]])))
    return totals[0].astype(np.int64), totals[1].astype(np.int64), size


def _key_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k1..k4, size): the hashes of the fields as an unordered pair."""
    for b in batches:
        a1, a2, n = field_hashes(b.column(1).to_pylist())
        b1, b2, m = field_hashes(b.column(2).to_pylist())
        first = (a1 << np.int64(31)) ^ a2
        second = (b1 << np.int64(31)) ^ b2
        swap = (first > second) | ((first == second) & (n > m))
        low, high = np.where(swap, second, first), np.where(swap, first, second)
        low_n, high_n = np.where(swap, m, n), np.where(swap, n, m)
        yield pa.record_batch([b.column(0), pa.array(low), pa.array(high), pa.array(low_n), pa.array(high_n), pa.array(n + m)], names=["id", *KEYS])


def same_folded(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of texts whether they are equal after folding.

    Two pointers, each skipping: for all pairs at once, as the places where either
    text is not skipped; the characters there are compared one by one.
    """
    table = fold_table()
    found = []
    for texts in (left, right):
        codes, ends = _codes(texts)
        at = np.flatnonzero(table[codes])
        found.append((codes, at, np.searchsorted(at, ends)))
    (a, i, m), (b, j, n) = found
    sizes, others = np.diff(m, prepend=0), np.diff(n, prepend=0)
    same = sizes == others
    if not same.all():
        i, j = i[np.repeat(same, sizes)], j[np.repeat(same, others)]
    equal = table[a[i]] == table[b[j]]
    wrong = np.bincount(np.repeat(np.flatnonzero(same), sizes[same]), weights=~equal, minlength=len(left))
    return same & (wrong == 0)


def _digest(fields: tuple[str, str]) -> str:
    table = fold_table()
    parts = sorted("".join(chr(table[ord(c)]) for c in t if table[ord(c)]) for t in fields)
    return hashlib.sha256("\x00".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def _compare_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, keep_id, other): other is null for true copies, else the row's own digest."""
    for b in batches:
        a, s, ka, ks = ([x or "" for x in b.column(k).to_pylist()] for k in range(2, 6))
        copies = same_folded(a, ka) & same_folded(s, ks)
        rest = np.flatnonzero(~copies)
        take = lambda texts: [texts[i] for i in rest]
        copies[rest] = same_folded(take(a), take(ks)) & same_folded(take(s), take(ka))
        other = [None if c else _digest(pair) for c, pair in zip(copies, zip(a, s))]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(other, pa.string())], names=["id", "keep_id", "other"])


class Copies(NamedTuple):
    """members(id, keep_id): every row, keepers included; groups(id, keep_id): those rows
    that have copies; records(keep_id, copies)."""

    members: DataFrame
    groups: DataFrame
    records: DataFrame


def folded_copies(df: DataFrame, id_col: str, first_col: str, second_col: str) -> Copies:
    """The rows' groups.  Each row is hashed once; texts are read again, and travel, only
    for rows that share a key with another id."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(first_col).alias("a"), F.col(second_col).alias("b")).where("id is not null")
    keyed = cut(rows.mapInArrow(_key_step, "id bigint, k1 bigint, k2 bigint, k3 bigint, k4 bigint, size bigint"))
    several = keyed.groupBy(*KEYS).agg(F.min("id").alias("keep_id"), F.max("id").alias("last")).where("keep_id <> last").drop("last")
    shared = cut(keyed.join(several, KEYS).select("id", "keep_id").distinct())
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = rows.join(F.broadcast(shared) if few else shared, "id")
    # the keepers' side of a large group is one row, which adaptive execution sends to
    # each split of the members' side
    keepers = texts.where("id = keep_id").groupBy("keep_id").agg(F.first("a").alias("ka"), F.first("b").alias("kb"))
    compared = cut(texts.join(keepers, "keep_id").select("id", "keep_id", "a", "b", "ka", "kb").mapInArrow(_compare_step, "id bigint, keep_id bigint, other string"))
    # rows whose key agrees with the keeper's by accident meet those of the same canonical text
    odd = compared.where("other is not null")
    own = odd.join(odd.groupBy("other").agg(F.min("id").alias("least")), "other").select("id", F.col("least").alias("keep_id"))
    groups = compared.where("other is null").select("id", "keep_id").unionByName(own).distinct()
    single = keyed.select("id").distinct().join(shared.select("id"), "id", "left_anti").select("id", F.col("id").alias("keep_id"))
    members = single.unionByName(groups)
    return Copies(members, groups, members.groupBy("keep_id").agg(F.count("*").alias("copies")))

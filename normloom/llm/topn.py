"""The N highest-scoring items of every group, by simultaneous bisection.

Score and identifier are put into one order-preserving code (128 bits: the
score's bits made monotone, then the identifier reversed, so that ties go to the
smaller identifier).  For all groups of a block at once the interval of the
cut-off is halved: rows above each group's midpoint are counted, and the half
that holds the N-th row is kept, until each group's cut-off leaves exactly N
rows.  Groups that are done drop out with their rows.  No row is ever put in its
place by score; a block is sorted by group and item only, to number its groups and to
join an item's rows.

The rows are thinned by the same bisection where they lie, before any shuffle: a
row outside its block's first N is outside the group's first N.  What is shuffled
is at most N rows a group and block, so a group with a third of all rows sends
no more than any other.  Before the shuffle a task holds ``block_rows`` rows and a
block's survivors; after it the first N rows of its partition's groups so far and as many
again, never a group's other rows.

An item's score in a group is its highest there.  Rows with a null group, item or
score and with a NaN score are left out; infinities count.  Groups with fewer
than N items come out whole, empty input gives no rows, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000


def score_code(scores: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0.0 counts as 0.0."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def item_code(items: np.ndarray) -> np.ndarray:
    """Signed identifiers as unsigned integers of the reverse order."""
    return ~(items.view(np.uint64) ^ np.uint64(1 << 63))


def _bisect(group: np.ndarray, code: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per group the largest cut-off with at least ``want`` codes at or above it, and
    whether exactly that many are.  Groups must hold more than ``want`` rows."""
    n = len(want)
    low, high = np.full(n, np.iinfo(np.uint64).max), np.zeros(n, dtype=np.uint64)
    np.minimum.at(low, group, code)
    np.maximum.at(high, group, code)
    exact = np.zeros(n, dtype=bool)
    while len(group):
        middle = low + (high - low) // np.uint64(2) + ((high - low) & np.uint64(1))
        above = np.bincount(group[code >= middle[group]], minlength=n)
        moving = ~exact & (low < high)
        hit = moving & (above == want)
        exact |= hit
        low = np.where(moving & (above >= want), middle, low)
        high = np.where(moving & (above < want), middle - np.uint64(1), high)
        stay = (~exact & (low < high))[group]
        # rows above the interval stay for the count, those below it are out of play
        stay &= code >= low[group]
        if not stay.all():
            group, code = group[stay], code[stay]
    return low, exact


def top_of_block(group: np.ndarray, item: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Indices of each group's first ``n`` distinct items among the rows of a block."""
    order = np.lexsort((item, group))
    same = (group[order][1:] == group[order][:-1]) & (item[order][1:] == item[order][:-1])
    head = np.flatnonzero(np.concatenate(([True], ~same)))
    codes = score_code(score)
    if len(head) < len(order):  # an item's highest score in its group
        best = np.maximum.reduceat(codes[order], head)
        owner = np.cumsum(np.concatenate(([True], ~same))) - 1
        winner = np.flatnonzero(codes[order] == best[owner])
        first = np.concatenate(([True], owner[winner][1:] != owner[winner][:-1]))
        rows = order[winner[first]]
    else:
        rows = order
    numbers = np.cumsum(np.concatenate(([True], group[rows][1:] != group[rows][:-1]))) - 1
    size = np.bincount(numbers)
    keep = size[numbers] <= n
    big = np.flatnonzero(~keep)
    if len(big):
        which = np.cumsum(np.concatenate(([True], numbers[big][1:] != numbers[big][:-1]))) - 1
        code = codes[rows[big]]
        want = np.full(which[-1] + 1, n, dtype=np.int64)
        cut, exact = _bisect(which, code, want)
        above = code > cut[which]
        at = code == cut[which]
        # where the cut-off score is shared by too many, the identifiers are bisected
        taken = np.bincount(which[above], minlength=len(want))
        tied = np.bincount(which[at], minlength=len(want))
        open_groups = taken + tied > want
        chosen = above | (at & ~open_groups[which])
        ties = np.flatnonzero(at & open_groups[which])
        if len(ties):
            number = np.cumsum(np.concatenate(([True], which[ties][1:] != which[ties][:-1]))) - 1
            left = (want - taken)[open_groups]
            ids = item_code(item[rows[big[ties]]])
            limit, _ = _bisect(number, ids, left)
            chosen[ties[ids >= limit[number]]] = True
        keep[big[chosen]] = True
    return rows[keep]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _thin_step(n: int, block_rows: int, hand_on: bool):
    """Each group's first n rows, block after block thinned into the next.

    A block of groups that are all small can't shrink: with ``hand_on`` it goes on as it
    is, as a later step thins again; else blocks grow with what must be held.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, limit = 0, block_rows

        def thin() -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            keep = top_of_block(*(_numbers(block[k].chunk(0)) for k in range(3)), n)
            return block.take(pa.array(np.sort(keep))).combine_chunks().to_batches()[0]

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= limit:
                held = [thin()]
                rows = held[0].num_rows
                if not hand_on:
                    limit = max(block_rows, 2 * rows)
                elif 2 * rows > block_rows:
                    yield held[0]
                    held, rows = [], 0
        if held:
            yield thin()

    return step


def top_n(df: DataFrame, group_col: str, item_col: str, score_col: str, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, item, score) under the names given: each group's first ``n`` items.

    Order: score descending, item ascending.  Group and item must be integers.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(
        F.col(group_col).cast("bigint").alias("g"), F.col(item_col).cast("bigint").alias("i"), F.col(score_col).cast("double").alias("s")
    ).where("g is not null and i is not null and s is not null and not isnan(s)")
    schema = "g bigint, i bigint, s double"
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    thinned = rows.mapInArrow(_thin_step(n, block_rows, True), schema)
    found = thinned.repartition(partitions, "g").mapInArrow(_thin_step(n, block_rows, False), schema)
    return found.toDF(group_col, item_col, score_col)

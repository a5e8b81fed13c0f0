"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is counted in blocks of equal tokens.  Blocks go to sources by the highest
quotients share / (2 q + 1), none beyond ``max_repeats`` times its size; each
source's quota is apportioned in the same way to the shards its documents are
hashed to.  Within a shard documents stand in a seeded order, which is cut into
blocks; a quota is so many full passes and the first blocks of one more.  A document
belongs to the block in which its middle lies.  A source that reaches its cap stays
below its target; its missing blocks are not given to others unless ``redistribute``.

Whether a source stays below is read off the seats of an apportionment in blocks of
one token: its cap against its seats.  Seats are whole and may lie some tokens off
share times size (at most half the number of sources, and one); only within that
distance the sizes themselves are compared.

Sizes come from one aggregation per source, then one per source and shard, with
partial sums.  A source has as many shards as its size asks for (``SHARD_TOKENS``
each, more where there would be over ``MAX_PARTS``), so no window holds more than
that, and what reaches the driver is bounded; never a document.

Null texts have no tokens; rows with a null source, or one without a target, count
in the size of all documents only.  Null shares count as 0, null caps as 1; a
source listed twice has its shares added and the larger cap.  Rows with a null id
are sized but not selected.  Repeated rows are sized and selected each; extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions.text import WS

#: Bound of the sources with targets, and of all their shards: rows of sizes on the driver.
MAX_PARTS = 1_000_000
#: Tokens that a shard should hold; a row of it in a window has some twenty bytes.
SHARD_TOKENS = 50_000_000
#: Rows of quotas that may be broadcast.
BROADCAST_PARTS = 100_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def apportion(shares: Sequence[float], blocks: int, caps: Sequence[int] | None = None) -> list[int]:
    """Sainte-Lague seats for ``blocks``, none above its cap; ties go to the earlier.

    Rounding s/d at a common divisor leaves every seat above N s - (k + 1) / 2, so
    counting starts there and a heap hands out the rest, whatever ``blocks`` is.
    """
    total = float(sum(shares))
    k = len(shares)
    caps = [blocks] * k if caps is None else list(caps)
    if total <= 0 or blocks <= 0:
        return [0] * k
    seats = [min(caps[i], max(0, int(blocks * s / total) - (k + 3) // 2)) if s > 0 else 0 for i, s in enumerate(shares)]
    heap = [(-s / (2 * seats[i] + 1), i) for i, s in enumerate(shares) if s > 0 and seats[i] < caps[i]]
    heapq.heapify(heap)
    left = blocks - sum(seats)
    while left > 0 and heap:
        _, i = heapq.heappop(heap)
        seats[i] += 1
        left -= 1
        if seats[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * seats[i] + 1), i))
    return seats


def whitespace_pieces(text: Column) -> Column:
    """Number of pieces of text between white space of any kind."""
    return F.coalesce(F.regexp_count(text, F.lit(WS.replace("[", "[^", 1) + "+")), F.lit(0)).cast("bigint")


def _count_step(tokenizer: str):
    """Tokens by a file that the driver reads; its text goes to the tasks with the step."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = f.read()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition)
        t.encode_special_tokens = True
        encode = getattr(t, "encode_batch_fast", t.encode_batch)  # without offsets, where there is it
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes: list[int] = []
            for i in range(0, len(texts), 256):
                sizes += map(len, encode([x or "" for x in texts[i : i + 256]], add_special_tokens=False))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "tokens"])

    return step


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str, tokenizer: str | None = None) -> DataFrame:
    """(id, source, tokens) of every row; tokens of a tokenizer file, else white-space pieces."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    if tokenizer:
        return rows.mapInArrow(_count_step(tokenizer), "id bigint, source string, tokens bigint")
    return rows.select("id", "source", whitespace_pieces(F.col("text")).alias("tokens"))


class Quota(NamedTuple):
    source: str
    target_share: float
    max_repeats: int
    size: int
    quota_blocks: int
    below: bool


class Plan(NamedTuple):
    total: int
    block: int
    quotas: list[Quota]


def _wanted(targets: DataFrame) -> list:
    """(source, share, cap) of each source with a target, by name."""
    rows = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.sum(F.coalesce("target_share", F.lit(0.0)).cast("double")).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1)).cast("bigint")).alias("cap"))
        .limit(MAX_PARTS + 1)
        .collect()
    )
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} sources with targets")
    return sorted(rows, key=lambda r: r.source)


def _few(spark, rows: list, schema: str) -> DataFrame:
    """A table made on the driver, broadcast where it is small."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_PARTS else df


def below_target(shares: Sequence[float], capacities: Sequence[int], total: int) -> list[bool]:
    """Whether each capacity is under its share of the total, by seats of one token each."""
    seats = apportion(shares, round(total * sum(shares)))
    margin = len(shares) // 2 + 2
    return [c < q - margin or (c < q + margin and c < s * total) for s, c, q in zip(shares, capacities, seats)]


def plan_mix(sizes: DataFrame, targets: DataFrame, blocks: int = 100_000, redistribute: bool = False) -> Plan:
    """Quotas of the sources.  ``sizes`` is what ``sized`` returns; a block is a ``blocks``-th
    part of all documents' tokens, at least one token."""
    wanted = _wanted(targets)
    names = _few(sizes.sparkSession, [(r.source,) for r in wanted], "target string")
    # summed by source first: sources without a target are many, and the join is on sums
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(names, F.col("source") == F.col("target"), "left")
    parts = by_source.groupBy("target").agg(F.sum("tokens").alias("tokens")).collect()
    total = sum(r.tokens or 0 for r in parts)
    size = {r.source: 0 for r in wanted} | {r.target: r.tokens or 0 for r in parts if r.target is not None}
    shares = [max(0.0, r.share) for r in wanted]
    capacities = [max(0, r.cap) * size[r.source] for r in wanted]
    block = max(1, total // blocks)
    free = apportion(shares, round(total // block * min(1.0, sum(shares))))
    caps = [c // block for c in capacities]
    given = apportion(shares, sum(free), caps) if redistribute else [min(f, c) for f, c in zip(free, caps)]
    below = below_target(shares, capacities, total)
    return Plan(total, block, [Quota(r.source, r.share, r.cap, size[r.source], q, b) for r, q, b in zip(wanted, given, below)])


def select_mix(sizes: DataFrame, plan: Plan, seed: int = 7, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, source, tokens, repeats) of the documents in the mix."""
    if shard_tokens < 1:
        raise ValueError("shard_tokens must be at least 1")
    spark = sizes.sparkSession
    each = max(shard_tokens, 2 * sum(q.size for q in plan.quotas) // MAX_PARTS)
    counts = [(q.source, max(1, -(-q.size // each))) for q in plan.quotas if q.quota_blocks]
    shard = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit("shard")), F.col("shards")).cast("bigint")
    rows = sizes.where("id is not null and source is not null").join(_few(spark, counts, "source string, shards bigint"), "source").withColumn("shard", shard)
    by_source: dict[str, list[tuple[int, int]]] = {}
    for r in rows.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect():
        by_source.setdefault(r.source, []).append((r.shard, r.tokens))
    takes = []
    for q in plan.quotas:
        own, cap = sorted(by_source.get(q.source, [])), max(0, q.max_repeats)
        seats = apportion([t for _, t in own], q.quota_blocks, [cap * t // plan.block + 1 for _, t in own])
        takes += [(q.source, s, t, min(k * plan.block, cap * t)) for (s, t), k in zip(own, seats) if k]
    w = Window.partitionBy("source", "shard").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(_few(spark, takes, "source string, shard bigint, shard_tokens bigint, take bigint"), ["source", "shard"]).withColumn("place", F.xxhash64(F.lit(seed), F.col("id")))
    before = F.coalesce(F.sum("tokens").over(w), F.lit(0))
    full = F.expr("cast(take div greatest(shard_tokens, 1) as int)")
    rest = F.expr("take - (take div greatest(shard_tokens, 1)) * shard_tokens")
    more = (2 * before + F.col("tokens") < 2 * rest).cast("int")
    return placed.withColumn("repeats", (full + more).cast("int")).where("repeats > 0").select("id", "source", "tokens", "repeats")


def mix_report(sizes: DataFrame, plan: Plan, selected: DataFrame) -> DataFrame:
    """One row per source with a target: its size, tokens in the mix, shares, and whether it stays below."""
    spark = sizes.sparkSession
    rows = [(q.source, q.target_share, q.max_repeats, q.size, q.below) for q in plan.quotas]
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats bigint, size_tokens bigint, below_target boolean")
    taken = selected.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    joined = base.join(taken, "source", "left").na.fill(0, ["mix_tokens", "most_repeats"])
    everything = F.sum("mix_tokens").over(Window.partitionBy())
    return joined.withColumn("actual_share", F.round(F.col("mix_tokens") / F.when(everything > 0, everything), 6))


def mix(
    df: DataFrame, id_col: str, source_col: str, text_col: str, targets: DataFrame, tokenizer: str | None = None, seed: int = 7, shard_tokens: int = SHARD_TOKENS, prepare: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[Plan, DataFrame, DataFrame]:
    """(plan, selected, report).  ``prepare`` may cut the lineage of the sized rows, which
    are needed several times."""
    sizes = sized(df, id_col, source_col, text_col, tokenizer)
    sizes = prepare(sizes) if prepare else sizes
    plan = plan_mix(sizes, targets)
    selected = select_mix(sizes, plan, seed, shard_tokens)
    return plan, selected, mix_report(sizes, plan, selected)

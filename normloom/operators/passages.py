"""Which documents hold a passage verbatim: one automaton of all passages, one pass of the documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

try:
    import ahocorasick
except ImportError:  # then every passage is looked for on its own
    ahocorasick = None

#: Characters of passages that one broadcast may hold; more go in passes.
BROADCAST_CHARS = 20_000_000


def _finder(passages: dict[str, list[int]]) -> Callable[[str], set[int]]:
    """A function that gives the ids of the passages in a text."""
    if ahocorasick is None:
        return lambda text: {i for p, ids in passages.items() if p in text for i in ids}
    machine = ahocorasick.Automaton()
    for p, ids in passages.items():
        machine.add_word(p, ids)
    machine.make_automaton()
    return lambda text: {i for _, ids in machine.iter(text) for i in ids}


def passages_in(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, passage: str) -> DataFrame:
    """(item, doc) of every document whose text contains the item's passage, each pair once
    a row.  Null and empty passages and null texts are in nothing.

    The passages are the stated side: their automaton goes to every task, in passes of at
    most ``BROADCAST_CHARS``, and documents are neither joined nor shuffled.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item).cast("bigint").alias("item"), F.col(passage).alias("p")).where("item is not null and p <> ''")
    size = asked.agg(F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-size // BROADCAST_CHARS))
    rows = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where("text is not null")
    found = spark.createDataFrame([], "item bigint, doc bigint")
    for n in range(passes):
        part = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("p"), F.lit(passes)) == n)
        held: dict[str, list[int]] = {}
        for r in part.collect():
            held.setdefault(r.p, []).append(r["item"])
        if held:
            found = found.unionByName(rows.mapInArrow(_step(spark.sparkContext.broadcast(held)), "item bigint, doc bigint"))
    return found


def _step(held):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(held.value)
        for b in batches:
            hits = [(i, d) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i in sorted(find(t))]
            items, docs = zip(*hits) if hits else ((), ())
            yield pa.record_batch([pa.array(items, pa.int64()), pa.array(docs, pa.int64())], names=["item", "doc"])

    return step

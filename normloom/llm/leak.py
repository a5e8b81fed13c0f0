"""Evaluation texts inside a corpus: spaced-seed hashing with verified overlaps.

A mask such as ``110110110111`` looks at some of twelve consecutive words and
ignores the others.  All masked windows of the test items are hashed; those of
the documents are looked up among them; a hit fixes a document, an item and a
shift between the two.  Along that shift the words are compared one by one,
which gives the longest exact run and the longest stretch with at most
``substitutions`` differing words.

Every exact run of at least the mask's span is found, whatever the mask; longer
masks' gaps also find runs with substituted words.

The item side is small as a rule: where its texts stay under ``broadcast_chars``
(measured, not assumed) its hashes go to every task and documents are never
shuffled.  Beyond that hashes of both sides are joined by a shuffle, documents
being thinned first by a bitmap of fixed size.

Null texts count as empty and have no hits; items or documents shorter than the
span have none.  Rows with a null id are left out; repeated ids give one row.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.llm.words import Words, flat_words, spread, window_hashes

#: Twelve words each; every third, every fourth or a middle word may differ.
MASKS = ("110110110111", "111011101110", "111110011111")
BITMAP_BITS = 24
RESULT = "doc_id bigint, item_id bigint, run int, overlap int, item_words int"


def _positions(masks: tuple[str, ...]) -> list[tuple[int, ...]]:
    out = [tuple(i for i, c in enumerate(m) if c == "1") for m in masks]
    if not out or any(not p or p[0] for p in out):
        raise ValueError("a mask is a string of 0 and 1 that begins with 1")
    return out


def _seeds(words: Words, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word of all masked windows; masks don't mix."""
    parts = []
    for k, p in enumerate(_positions(masks)):
        h, owner, start = window_hashes(words, p)
        parts.append((h + np.uint64(k), owner, start))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _compare(docs: Words, items: Words, doc: np.ndarray, item: np.ndarray, shift: np.ndarray, substitutions: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest exact run and longest stretch with few substitutions, per (doc, item, shift).

    ``shift`` is the index in docs.hashes of the word that meets the item's first.
    """
    low = np.maximum(docs.offsets[doc], shift)
    high = np.minimum(docs.offsets[doc + 1], shift + items.offsets[item + 1] - items.offsets[item])
    length = np.maximum(high - low, 0)
    owner, step = spread(length)
    at = low[owner] + step
    same = docs.hashes[at] == items.hashes[at - shift[owner] + items.offsets[item][owner]]
    first = np.cumsum(length) - length
    index = np.arange(len(same))
    n = len(doc)
    run, stretch = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if len(same):
        # the last break before each place: a differing word or the segment's start
        broken = np.maximum.accumulate(np.where(same, first[owner] - 1, index))
        np.maximum.at(run, owner, index - np.maximum(broken, first[owner] - 1))
        differs = np.flatnonzero(~same)
        count = np.cumsum(~same)
        before = count[first[owner]] - (~same)[first[owner]]
        kth = count - 1 - substitutions
        start = np.where((count - before > substitutions) & (kth >= 0), differs[np.maximum(kth, 0)] + 1 if len(differs) else 0, first[owner])
        np.maximum.at(stretch, owner, index - start + 1)
    return run, stretch


def _best(doc: np.ndarray, item: np.ndarray, run: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per (doc, item): the best of its shifts."""
    order = np.lexsort((item, doc))
    doc, item, run, stretch = (x[order] for x in (doc, item, run, stretch))
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))) if len(doc) else np.empty(0, dtype=np.int64)
    if not len(head):
        return doc, item, run, stretch
    return doc[head], item[head], np.maximum.reduceat(run, head), np.maximum.reduceat(stretch, head)


def _unique_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    if not len(order):
        return columns
    new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return tuple(c[new] for c in columns)


def _lookup_step(items, masks: tuple[str, ...], substitutions: int):
    """Hits of document batches among the broadcast items, verified on the spot."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, words = items.value
        seeds, owner, start = _seeds(words, masks)
        order = np.argsort(seeds, kind="stable")
        seeds, owner, start = seeds[order], owner[order], start[order]
        bitmap = np.zeros(1 << 20, dtype=bool)
        bitmap[(seeds & np.uint64(len(bitmap) - 1)).astype(np.int64)] = True
        lengths = np.diff(words.offsets)
        for b in batches:
            docs = flat_words(b.column(1).to_pylist())
            h, d, at = _seeds(docs, masks)
            maybe = np.flatnonzero(bitmap[(h & np.uint64(len(bitmap) - 1)).astype(np.int64)])
            h, d, at = h[maybe], d[maybe], at[maybe]
            low = np.searchsorted(seeds, h, side="left")
            times = np.searchsorted(seeds, h, side="right") - low
            which, step_on = spread(times)
            seed = low[which] + step_on
            shift = at[which] - (start[seed] - words.offsets[owner[seed]])
            doc, item, shift = _unique_rows(d[which], owner[seed], shift)
            run, stretch = _compare(docs, words, doc, item, shift, substitutions)
            doc, item, run, stretch = _best(doc, item, run, stretch)
            yield pa.record_batch(
                [b.column(0).take(pa.array(doc)), pa.array(item_ids[item]), pa.array(run.astype(np.int32)), pa.array(stretch.astype(np.int32)), pa.array(lengths[item].astype(np.int32))],
                names=["doc_id", "item_id", "run", "overlap", "item_words"],
            )

    return step


def _seed_step(masks: tuple[str, ...], bitmap=None):
    """(seed, id) of every text's windows, thinned by a bitmap of the other side."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, dtype=np.uint8) if bitmap else None
        for b in batches:
            h, owner, _ = _seeds(flat_words(b.column(1).to_pylist()), masks)
            if bits is not None:
                at = (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                keep = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                h, owner = h[keep], owner[keep]
            h, owner = _unique_rows(h, owner)
            yield pa.record_batch([pa.array(h.view(np.int64)), b.column(0).take(pa.array(owner))], names=["seed", "id"])

    return step


def _bitmap_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
    for b in batches:
        seeds = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        bits[(seeds & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    yield pa.record_batch([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])


def _verify_step(masks: tuple[str, ...], substitutions: int):
    """Candidate rows (doc_id, item_id, doc text, item text) compared on all seed shifts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, items = flat_words(b.column(2).to_pylist()), flat_words(b.column(3).to_pylist())
            h, d, at = _seeds(docs, masks)
            s, owner, start = _seeds(items, masks)
            left = pa.table({"row": d, "seed": h.view(np.int64), "at": at})
            right = pa.table({"row": owner, "seed": s.view(np.int64), "start": start - items.offsets[owner]})
            both = left.join(right, ["row", "seed"], join_type="inner")
            row, shift = _unique_rows(both["row"].to_numpy(), both["at"].to_numpy() - both["start"].to_numpy())
            run, stretch = _compare(docs, items, row, row, shift, substitutions)
            row, _, run, stretch = _best(row, row, run, stretch)
            take = pa.array(row)
            yield pa.record_batch(
                [b.column(0).take(take), b.column(1).take(take), pa.array(run.astype(np.int32)), pa.array(stretch.astype(np.int32)), pa.array(np.diff(items.offsets)[row].astype(np.int32))],
                names=["doc_id", "item_id", "run", "overlap", "item_words"],
            )

    return step


def leaks(
    docs: DataFrame,
    doc_id: str,
    doc_text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    masks: tuple[str, ...] = MASKS,
    substitutions: int = 2,
    broadcast_chars: int = 8_000_000,
) -> DataFrame:
    """(doc_id, item_id, run, overlap, item_words) of all documents that share a seed with an item."""
    _positions(masks)
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text")).where("id is not null")
    t = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    size = t.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0)).alias("n")).first().n
    if size <= broadcast_chars:
        rows = sorted((r.id, r.text) for r in t.collect())
        held = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), flat_words([r[1] for r in rows])))
        found = d.mapInArrow(_lookup_step(held, masks, substitutions), RESULT)
    else:
        seeds = t.mapInArrow(_seed_step(masks), "seed bigint, id bigint")
        parts = seeds.select("seed").mapInArrow(_bitmap_step, "bits binary").repartition(1).mapInArrow(_or_step, "bits binary")
        bitmap = spark.sparkContext.broadcast(bytes(parts.first().bits))
        own = d.mapInArrow(_seed_step(masks, bitmap), "seed bigint, id bigint")
        pairs = own.withColumnRenamed("id", "doc_id").join(seeds.withColumnRenamed("id", "item_id"), "seed").select("doc_id", "item_id").distinct()
        found = (
            pairs.join(t.toDF("item_id", "item_text"), "item_id")
            .join(d.toDF("doc_id", "doc_text"), "doc_id")
            .select("doc_id", "item_id", "doc_text", "item_text")
            .mapInArrow(_verify_step(masks, substitutions), RESULT)
        )
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("run", "overlap", "item_words")))


def _or_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0):
            bits = np.frombuffer(x.as_py(), dtype=np.uint8)
            total = bits.copy() if total is None else total | bits
    if total is not None:
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["bits"])

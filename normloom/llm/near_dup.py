"""Near-duplicate texts: all pairs at or above a Jaccard similarity, exactly.

Vertical partitioning (as in fragment-based set similarity joins): a text is
the set of its word n-grams; all n-grams get one global order, rare first; the
order is cut into fragments; each fragment counts on its own the n-grams that
two texts share in it; the partial overlaps are summed per pair.

What keeps that from meeting every pair that shares a common phrase:

* copies (equal sets) are one class and are compared once, through their
  smallest id;
* only prefixes are put into fragments: the rarest ``n - ceil(t n) + 1`` n-grams
  for a set's part as the larger of a pair, ``n - ceil(2t/(1+t) n) + 1`` for its
  part as the smaller, both longer by ``EXTRA`` of the set.  A pair that reaches
  the threshold then shares a number of them that follows from the sizes;
* inside a fragment a shared n-gram counts only where the sizes, the places of
  the n-gram in both orders and a 256-bit parity signature still allow the
  threshold.  Each is a bound that no pair above the threshold fails;
* n-grams in very many sets are cut into tiles, so that no task holds all sets
  of one n-gram.

The pairs left are compared on their whole sets, which are made and shuffled for classes
with a candidate only.  Nothing is sampled or capped.

The order need not be the exact frequency order (any order is right, a rare-first
one is fast): it comes from a frequency sketch of fixed size over all documents.  That
and, behind a check of their number, the ids with candidates are all that is broadcast.

Nulls and texts under ``n`` words have no set, hence no pairs.  A row with a null
id is left out.  Repeated ids: rows with one id must carry one text, else which
text counts is undefined.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import MARKS
from normloom.llm.words import flat_words, mix, spread, window_hashes
from normloom.tables import cut

#: n-grams are 48-bit numbers: with the place of its text in a batch one fits a
#: 64-bit word, and sorting that sorts the sets of a whole batch.
TOKEN_BITS = 48
TOKEN_MASK = np.uint64((1 << TOKEN_BITS) - 1)
#: Buckets of the frequency sketch (a power of two), and the blocks it is summed in.
SKETCH_BITS = 22
SKETCH_BLOCKS = 32
SIGNATURE_BITS = 256
#: Sets of one n-gram that one tile takes; pairs that are compared at once.
TILE_SETS = 20_000
PAIRS_AT_ONCE = 1_000_000
#: Keys of sets that a task remembers to leave out copies.
SEEN = 1_000_000
#: Identifiers of rows with candidates that may be broadcast (some 100 MB at most).
BROADCAST_ROWS = 4_000_000
#: Prefix n-grams that a fragment should hold, from which the number of fragments follows.
FRAGMENT_ENTRIES = 2_000_000
#: Share of a set by which its prefixes are longer than they must be.
EXTRA = 0.05


def _sets(texts: list[str | None], n: int, clean: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text, laid end to end and ascending, and their numbers."""
    if clean:
        texts = [MARKS.sub("", t) if t else t for t in texts]
    grams, owner, _ = window_hashes(flat_words(texts), range(n))
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for low in range(0, len(texts), 1 << 16):
        own = owner[(lo := np.searchsorted(owner, low)) : (hi := np.searchsorted(owner, low + (1 << 16)))]
        keys = np.sort(((own - low).astype(np.uint64) << np.uint64(TOKEN_BITS)) | (grams[lo:hi] & TOKEN_MASK))
        if len(keys):
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        out.append(keys & TOKEN_MASK)
        np.add.at(counts, low, 0)
        part = np.bincount((keys >> np.uint64(TOKEN_BITS)).astype(np.int64), minlength=min(1 << 16, len(texts) - low))
        counts[low : low + len(part)] = part
    return (np.concatenate(out) if out else np.empty(0, dtype=np.uint64)), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _class_keys(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that tell sets apart, whatever the order."""
    return (_sums(mix(tokens + np.uint64(1)), counts).view(np.int64), _sums(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5)), counts).view(np.int64))


def _frequency_step(n: int, clean: bool):
    """Rows (id, k1, k2, size) of each text with a set, and (block, counts) of the sketch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        none = lambda k, t: pa.nulls(k, t)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            tokens, counts = _sets(texts, n, clean)
            sketch += np.bincount((tokens & np.uint64(len(sketch) - 1)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            k1, k2 = _class_keys(tokens, counts)
            some = np.flatnonzero(counts)
            k = len(some)
            yield pa.record_batch(
                [ids.take(pa.array(some)), pa.array(k1[some]), pa.array(k2[some]), pa.array(counts[some].astype(np.int32)), none(k, pa.int32()), none(k, pa.binary())],
                names=["id", "k1", "k2", "size", "block", "counts"],
            )
        if not sketch.any():
            return
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SKETCH_BLOCKS)]
        k = SKETCH_BLOCKS
        yield pa.record_batch(
            [none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.int32()), pa.array(np.arange(k, dtype=np.int32)), pa.array(packed, pa.binary())],
            names=["id", "k1", "k2", "size", "block", "counts"],
        )

    return step


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the blocks of one partition; frequencies as eighths of a doubling, in a byte."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, packed in zip(b.column(0).to_pylist(), b.column(1)):
            counts = np.frombuffer(zlib.decompress(packed.as_py()), dtype=np.uint32).astype(np.uint64)
            total[block] = total[block] + counts if block in total else counts
    if total:
        levels = [np.minimum(255, np.round(8 * np.log2(total[k] + 1.0))).astype(np.uint8).tobytes() for k in total]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["block", "counts"])


def _levels(blocks: DataFrame) -> np.ndarray:
    """The sketch of all documents: 2**SKETCH_BITS bytes, whatever the data's size."""
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    width = len(out) // SKETCH_BLOCKS
    summed = blocks.repartition(SKETCH_BLOCKS, "block").mapInArrow(_sum_blocks, "block int, counts binary")
    for row in summed.collect():
        out[row.block * width : (row.block + 1) * width] = np.frombuffer(row.counts, dtype=np.uint8)
    return out


def _pack(tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Sets as binary values, six bytes a token; ``counts`` has no zeros."""
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * 6
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(tokens.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())])


def _set_step(n: int, clean: bool):
    """Rows (k1, class_id, tokens) of texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, counts = _sets(b.column(1).to_pylist(), n, clean)
            k1, _ = _class_keys(tokens, counts)
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(k1[some]), b.column(0).take(pa.array(some)), _pack(tokens, counts[some])], names=["k1", "class_id", "tokens"])

    return step


def _unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a binary column, end to end, and the number in each row."""
    column = column if len(column) else pa.array([], pa.binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int32)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]].reshape(-1, 6) if len(column) and ends[-1] > ends[0] else np.empty((0, 6), dtype=np.uint8)
    wide = np.zeros((len(data), 8), dtype=np.uint8)
    wide[:, :6] = data
    return wide.view(np.uint64).reshape(-1), np.diff(ends) // 6


def _least(t: float, sizes: np.ndarray) -> np.ndarray:
    return np.ceil(t * sizes - 1e-9).astype(np.int64)


def _prefixes(t: float, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix lengths of sets as the larger and as the smaller of a pair."""
    extra = np.ceil(EXTRA * sizes).astype(np.int64) + 1
    return (
        np.minimum(sizes, sizes - _least(t, sizes) + extra),
        np.minimum(sizes, sizes - _least(2 * t / (1 + t), sizes) + extra),
    )


def _signatures(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parity of the tokens that fall on each of 256 bits: two sets that differ in
    d tokens differ in at most d bits."""
    owner, _ = spread(counts)
    bit = (mix(tokens) & np.uint64(SIGNATURE_BITS - 1)).astype(np.int64)
    odd = np.bincount(owner * SIGNATURE_BITS + bit, minlength=len(counts) * SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(counts), SIGNATURE_BITS), axis=1)


def _segment_step(n: int, clean: bool, t: float, fragments: int, sketch):
    """One row per set and fragment: the prefix n-grams that lie in the fragment.

    Of equal sets a task sends on one, so copies of one text cost no more than a set a task;
    the keys it remembers are bounded by ``SEEN``.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(sketch.value, dtype=np.uint8)
        seen: set[tuple[int, int]] = set()
        for b in batches:
            tokens, counts = _sets(b.column(0).to_pylist(), n, clean)
            k1, k2 = _class_keys(tokens, counts)
            fresh = np.zeros(len(counts), dtype=bool)
            for i in np.flatnonzero(counts).tolist():
                key = (int(k1[i]), int(k2[i]))
                if key not in seen:
                    fresh[i] = True
                    seen.add(key)
            if len(seen) > SEEN:
                seen = set()
            tokens, k1, counts = tokens[np.repeat(fresh, counts)], k1[fresh], counts[fresh]
            owner, _ = spread(counts)
            rank = levels[(tokens & np.uint64(len(levels) - 1)).astype(np.int64)]
            yield _segments(k1, tokens[np.lexsort((rank, owner))], counts, levels, t, fragments)

    return step


def _segments(ids: np.ndarray, tokens: np.ndarray, counts: np.ndarray, levels: np.ndarray, t: float, fragments: int) -> pa.RecordBatch:
    """The segments of sets in the global order; a set goes by its first key.

    Fragments are intervals of the order, cut so that they hold like shares of the sketch's weight.
    """
    weight = np.bincount(levels, minlength=256) * np.exp2(np.arange(256) / 8.0)
    weight[0] = 0
    below = np.concatenate(([0], np.cumsum(weight))) / max(1.0, weight.sum())
    often = np.exp2(np.arange(256) / 8.0)
    sign = _signatures(tokens, counts)
    owner, place = spread(counts)
    probe, index = _prefixes(t, counts)
    pick = place < probe[owner]
    tokens, owner, place = tokens[pick], owner[pick], place[pick]
    level = levels[(tokens & np.uint64(len(levels) - 1)).astype(np.int64)]
    within = (mix(tokens) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    fragment = np.minimum(fragments - 1, (fragments * (below[level] + within * (below[level + 1] - below[level]))).astype(np.int64))
    # n-grams in very many sets go to the tiles (low, high) that hold their own tile
    tiles = np.maximum(1, np.ceil(often[level] / TILE_SETS).astype(np.int64))
    own = (mix(ids.astype(np.uint64))[owner] % tiles.astype(np.uint64)).astype(np.int64)
    who, other = spread(tiles)
    tokens, owner, place, fragment, own = (x[who] for x in (tokens, owner, place, fragment, own))
    low, high = np.minimum(own, other), np.maximum(own, other)
    group = np.where(tiles[who] > 1, mix(tokens ^ mix((low * 65_537 + high + 1).astype(np.uint64))) & TOKEN_MASK, tokens)
    side = np.where(low == high, 2, (own == high).astype(np.int64))
    home = np.where(tiles[who] > 1, (group % np.uint64(fragments)).astype(np.int64), fragment)
    order = np.lexsort((home, owner))
    group, owner, place, side, home = (x[order] for x in (group, owner, place, side, home))
    head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (home[1:] != home[:-1])))) if len(owner) else np.empty(0, dtype=np.int64)
    flags = side * 2 + (place < index[owner])
    # 32 bits tell n-grams apart within a fragment; a clash adds a count, it never hides one
    entry = np.empty((len(group), 2), dtype=np.uint32)
    entry[:, 0] = (mix(group) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    entry[:, 1] = place * 8 + flags
    ends = np.concatenate((head, [len(group)])).astype(np.int32) * 8
    row = owner[head]
    return pa.record_batch(
        [
            pa.array(home[head].astype(np.int32)),
            pa.array(ids[row]),
            pa.array(counts[row].astype(np.int32)),
            pa.array([x.tobytes() for x in sign[row]], pa.binary()),
            pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(entry.tobytes())]),
        ],
        names=["fragment", "id", "size", "sign", "segment"],
    )


def _distinct(rows: pa.Table) -> pa.Table:
    """Segments without those that several tasks sent of equal sets."""
    rows = rows.take(np.lexsort((rows["id"].to_numpy(), rows["fragment"].to_numpy())))
    ids, fragment = rows["id"].to_numpy(), rows["fragment"].to_numpy()
    again = np.flatnonzero((ids[1:] == ids[:-1]) & (fragment[1:] == fragment[:-1])) + 1
    keep = np.ones(len(ids), dtype=bool)
    for i in again.tolist():  # equal keys, so most likely equal sets
        keep[i] = any(rows[c][i] != rows[c][i - 1] for c in ("size", "sign", "segment"))
    return rows.filter(pa.array(keep)) if len(again) else rows


def _overlap_step(t: float):
    """Partial overlaps (a, b, shared, least) of the fragments of one partition.

    a is the smaller set (by size, then id); ``least`` is the same in all fragments.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = _distinct(pa.Table.from_batches(parts).combine_chunks())
        ids = rows["id"].to_numpy()
        size = rows["size"].to_numpy().astype(np.int64)
        sign = np.frombuffer(b"".join(rows["sign"].to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        segments = rows["segment"].to_pylist()
        entry = np.frombuffer(b"".join(segments), dtype=np.uint32).reshape(-1, 2)
        row = np.repeat(np.arange(len(ids)), [len(s) // 8 for s in segments])
        group = (rows["fragment"].to_numpy().astype(np.uint64)[row] << np.uint64(32)) | entry[:, 0]
        place, flags = entry[:, 1].astype(np.int64) >> 3, entry[:, 1].astype(np.int64) & 7
        probe, index = _prefixes(t, size)
        beyond_probe, beyond_index = size - probe, size - index
        order = np.lexsort((ids[row], size[row], group))
        row, group, place, flags = row[order], group[order], place[order], flags[order]
        new = np.concatenate(([True], group[1:] != group[:-1]))
        number = np.cumsum(new) - 1
        limit = int(size.max()) + 2
        key = number * limit + size[row]
        top = number * limit + np.minimum(limit - 1, np.floor(size[row] / t + 1e-9).astype(np.int64))
        reach = np.searchsorted(key, top, side="right") - np.arange(len(key)) - 1
        reach = np.where(flags & 1, np.maximum(reach, 0), 0)  # the smaller set's n-gram must be an index one
        done = np.concatenate(([0], np.cumsum(reach)))
        at = 0
        while at < len(reach):
            to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS_AT_ONCE, side="right")) - 1)
            i, step_on = spread(reach[at:to])
            i += at
            j = i + 1 + step_on
            ok = (flags[i] >> 1 != flags[j] >> 1) | (flags[i] >> 1 == 2)
            i, j = i[ok], j[ok]
            a, b = row[i], row[j]
            need = np.ceil(t / (1 + t) * (size[a] + size[b]) - 1e-9).astype(np.int64)
            most = np.minimum(place[i], place[j]) + np.minimum(size[a] - place[i], size[b] - place[j])
            ok = most >= need
            a, b, need = a[ok], b[ok], need[ok]
            apart = np.bitwise_count(sign[a] ^ sign[b]).sum(axis=1, dtype=np.int64)
            ok = apart <= size[a] + size[b] - 2 * need
            a, b, need = a[ok], b[ok], need[ok]
            # what the pair can share outside these prefixes; the rest must show in the sum
            least = need - np.maximum(beyond_index[a], beyond_probe[b])
            at = to
            # a block's pairs go on at once; Spark adds up what several blocks and fragments say
            x, y = ids[a], ids[b]
            order = np.lexsort((y, x))
            x, y, least = x[order], y[order], least[order]
            head = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.empty(0, dtype=np.int64)
            shared = np.diff(np.concatenate((head, [len(x)])))
            for lo in range(0, len(head), 50_000):
                h = head[lo : lo + 50_000]
                yield pa.record_batch(
                    [pa.array(x[h]), pa.array(y[h]), pa.array(shared[lo : lo + 50_000].astype(np.int32)), pa.array(least[h].astype(np.int32))],
                    names=["a", "b", "shared", "least"],
                )

    return step


def _verify(t: float):
    """The similarity of each pair of whole sets, where it reaches ``t``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, m = _unpack(b.column(2))
            right, n = _unpack(b.column(3))
            both = np.concatenate((left, right))
            pair = np.concatenate((spread(m)[0], spread(n)[0]))
            order = np.lexsort((both, pair))
            both, pair = both[order], pair[order]
            same = (both[1:] == both[:-1]) & (pair[1:] == pair[:-1])
            shared = np.bincount(pair[1:][same], minlength=b.num_rows)
            union = m + n - shared
            x, y = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            out = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(shared / np.maximum(union, 1))]
            yield pa.record_batch(out, names=["a", "b", "similarity"]).filter(pa.array(shared >= t * union - 1e-9))

    return step


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, n: int = 5, clean: bool = False, fragments: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the near-duplicates among the rows of ``df``.

    ``members(id, class_id)`` has each row that has a set, with the smallest id of
    the rows with an equal set.  ``pairs(a, b, similarity)``, a < b, has all pairs of
    class ids whose similarity is at least ``threshold``; with ``members`` it holds
    every link between rows.  ``clean`` removes amendment marks first.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = df.sparkSession
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    first = cut(texts.mapInArrow(_frequency_step(n, clean), "id bigint, k1 bigint, k2 bigint, size int, block int, counts binary"))
    sketch = spark.sparkContext.broadcast(_levels(first.where("block is not null").select("block", "counts")).tobytes())

    rows = first.where("id is not null").select("id", "k1", "k2", "size")
    keys = ["k1", "k2", "size"]
    smallest = rows.groupBy(*keys).agg(F.min("id").alias("class_id"))
    members = rows.join(smallest, keys).select("id", "class_id").distinct()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if fragments is None:  # by the measured number of n-grams
        entries = rows.agg(F.sum("size")).first()[0] or 0
        fragments = max(partitions, -(-int(entries * min(1.0, 1 - threshold + EXTRA)) // FRAGMENT_ENTRIES))
    # only prefixes are shuffled, with what a pair is judged by; whole sets follow for the
    # classes that have a candidate
    overlaps = (
        texts.select("text")
        .mapInArrow(_segment_step(n, clean, threshold, fragments, sketch), "fragment int, id bigint, size int, sign binary, segment binary")
        .repartitionById(fragments, F.col("fragment"))
        .mapInArrow(_overlap_step(threshold), "a bigint, b bigint, shared int, least int")
    )
    candidates = cut(overlaps.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("least").alias("least")).where("shared >= least").select("a", "b"))
    asked = candidates.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    wanted = cut(smallest.join(asked, "k1", "left_semi").select(F.col("class_id").alias("id")))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # the joins ask for keys that are not null; plans must be equal to share the exchange
    sets = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").mapInArrow(_set_step(n, clean), "k1 bigint, class_id bigint, tokens binary").where("k1 is not null").repartition(partitions, "k1")
    left = sets.select(F.col("k1").alias("a"), F.col("class_id").alias("id_a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("k1").alias("b"), F.col("class_id").alias("id_b"), F.col("tokens").alias("right"))
    pairs = (
        candidates.join(left, "a")
        .join(right, "b")
        .select("id_a", "id_b", "left", "right")
        .mapInArrow(_verify(threshold), "a bigint, b bigint, similarity double")
        .distinct()  # a row with a repeated id is a set twice
    )
    return members, pairs


def linked_classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links) of every row with a set: its class of equal sets and the number
    of other classes that one is linked to.  With the pairs of classes it holds every link
    without writing out the pairs within a class."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("id", "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def all_links(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every pair of rows (id_a < id_b) at the threshold, copies included."""
    left = members.select(F.col("id").alias("x"), F.col("class_id").alias("a"))
    right = members.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
    between = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

from __future__ import annotations

import random
import re

import pytest

from normloom.llm import near_dup

WORD = re.compile(r"[^\W_]+")


def _sets(rows, n, clean):
    out = {}
    for i, t in rows:
        t = near_dup.MARKS.sub("", t) if clean and t else t
        w = WORD.findall((t or "").lower())
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if grams and i is not None:
            out[i] = grams
    return out


def _brute(rows, t, n, clean=False):
    s = _sets(rows, n, clean)
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


def _corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 12, 40, 120, 400]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.insert(k, rng.choice(vocabulary)), lambda: w.pop(k) if len(w) > 1 else None, lambda: w.__setitem__(k, "new" + str(rng.randrange(9)))])()
        rows.append((i * 7, " ".join(w).upper() if i % 9 == 0 else ", ".join(w)))
    return [*rows, (None, rows[0][1]), (5, None), (6, ""), (8, "one two"), (9, "▼M1 " + rows[3][1]), (10, rows[3][1])]


@pytest.mark.parametrize(("t", "n", "clean"), [(0.7, 3, True), (0.8, 5, False), (0.5, 2, False), (1.0, 3, False)])
def test_links_are_those_of_brute_force(spark, t, n, clean):
    rows = _corpus(int(t * 10) + n)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "k bigint, text string, size int, tokens string").repartition(3)
    members, pairs = near_dup.near_duplicates(df, "k", "text", t, n, clean)
    links = [tuple(r) for r in near_dup.all_links(members, pairs).collect()]
    assert set(links) == _brute(rows, t, n, clean) and len(links) == len(set(links))
    assert {r.id for r in members.collect()} == set(_sets(rows, n, clean))


def test_hot_phrases_go_through_tiles(monkeypatch):
    monkeypatch.setattr(near_dup, "TILE_SETS", 5)
    import numpy as np

    levels = np.full(1 << near_dup.SKETCH_BITS, 48, dtype=np.uint8)
    segments = [near_dup._segments(np.arange(30), np.tile(np.arange(1, 40, dtype=np.uint64), 30), np.full(30, 39), levels, 0.7, 4)]
    found = list(near_dup._overlap_step(0.7)(iter(segments)))
    pairs = {(a, b) for x in found for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist())}
    assert pairs == {(a, b) for a in range(30) for b in range(a + 1, 30)}
    counts = {c for x in found for c in x.column(2).to_pylist()}
    assert len(counts) == 1  # each shared n-gram counted once a pair, whatever its tiles
    again = list(near_dup._overlap_step(0.7)(iter([*segments, *segments])))  # sent by two tasks
    assert [x.to_pylist() for x in again] == [x.to_pylist() for x in found]


def test_empty_table(spark):
    df = spark.createDataFrame([], "k bigint, text string")
    members, pairs = near_dup.near_duplicates(df, "k", "text")
    assert members.count() == 0 and pairs.count() == 0
    with pytest.raises(ValueError):
        near_dup.near_duplicates(df, "k", "text", 0.0)


def test_classes_and_their_links(spark):
    rows = _corpus(3)
    df = spark.createDataFrame(rows, "k bigint, text string").repartition(3)
    members, pairs = near_dup.near_duplicates(df, "k", "text", 0.7, 3)
    sets = _sets(rows, 3, False)
    first = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    linked = {tuple(sorted((first[a], first[b]))) for a, b in _brute(rows, 0.7, 3) if first[a] != first[b]}
    want = {(i, first[i], sum(first[i] in p for p in linked)) for i in sets}
    assert {tuple(r) for r in near_dup.linked_classes(members, pairs).collect()} == want


def test_many_copies_of_one_text(spark):
    """One text a hundred thousand times: a row a task is shuffled with its set, no pairs."""
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.range(100_000).selectExpr("id as k", f"'{text}' as text").unionByName(spark.createDataFrame([(200_000, text + " more")], "k bigint, text string"))
    members, pairs = near_dup.near_duplicates(df, "k", "text", 0.7, 3)
    assert [tuple(r)[:2] for r in pairs.collect()] == [(0, 200_000)]
    found = near_dup.linked_classes(members, pairs).groupBy("class_id", "links").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 100_000), (200_000, 1, 1)]
    step = near_dup._segment_step(3, False, 0.7, 4, type("Sketch", (), {"value": bytes(1 << near_dup.SKETCH_BITS)}))
    import pyarrow as pa

    batch = pa.record_batch([pa.array([text] * 1995)], names=["text"])
    sent = [x for b in step(iter([batch, batch])) for x in b.column(0).to_pylist()]
    assert len(sent) == len(set(sent)) <= 4  # the fragments of one set


def test_streamed_blocks_give_the_same_counts(monkeypatch):
    """Pairs that come out block by block add up to the counts of one block."""
    import numpy as np

    rows = _corpus(8, 80)
    tokens, counts = near_dup._sets([t for _, t in rows], 3, False)
    kept = np.flatnonzero(counts)
    segments = [near_dup._segments(kept, tokens, counts[kept], np.full(1 << near_dup.SKETCH_BITS, 8, dtype=np.uint8), 0.7, 3)]

    def run():
        total = {}
        parts = 0
        for x in near_dup._overlap_step(0.7)(iter(segments)):
            parts += 1
            for a, b, n, least in zip(*(c.to_pylist() for c in x.columns)):
                old = total.get((a, b), (0, least))
                assert old[1] == least
                total[a, b] = (old[0] + n, least)
        return total, parts

    whole, one = run()
    monkeypatch.setattr(near_dup, "PAIRS_AT_ONCE", 20)
    cut, several = run()
    assert whole == cut and several > one and whole

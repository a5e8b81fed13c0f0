from __future__ import annotations

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normloom.llm import fold_dedup


def _fold(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB1 -., é", max_size=12), st.text(alphabet="aAbB1 -., é", max_size=12))
def test_two_pointers_agree_with_canonical_text(a, b):
    assert fold_dedup.same_folded([a], [b])[0] == (_fold(a) == _fold(b))
    ha, hb = (fold_dedup.field_hashes([x]) for x in (a, b))
    if _fold(a) == _fold(b):
        assert [int(x[0]) for x in ha] == [int(x[0]) for x in hb]


def _rows(seed):
    rng = random.Random(seed)
    base = [(f"Text {i} of the law, § {i}", f"Snippet {i // 2}") for i in range(20)]
    rows = []
    for i in range(300):
        a, b = base[0] if rng.random() < 0.3 else rng.choice(base)
        a = rng.choice([a, a.upper(), a.replace(" ", "\n"), "- " + a + ".", a.lower()])
        rows.append((i + 1, *((b, a) if rng.random() < 0.2 else (a, b))))
    return [*rows, (400, None, ""), (401, "", "…"), (402, None, None), (None, "x", "y"), (403, "only", None), (404, None, "ONLY")]


def _brute(rows):
    groups = {}
    for i, a, b in rows:
        if i is not None:
            groups.setdefault(tuple(sorted((_fold(a), _fold(b)))), []).append(i)
    return {(i, min(g)) for g in groups.values() for i in g}


def test_members_and_counts(spark):
    rows = _rows(3)
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], "g bigint, a string, b string, keep_id int, ka string").repartition(4)
    members, groups, records = fold_dedup.folded_copies(df, "g", "a", "b")
    got = [tuple(r) for r in members.collect()]
    sizes = Counter(k for _, k in got)
    assert sorted(tuple(r) for r in groups.collect()) == sorted(x for x in got if sizes[x[1]] > 1)
    assert set(got) == _brute(rows) and len(got) == len(set(got))
    assert sum(r.copies for r in records.collect()) == len(got)


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    def one_key(batches):
        import pyarrow as pa

        for b in batches:
            n = b.num_rows
            yield pa.record_batch([b.column(0), *(pa.array([7] * n, pa.int64()) for _ in range(5))], names=["id", "k1", "k2", "k3", "k4", "size"])

    monkeypatch.setattr(fold_dedup, "_key_step", one_key)
    rows = _rows(5)[:60]
    df = spark.createDataFrame(rows, "g bigint, a string, b string")
    members, _, _ = fold_dedup.folded_copies(df, "g", "a", "b")
    assert {tuple(r) for r in members.collect()} == _brute(rows)


def test_empty_table(spark):
    members, _, records = fold_dedup.folded_copies(spark.createDataFrame([], "g bigint, a string, b string"), "g", "a", "b")
    assert members.count() == 0 and records.count() == 0


def test_windows_do_not_change_the_hashes(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aBc .,é1") for _ in range(rng.randint(0, 60))) for _ in range(50)] + ["", "x" * 500, ""]
    whole = [x.tolist() for x in fold_dedup.field_hashes(texts)]
    for window in (1, 7, 64):
        monkeypatch.setattr(fold_dedup, "WINDOW", window)
        assert [x.tolist() for x in fold_dedup.field_hashes(texts)] == whole
    assert whole[2] == [len(_fold(t)) for t in texts]
    assert [len(set(x)) for x in zip(*[(_fold(t), h) for t, h in zip(texts, whole[0])])][0] == len(set(whole[0]))


def test_many_copies_of_one_row(spark):
    df = spark.range(20_000).select("id", F.lit("One  text.").alias("a"), F.lit(None).cast("string").alias("b"))
    copies = fold_dedup.folded_copies(df, "id", "a", "b")
    assert copies.records.collect()[0].asDict() == {"keep_id": 0, "copies": 20_000}
    assert copies.groups.count() == 20_000


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "c", "d")], "id bigint, a string, b string")
    copies = fold_dedup.folded_copies(df, "id", "a", "b")
    assert sorted(tuple(r) for r in copies.members.collect()) == [(1, 1), (2, 2)] and copies.groups.count() == 0

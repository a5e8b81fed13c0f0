from __future__ import annotations

import random
import re

import pytest

from normloom.llm import leak

WORD = re.compile(r"[^\W_]+")


def _data(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 20, 30])))) for i in range(15)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 10, 50, 200]))]
        if rng.random() < 0.6:
            part = rng.choice(items)[1].split()
            k = rng.randrange(len(part))
            part = part[k : k + rng.choice([8, 11, 12, 13, 30])]
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "changed"
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in part]
        docs.append((i, " ".join(w)))
    return [*docs, (None, items[0][1]), (90, None), (91, ""), (92, items[3][1]), (93, items[3][1])], [*items, (None, "x " * 20), (199, None), (198, "")]


def _brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ()) if i is not None and d is not None}
    return out


@pytest.mark.parametrize("limit", [8_000_000, 0])
def test_runs_of_twelve_on_both_paths(spark, limit):
    docs, items = _data(2)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc bigint, text string, item_id int").repartition(3)
    t = spark.createDataFrame(items, "item bigint, text string")
    got = leak.leaks(d, "doc", "text", t, "item", "text", broadcast_chars=limit).where("run >= 12").collect()
    pairs = [(r.doc_id, r.item_id) for r in got]
    assert set(pairs) == _brute(docs, items) and len(pairs) == len(set(pairs))


def test_substitutions_are_ignored_by_masks(spark):
    words = [f"x{i}" for i in range(30)]
    changed = list(words)
    changed[7], changed[20] = "other", "another"
    d = spark.createDataFrame([(1, " ".join(changed)), (2, "nothing to see")], "doc bigint, text string")
    t = spark.createDataFrame([(9, " ".join(words))], "item bigint, text string")
    (row,) = leak.leaks(d, "doc", "text", t, "item", "text").collect()
    assert (row.doc_id, row.item_id, row.run, row.overlap, row.item_words) == (1, 9, 12, 30, 30)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k bigint, text string")
    one = spark.createDataFrame([(1, "a b c")], "k bigint, text string")
    for a, b in ((e, one), (one, e), (e, e)):
        assert leak.leaks(a, "k", "text", b, "k", "text").collect() == []
    with pytest.raises(ValueError):
        leak.leaks(e, "k", "text", e, "k", "text", masks=("011",))

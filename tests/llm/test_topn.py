from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normloom.llm import topn

SCORES = [0.5, -0.5, 0.0, -0.0, 1e300, float("inf"), float("-inf"), 0.25]
ROWS = st.lists(st.tuples(st.integers(0, 4), st.integers(-6, 6), st.sampled_from(SCORES)), min_size=1, max_size=80)


def _brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is None or i is None or s is None or s != s:
            continue
        best[g, i] = max(best.get((g, i), float("-inf")), s)
    out = set()
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i) for (q, i), s in best.items() if q == g))[:n]
        out |= {(g, i, -s) for s, i in ranked}
    return out


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 7))
def test_block_is_like_sorting(rows, n):
    g, i, s = (np.array(x) for x in zip(*rows))
    keep = topn.top_of_block(g, i, s.astype(float), n)
    got = {(int(g[k]), int(i[k]), float(s[k])) for k in keep}
    assert got == _brute(rows, n) and len(got) == len(keep)


@pytest.mark.parametrize("block", [7, 1_000_000])
def test_top_n_with_nulls_ties_hot_group_and_extra_columns(spark, block):
    rng = np.random.default_rng(1)
    rows = [(None if rng.random() < 0.03 else int(1 if rng.random() < 0.4 else rng.integers(2, 30)), None if rng.random() < 0.03 else int(rng.integers(0, 50)), [None, float("nan"), *SCORES][rng.integers(0, 10)]) for _ in range(3000)]
    df = spark.createDataFrame([(*r, "g") for r in rows], "q bigint, c bigint, s double, g string").repartition(5)
    got = topn.top_n(df, "q", "c", "s", 4, block).collect()
    assert {tuple(r) for r in got} == _brute(rows, 4) and len(got) == len(_brute(rows, 4))


def test_empty_table(spark):
    df = spark.createDataFrame([], "q bigint, c bigint, s double")
    assert topn.top_n(df, "q", "c", "s", 3).collect() == []
    with pytest.raises(ValueError):
        topn.top_n(df, "q", "c", "s", 0)

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pytest

from normloom.operators import reporting
from normloom.plans import catalogue


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in sorted(os.listdir(small)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, tables, name):
    df = catalogue.queries()[name](spark, small)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = tables.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [tuple(map(_plain, r)) for r in found.fetchall()]
    assert sorted(map(repr, (tuple(_plain(r[c]) for c in columns) for r in rows))) == sorted(map(repr, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).columns == ["item_id", "doc_id", "rank", "score"]


def _draws(f):
    return f(np.random.RandomState(42))


def test_resampling_queries_draw_ten_thousand_times(spark, small):
    """As numpy with the same seed; the figures of fewer draws differ."""
    pairs = {k: d.sort_values("query") for k, d in catalogue._pairs(spark, small).toPandas().groupby(catalogue.PAIR)}
    want = {}
    for k, d in pairs.items():
        x = (d.a - d.b).to_numpy()
        want[k] = float((np.abs((_draws(lambda r: r.choice([-1.0, 1.0], size=(10_000, len(x)))) * x).mean(axis=1)) >= abs(x.mean()) - 1e-12).mean())
    got = {(r.model_key, r.method_a, r.method_b): r.p_value for r in catalogue.queries()["permutation_p"](spark, small).collect()}
    assert got == pytest.approx(want) and any(round(p * 1000, 6) % 1 for p in got.values())

    s = catalogue._scores(spark, small).where("k = 10").toPandas()
    for r in catalogue.queries()["bootstrap_ci"](spark, small).collect():
        own = s[(s[catalogue.SYSTEM] == [r[c] for c in catalogue.SYSTEM]).all(axis=1)].sort_values("query")[r.metric].to_numpy(dtype=float)
        means = own[_draws(lambda g: g.randint(0, len(own), size=(10_000, len(own))))].mean(axis=1)
        assert (r.ci95_low, r.ci95_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=1e-6)


def test_significance_cells_test_with_ten_thousand_flips(spark, small, monkeypatch):
    seen = []
    whole = reporting.starred
    monkeypatch.setattr(reporting, "starred", lambda m, tests, value: seen.append(tests) or whole(m, tests, value))
    assert catalogue.queries()["significance_cells"](spark, small).count()
    p = {(r.model_key, r.method_a, r.method_b): r.p_value for r in seen[0].collect()}
    every = {(r.model_key, r.method_a, r.method_b): r.p_value for r in catalogue.queries()["permutation_p"](spark, small).collect()}
    assert p and all(every[k] == pytest.approx(v) for k, v in p.items()) and any(round(v * 1000, 6) % 1 for v in p.values())

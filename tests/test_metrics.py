from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from normloom.operators import classification, ir_metrics, reporting, statistics


def _want(ranked, rel, k):
    top = ranked[:k]
    hits = [i + 1 for i, d in enumerate(top) if d in rel]
    dcg = sum(1 / math.log2(i + 1) for i in hits)
    ideal = sum(1 / math.log2(i + 2) for i in range(len(hits)))
    return {
        "hit": float(bool(hits)), "recall": len(hits) / len(rel) if rel else 0.0, "precision": len(hits) / k, "mrr": 1 / hits[0] if hits else 0.0,
        "ap": sum((n + 1) / i for n, i in enumerate(hits)) / len(rel) if rel else 0.0, "ndcg": dcg / ideal if hits else 0.0, "first_rank": float(hits[0]) if hits else math.inf,
    }


def test_metrics_of_small_lists(spark):
    runs = {1: [1, 2, 3, 4], 2: [5, 6], 3: [7], 4: [8, 9, 10]}
    rels = {1: {2, 4, 99}, 2: {50}, 4: {8}}
    r = spark.createDataFrame([("m", q, d, i + 1) for q, ds in runs.items() for i, d in enumerate(ds)], "s string, query int, doc int, rank int")
    x = spark.createDataFrame([(q, d) for q, ds in rels.items() for d in ds for _ in range(2)], "query int, doc int")
    got = ir_metrics.per_query(r, x, ["s"]).collect()
    assert len(got) == 4 * 5
    for row in got:
        want = _want(runs[row["query"]], rels.get(row["query"], set()), row.k)
        assert {m: row[m] for m in want} == pytest.approx(want)
    means = {row.k: row for row in ir_metrics.at_k(ir_metrics.per_query(r, x, ["s"]), ["s"]).collect()}
    assert means[3].mean_rank == pytest.approx(1.5) and means[3].num_queries == 4
    assert ir_metrics.at_k(ir_metrics.per_query(r.where("query = 3"), x)).where("k = 1").first().mean_rank == math.inf


def test_error_categories(spark):
    r = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (3, 2, 9)], "query int, doc int, rank int")
    x = spark.createDataFrame([(1, 1), (2, 1), (2, 7), (3, 2), (4, 5)], "query int, doc int")
    got = {r["query"]: r.category for r in ir_metrics.error_categories(r, x, [], 3).collect()}
    assert got == {1: "success", 2: "partial", 3: "late_hit", 4: "complete_miss"}


def test_classification(spark):
    y = [("A", "A"), ("A", "B"), ("B", "B"), ("C", "A"), ("B", "B"), ("C", None), ("X", "A")]
    cells = classification.confusion(spark.createDataFrame(y, "t string, p string"), "t", "p", ("A", "B", "C", "D"))
    assert cells.count() == 16
    per = {r.label: r for r in classification.per_class(cells).collect()}
    assert (per["A"].precision, per["A"].recall, per["C"].f1, per["D"].f1) == (0.5, 0.5, 0.0, 0.0)
    s = classification.summary(cells).first()
    assert s.accuracy == pytest.approx(3 / 5) and s.n == 5
    assert s.macro_f1 == pytest.approx((0.5 + 0.8 + 0 + 0) / 4)
    pe = (2 * 2 + 2 * 3 + 1 * 0) / 25
    assert s.cohen_kappa == pytest.approx((0.6 - pe) / (1 - pe))
    row = classification.confusion_matrix(cells, ("A", "B", "C", "D")).where("y_true = 'A'").first()
    assert (row.a, row.b, row.c, row.d) == (1, 1, 0, 0)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(p=st.lists(st.floats(0, 1), min_size=1, max_size=8))
def test_holm(spark, p):
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    got = {r.i: r.p_value_holm for r in statistics.holm(df, ["f"], "p", ["i"]).collect()}
    running, m = 0.0, len(p)
    for n, i in enumerate(sorted(range(m), key=lambda i: (p[i], i))):
        running = max(running, min(1.0, (m - n) * p[i]))
        assert got[i] == pytest.approx(running) and got[i] >= p[i] - 1e-12


def test_seeded_statistics_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(0)
    rows = [("m", i, float(x), float(x + rng.normal() * 0.1)) for i, x in enumerate(rng.random(60))]
    df = spark.createDataFrame(rows, "s string, q int, a double, b double")
    one = [statistics.bootstrap_ci(d, ["s"], "a", "q", 500).first() for d in (df, df.repartition(5))]
    assert one[0] == one[1] and one[0].ci95_low < one[0].mean < one[0].ci95_high
    values = np.array([r[2] for r in rows])
    state = np.random.RandomState(42)
    means = values[state.randint(0, 60, size=(500, 60))].mean(axis=1)
    assert (one[0].ci95_low, one[0].ci95_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    same = statistics.permutation_test(df.withColumn("b", df.a), ["s"], "a", "b", "q", 200).first()
    assert same.p_value == 1.0
    far = statistics.permutation_test(df.withColumn("b", df.a + 1), ["s"], "a", "b", "q", 200).first()
    assert far.p_value == 0.0 and far.delta_mean == pytest.approx(-1)


def test_groups_that_share_their_draws(spark):
    """Together or apart, of equal and unequal lengths, with values that are not finite."""
    rng = np.random.RandomState(1)
    rows = [(m, x, q, float(rng.rand()), float(rng.rand())) for m in "ab" for x in "xyz" for q in range(40 if x == "z" else 55)] + [("a", "x", 99, float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "m string, x string, q int, a double, b double")
    for f, values in ((statistics.bootstrap_ci, ("a",)), (statistics.permutation_test, ("a", "b"))):
        d = df if f is statistics.bootstrap_ci else df.where("q < 99")
        apart = sorted(map(tuple, f(d, ["m", "x"], *values, "q", 300).collect()))
        shared = sorted(map(tuple, f(d.repartition(3), ["m", "x"], *values, "q", 300, together=["x"]).collect()))
        every = sorted(map(tuple, f(d, ["m", "x"], *values, "q", 300, together=["m", "x"]).collect()))
        assert apart == shared == every and len(apart) == 6


def test_pairs_and_effects(spark):
    rows = [("x", m, q, v) for q in range(4) for m, v in (("a", 1.0), ("b", q / 4), ("c", 1.0))]
    pairs = statistics.method_pairs(spark.createDataFrame(rows, "k string, m string, q int, v double"), ["k"], "m", "q", "v")
    assert pairs.count() == 3 * 4
    got = {(r.method_a, r.method_b): r for r in statistics.paired_effect(pairs, ["k", "method_a", "method_b"]).collect()}
    assert got["a", "c"].effect_size_dz == 0 and got["a", "c"].effect_label == "negligible"
    d = np.array([1 - q / 4 for q in range(4)])
    assert got["a", "b"].effect_size_dz == pytest.approx(d.mean() / d.std(ddof=1)) and got["a", "b"].effect_label == "large"


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "dataset string, level string, model_key string, method string, k int, hit_rate double, mrr double, ndcg double")


def test_reports(spark):
    rows = [("g", "d", m, t, k, 0.1 * i, 0.2, 0.3 + 0.1 * i) for i, (m, t) in enumerate((("m1", "bm25"), ("m2", "bm25"), ("m1", "dense"))) for k in (1, 10)]
    m = _metrics(spark, rows)
    best = {(r.method, r.k, r.metric): r for r in reporting.comparison(m).collect()}
    one = best["bm25", 10, "ndcg"]
    assert (one.best_model_key, one.second_model_key, one.num_compared) == ("m2", "m1", 2) and one.gap_to_second == pytest.approx(0.1)
    assert best["dense", 10, "ndcg"].second_model_key is None and best["dense", 10, "ndcg"].gap_to_second is None
    sel = reporting.selection(m.where("k = 10")).first()
    assert (sel.best_model, sel.best_method, sel.second_model) == ("m1", "dense", "m2")
    newer = _metrics(spark, [("g", "d", "m1", "bm25", 10, 0.9, 0.9, 0.9)])
    merged = reporting.merge_metrics([m, newer])
    assert merged.count() == 6 and merged.where("ndcg = 0.9").count() == 1
    assert reporting.same_frames(merged, reporting.merge_metrics([merged, newer])).first() == (0, 0)
    assert {r.k for r in reporting.at_report_k(m, 5).collect()} == {10} and {r.k for r in reporting.at_report_k(m, 1).collect()} == {1}
    assert [r.method for r in reporting.ablation_pivot(m.where("k = 10"), ["m1", "m2"]).collect()] == ["bm25", "dense"]
    assert not any(r.complete for r in reporting.complete_systems(m).collect())
    with pytest.raises(ValueError):
        reporting.same_frames(m, m.drop("k"))

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from normloom.operators import lexical, passages, ranking, vectors

DOCS = [(1, "steel steel pump rule"), (2, "steel glass rule"), (3, ""), (4, "rule timber rule"), (5, "steel glass rule")]


def _bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    toks = {i: t.split() for i, t in docs}
    n, avgdl = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: r if r >= 0 else eps * mean for w, r in raw.items()}
    return {i: sum(idf.get(w, 0) * t.count(w) * (k1 + 1) / (t.count(w) + k1 * (1 - b + b * len(t) / avgdl)) for w in query.split()) for i, t in toks.items()}


def test_bm25_against_the_formula(spark):
    docs = spark.createDataFrame(DOCS, "k bigint, t string")
    q = spark.createDataFrame([(1, "steel rule steel"), (2, "unknown"), (3, "timber")], "q bigint, s string")
    got = {}
    for r in lexical.bm25_topk(docs, "k", "t", q, "q", "s", 5).collect():
        got.setdefault(r["query"], {})[r.rank] = (r.doc, r.score)
    for n, text in ((1, "steel rule steel"), (2, "unknown"), (3, "timber")):
        want = sorted(_bm25(DOCS, text).items(), key=lambda x: (-round(x[1], 9), -x[0]))
        assert [got[n][i + 1][0] for i in range(5)] == [d for d, _ in want]
        assert [got[n][i + 1][1] for i in range(5)] == pytest.approx([s for _, s in want])


def test_bm25_per_group_has_own_statistics(spark):
    docs = spark.createDataFrame([(i, t, "a" if i < 3 else "b") for i, t in DOCS], "k bigint, t string, g string")
    q = spark.createDataFrame([(1, "steel rule")], "q bigint, s string")
    got = {(r.g, r.doc): r.score for r in lexical.bm25_scores(docs, "k", "t", q, "q", "s", ["g"]).collect()}
    for g, ids in (("a", (1, 2)), ("b", (3, 4, 5))):
        want = _bm25([d for d in DOCS if d[0] in ids], "steel rule")
        assert {k: v for (x, k), v in got.items() if x == g} == pytest.approx({i: s for i, s in want.items() if s})


def test_rrf_sums_and_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q int, d int, rank int")
    b = spark.createDataFrame([(1, 13, 1), (1, 11, 2), (1, 14, 3)], "q int, d int, rank int")
    got = ranking.fuse_topk([a, b], ["q"], "d", 5).orderBy("rank").collect()
    assert [r.d for r in got] == [11, 10, 13, 12, 14]
    assert got[0].rrf == pytest.approx(2 / 62) and got[1].rrf == pytest.approx(1 / 61)
    swapped = {r.d: r.rrf for r in ranking.rrf([b, a], ["q"], "d").collect()}
    assert swapped == pytest.approx({r.d: r.rrf for r in ranking.rrf([a, b], ["q"], "d").collect()})


def test_constrained_selection(spark):
    rows = [
        (1, 1, 1, "policy_or_recommendation_docs", "P", "f1"), (1, 2, 2, "policy_or_recommendation_docs", "P", "f1"), (1, 3, 3, "policy_or_recommendation_docs", "P", "f2"),
        (1, 4, 4, "policy_or_recommendation_docs", "P", "f3"), (1, 5, 5, "binding_law", "L", "f1"), (1, 6, 6, "binding_law", "L", "f9"),
    ]
    c = spark.createDataFrame(rows, "q bigint, c bigint, rank int, evidence_group string, document string, fingerprint string")
    pick = lambda **kw: [r.c for r in ranking.select_constrained(c, "q", "c", 4, **kw).orderBy("rank").collect()]
    assert pick(max_per_document=2) == [5, 1, 3, 6]
    assert pick(max_per_document=0, suppress_near_duplicates=False) == [5, 1, 2, 3]
    assert pick(max_per_document=1) == [5, 1]


def test_document_cap_and_ranking(spark):
    runs = spark.createDataFrame([(1, c, c, d) for c, d in enumerate("AABAC", 1)], "q int, c int, rank int, doc string")
    assert [r.c for r in ranking.document_cap(runs, ["q"], "doc", 1, 5).orderBy("rank").collect()] == [1, 3, 5]
    assert [(r.doc, r.rank) for r in ranking.document_ranking(runs, ["q"], "doc").orderBy("rank").collect()] == [("A", 1), ("B", 2), ("C", 3)]


def test_dense_and_late_interaction(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 6))
    m[7] = m[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "k bigint, v array<float>").repartition(3)
    q = df.where("k < 4")
    s = m.astype(np.float32).astype(float)
    for metric, worth in (("ip", -(s[:4] @ s.T)), ("l2", ((s[:4, None] - s[None]) ** 2).sum(-1))):
        got = vectors.dense_topk(df, "k", "v", q, "k", "v", 5, metric).orderBy("query", "rank").collect()
        for i in range(4):
            want = sorted(range(40), key=lambda j: (round(worth[i, j], 9), -j))[:5]
            assert [r.doc for r in got if r["query"] == i] == want
    groups = df.where("k < 40").groupBy((df.k / 4).cast("bigint").alias("g")).agg({"v": "collect_list"}).toDF("g", "v")
    back = {r.g: np.array(r.v) for r in groups.collect()}
    got = {(r["query"], r.doc): r.score for r in vectors.maxsim_topk(groups, "g", "v", groups.where("g < 2"), "g", "v", 10).collect()}
    assert got == pytest.approx({(a, b): float((back[a] @ back[b].T).max(axis=1).sum()) for a in (0, 1) for b in range(10)})
    assert vectors.dense_topk(df.limit(0), "k", "v", q, "k", "v", 5).count() == 0
    assert vectors.dense_topk(df, "k", "v", q.limit(0), "k", "v", 5).count() == 0


def test_queries_beyond_one_broadcast_go_in_passes(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(30)], "k bigint, v array<double>")
    whole = sorted(map(tuple, vectors.dense_topk(df, "k", "v", df, "k", "v", 3).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", 30)
    assert sorted(map(tuple, vectors.dense_topk(df, "k", "v", df, "k", "v", 3).collect())) == whole


class _Held:
    def __init__(self, value):
        self.value = value


def test_blocks_of_vectors_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(3)
    d, q = rng.integers(-2, 3, (57, 4)).astype(np.float32), rng.integers(-2, 3, (13, 4)).astype(np.float64)
    batches = [pa.record_batch([pa.array(range(i, min(57, i + 20)), pa.int64()), pa.array(d[i : i + 20].tolist(), pa.list_(pa.float32()))], names=["doc", "v"]) for i in range(0, 57, 20)]

    def run(metric):
        out = list(vectors._search_step(_Held((np.arange(13), q)), 5, metric)(iter(batches)))
        assert len(out) == 1  # a list a task, not one a batch
        return sorted(zip(*(c.to_pylist() for c in out[0].columns)))

    for metric in ("ip", "l2"):
        s = q @ d.T.astype(float) if metric == "ip" else -((q[:, None] - d[None]) ** 2).sum(axis=2)
        want = sorted((i, j, s[i, j] if metric == "ip" else -s[i, j]) for i in range(13) for j in sorted(range(57), key=lambda j: (-s[i, j], -j))[:5])
        for side, scores in ((1024, 10**6), (3, 7)):
            monkeypatch.setattr(vectors, "BLOCK_SIDE", side)
            monkeypatch.setattr(vectors, "BLOCK_SCORES", scores)
            assert np.allclose(run(metric), want)


def test_blocks_of_multi_vectors(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(-2, 3, (rng.integers(1, 6), 3)).astype(float) for _ in range(40)]
    asked = [rng.integers(-2, 3, (rng.integers(1, 5), 3)).astype(float) for _ in range(9)]
    counts = np.array([len(x) for x in asked])
    held = _Held((np.arange(9), np.cumsum(counts) - counts, np.concatenate(asked)))
    batch = pa.record_batch([pa.array(range(40), pa.int64()), pa.array([x.tolist() for x in docs], pa.list_(pa.list_(pa.float64())))], names=["doc", "v"])
    want = []
    for i, a in enumerate(asked):
        s = [(a @ m.T).max(axis=1).sum() for m in docs]
        want += [(i, j, s[j]) for j in sorted(range(40), key=lambda j: (-s[j], -j))[:6]]
    for side in (1024, 1, 7):
        monkeypatch.setattr(vectors, "BLOCK_SIDE", side)
        out = next(vectors._maxsim_step(held, 6)(iter([batch])))
        assert np.allclose(sorted(zip(*(c.to_pylist() for c in out.columns))), sorted(want))


def test_passages(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the old pump and the new pump"), (2, None), (3, ""), (4, "a new pump"), (None, "the old pump")], "d bigint, t string")
    items = spark.createDataFrame([(1, "pump"), (2, "new pump"), (3, ""), (4, None), (5, "absent"), (6, "pump"), (None, "old")], "i bigint, p string")
    want = sorted([(1, 1), (6, 1), (2, 1), (1, 4), (6, 4), (2, 4)])
    for size in (10**6, 4):  # one pass, several passes
        monkeypatch.setattr(passages, "BROADCAST_CHARS", size)
        found = passages.passages_in(docs.where("d is not null"), "d", "t", items, "i", "p")
        assert sorted((r["item"], r.doc) for r in found.collect()) == want
    held = {"pump": [1, 6], "new pump": [2], "absent": [5]}
    plain = passages._finder(held)
    monkeypatch.setattr(passages, "ahocorasick", None)
    assert all(plain(t) == passages._finder(held)(t) for t in ("the old pump and the new pump", "a new pump", "", "xpumpx"))


def test_sparse_weights_count_once_each_and_only_if_positive(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"], [1.0, 2.0, 0.5]), (2, ["b"], [-1.0]), (3, [], [])], "doc bigint, terms array<string>, weights array<double>")
    q = spark.createDataFrame([(7, ["a", "b"], [2.0, 1.0])], "query bigint, terms array<string>, weights array<double>")
    assert [(r.doc, r.score) for r in lexical.sparse_topk(d, q, 5).collect()] == [(1, 5.0)]

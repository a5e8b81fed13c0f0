from __future__ import annotations

import json
import shutil

import pytest
from pyspark.sql import functions as F

from normloom import cli, jobs
from normloom.operators import judging

PAGE = "<html><body><main><h2>Aims</h2>" + "".join(f"<p>Paragraph {i} of the plan says that steel and pump number {i} must be repaired soon.</p>" for i in range(6)) + "</main></body></html>"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("job")
    for name in ("REACH-1.html", "CEAP-2.html"):
        (root / name).write_text(PAGE.replace("plan", name[:4].lower()))
    cli.main(["build", str(root), str(root / "out")], spark)
    return root


def test_build_and_retrieve(spark, built):
    chunks = spark.read.parquet(f"{built}/out/index/chunks")
    assert chunks.count() == 12 and chunks.select("chunk_idx").distinct().count() == 12
    (built / "recs.csv").write_text("section;title;recommendation\n1;a;repair steel pump 3\n2;b;\n")
    for mode in ("flat_baseline", "split_evidence_retrieval"):
        cli.main(["retrieve", f"{built}/out/index", str(built / "recs.csv"), f"{built}/{mode}", "--top-k", "4", "--mode", mode], spark)
        rows = spark.read.option("header", True).csv(f"{built}/{mode}").collect()
        assert len(rows) == 8 and {r.evidence_group for r in rows} == {"binding_law", "policy_or_recommendation_docs"} or mode == "flat_baseline"


def test_numbers_follow_the_order_of_files(spark, built):
    chunks = spark.read.parquet(f"{built}/out/index/chunks").orderBy("chunk_idx").collect()
    assert [(r.chunk_idx, r.source_file) for r in chunks] == [(i, "CEAP-2.html" if i < 6 else "REACH-1.html") for i in range(12)]
    assert all(f"number {i % 6} must" in r.text for i, r in enumerate(chunks))
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).repartition(7)
    assert {r.x - r.chunk_idx for r in jobs.numbered(df, ["x"]).collect()} == {0}
    assert jobs.numbered(df.limit(0), ["x"]).count() == 0


def test_cut_tables_need_a_shared_folder_on_a_cluster():
    from normloom import tables

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs://shared/"
    assert tables.shared_folder(Session()) == "hdfs://shared"
    assert [tables.is_local(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,1024]", "yarn", "k8s://x")] == [True, True, True, False, False, False]


def test_methods_prompt_and_evaluation(spark, built):
    chunks = spark.read.parquet(f"{built}/out/index/chunks")
    queries = spark.createDataFrame([(1, "steel pump number 3"), (2, "ceap says"), (3, "reac plan")], "query_id bigint, query string")
    family = jobs.retrievers(chunks, jobs.Models("m", judging.hashing_embedder, lambda: judging.overlap_scorer))
    assert sorted(family) == sorted(["bm25", "dense", "rrf", "bm25_rerank", "dense_rerank", "rrf_rerank"])
    runs = None
    for name in ("bm25", "rrf", "rrf_rerank"):
        r = family[name](queries, 4)
        assert r.groupBy("query_id").count().where("count = 4").count() == 3
        r = r.select(F.lit("m").alias("model_key"), F.lit(name).alias("method"), "query_id", "chunk_idx", "rank")
        runs = r if runs is None else runs.unionByName(r)
    gold = spark.createDataFrame([(1, "reach"), (1, "ceap"), (2, "CEAP"), (3, "weee")], "query_id bigint, doc_short_name string")
    tables = jobs.evaluate(runs, chunks, gold, ks=(1, 3))
    assert tables["metrics"].count() == 6 and tables["intervals"].count() == 9 and tables["comparisons"].count() == 9
    merged = jobs.merge_evaluations([tables["metrics"], tables["metrics"]], 10)
    assert merged["metrics"].count() == 6 and {r.k for r in merged["ranking"].collect()} == {3}
    with pytest.raises(ValueError):
        jobs.evaluate(runs, chunks, gold.limit(0))
    with pytest.raises(ValueError):
        jobs.merge_evaluations([tables["metrics"].drop("k")])

    def classify():
        return lambda prompts: [json.dumps({"label": "aligned", "justification": "because", "cited_chunk_ids": ["x"]}) for _ in prompts]

    def judge():
        return lambda prompts: ['{"label_score": 4, "justification_score": 4, "evidence_score": 4, "completeness_score": 4, "reasoning": "fine"}' if "object" in p else "?" for p in prompts]

    out = jobs.prompt(family["bm25"](queries, 2), chunks, queries, classify, judge)
    rows = out.collect()
    assert {r.alignment_label for r in rows} == {"Aligned"} and {r.overall_score for r in rows} == {4.0}
    study = jobs.prompt_study(out.withColumn("human_label", F.lit("Aligned")))
    assert study["agreement"].first().accuracy == 1.0 and study["labels"].first().share == 1.0 and study["citations"].first().citations == 3


def answers():
    """Factories named on the command line."""
    return lambda prompts: [json.dumps({"label": "aligned", "justification": "because", "cited_chunk_ids": []}) for _ in prompts]


def scores():
    return lambda prompts: ['{"label_score": 2, "justification_score": 4, "evidence_score": 4, "completeness_score": 4, "reasoning": "fine"}' if "Cited: none" in p else "?" for p in prompts]


def all_models():
    return jobs.Models("hashed", judging.hashing_embedder, lambda: judging.overlap_scorer, lambda: judging.word_sparse_encoder, lambda: judging.word_multi_encoder(), limit=60)


def test_sparse_and_multi_vector_methods(spark, built):
    chunks = spark.read.parquet(f"{built}/out/index/chunks")
    queries = spark.createDataFrame([(1, "steel pump number 3"), (2, "ceap says")], "query_id bigint, query string")
    family = jobs.retrievers(chunks, all_models())
    assert len(family) == 10 and "colbert_rerank" in family
    texts = {r.chunk_idx: r.text for r in chunks.collect()}
    encode, multi = judging.word_sparse_encoder, judging.word_multi_encoder()
    for name in ("splade", "colbert"):
        got = {(r.query_id, r["rank"]): (r.chunk_idx, r.score) for r in family[name](queries, 3).collect()}
        for q, query in ((1, "steel pump number 3"), (2, "ceap says")):
            if name == "splade":
                a, *rest = encode([f"query: {query}"])
                best = {i: sum(w * b.get(t, 0) for t, w in a.items()) for i, b in zip(texts, encode([f"passage: {t}" for t in texts.values()]))}
            else:
                a = multi([query])[0]
                best = {i: (a @ m.T).max(axis=1).sum() for i, m in zip(texts, multi(list(texts.values())))}
            want = sorted(best.items(), key=lambda x: (-round(float(x[1]), 9), -x[0]))[:3]
            assert [got[q, i][1] for i in (1, 2, 3)] == pytest.approx([float(s) for _, s in want], abs=1e-5)


def test_stored_vectors_are_made_anew_when_outdated(spark, tmp_path):
    from normloom.sources import stores

    made = []
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "k bigint, t string")

    def make(c):
        made.append(1)
        return judging.embed(c, "k", "t", judging.hashing_embedder)

    def run(d):
        return stores.stored_vectors(d, "k", "t", str(tmp_path), "m", make).count()

    assert (run(docs), run(docs), len(made)) == (2, 2, 1)
    changed = spark.createDataFrame([(1, "a b"), (2, "d")], "k bigint, t string")
    assert (run(changed), len(made)) == (2, 2)
    for part in tmp_path.glob("*/vectors/*.parquet"):
        part.write_bytes(b"broken")
    for part in tmp_path.glob("*/vectors/.*.crc"):
        part.unlink()
    assert (run(changed), len(made)) == (2, 3)


def test_prompt_evaluate_and_judge_on_the_command_line(spark, built):
    (built / "gold.csv").write_text("Paper;recommendation_text;doc_short_name\nP;repair steel pump 3;REACH\nP;repair steel pump 3;ceap\nP;ceap says;CEAP\n;;\n")
    (built / "recs2.csv").write_text("section;title;recommendation\n1;a;repair steel pump 3\n2;b;\n")
    index, here = f"{built}/out/index", "tests.test_jobs" if __name__.startswith("tests.") else __name__
    cli.main(["prompt", index, str(built / "recs2.csv"), f"{built}/prompted", "--classifier", f"{here}:answers", "--judge", f"{here}:scores", "--models", f"{here}:all_models", "--top-k", "4", "--mode", "split_evidence_retrieval"], spark)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{built}/prompted/classifications").collect()
    assert [(r.alignment_label, r.overall_score) for r in rows] == [("Aligned", "3.5"), ("Aligned", "3.5")]
    cli.main(["judge", f"{built}/prompted/classifications", f"{built}/judged", "--judge", f"{here}:scores"], spark)
    again = spark.read.option("header", True).csv(f"{built}/judged").collect()
    assert [(r.predicted_label, r.label_score, r.overall_score) for r in again] == [("Aligned", "2", "3.5")] * 2

    evaluate = ["evaluate", index, str(built / "gold.csv"), f"{built}/study", "--models", f"{here}:all_models", "--whitepaper", str(built / "recs2.csv"), "--k", "1", "3"]
    cli.main(evaluate, spark)
    first = json.loads(spark.read.json(f"{built}/study/run_summary").first().summary)
    assert len(first["ran"]) == 20 and not first["kept"]
    assert spark.read.option("header", True).csv(f"{built}/study/metrics_all").count() == 20
    lines = spark.read.text(f"{built}/study/interpretation").collect()
    assert any("gold_standard | document: hashed" in r.value for r in lines)
    shutil.rmtree(built / "study" / "metrics" / "gold_standard_document_hashed_bm25")
    cli.main([*evaluate, "--old", f"{built}/study/metrics_all"], spark)
    second = json.loads(spark.read.json(f"{built}/study/run_summary").first().summary)
    assert second["ran"] == ["gold_standard_document_hashed_bm25"] and len(second["kept"]) == 19
    with pytest.raises(ValueError):
        jobs.judge_again(spark.createDataFrame([(1, " ")], "query_id int, recommendation_query string"), scores)


def test_robustness_report(spark, built):
    chunks = spark.read.parquet(f"{built}/out/index/chunks")
    queries = spark.createDataFrame([(1, "steel pump number 3"), (2, "ceap says")], "query_id bigint, query string")
    family = jobs.retrievers(chunks, all_models())
    runs = None
    for name in ("bm25", "rrf"):
        r = family[name](queries, 4).select(F.lit("m").alias("model_key"), F.lit(name).alias("method"), "query_id", "chunk_idx", "rank")
        runs = r if runs is None else runs.unionByName(r)
    gold = spark.createDataFrame([(1, "weee"), (2, "CEAP")], "query_id bigint, doc_short_name string")
    found = jobs.robustness(runs, chunks, gold, ks=(1, 3))
    assert {r.query for r in found["negative"].collect()} == {1}
    lines = [r.line for r in found["interpretation"].collect()]
    assert len(lines) == 2 and all("rank inf" in x for x in lines)

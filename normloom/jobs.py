"""Whole jobs: build, prompt, judge, evaluate, unified evaluation, merge and studies, on files and tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import text as T
from normloom.functions import vocab
from normloom.operators import chunking, classification, ir_metrics, judging, lexical, ranking, reporting, statistics, vectors
from normloom.sources import csv_sources, stores
from normloom.tables import cut

Retrieve = Callable[[DataFrame, int], DataFrame]


def numbered(rows: DataFrame, by: Sequence[str], name: str = "chunk_idx") -> DataFrame:
    """Rows with their number from 0 in the order of ``by``; a table that has it is left alone.

    The rows are sorted in ranges over all tasks and written; a number is a row's place in
    its range after all rows of the ranges before, of which one count each is collected.
    """
    if name in rows.columns:
        return rows
    placed = cut(rows.orderBy(*by).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = {r["_range"]: r["n"] for r in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    first, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, first))
        first += sizes[k]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _first bigint"))  # a row a range
    return placed.join(offsets, "_range").withColumn(name, F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")


def build(spark: SparkSession, html_folder: str, out: str) -> DataFrame:
    """HTML files to chunks, evidence CSV and lexical index."""
    chunks = numbered(chunking.chunk_html(csv_sources.read_files(spark, html_folder, "*.html")), ["path", "place"]).drop("path", "place")
    stores.write_csv(chunks.select(*chunking.CHUNK_FIELDS), f"{out}/evidence_csv")
    stores.save_index(chunks, "chunk_idx", "text", f"{out}/index")
    return spark.read.parquet(f"{out}/index/chunks")


@dataclass(frozen=True)
class Models:
    """The pluggable models of a retrieval family; each is made once a task.

    ``stored`` is a folder in which the corpus's vectors are kept under ``model_key`` and
    read again while the corpus is the same.  ``limit`` is the number of words a model
    takes.  ``tokenize`` makes BM25's terms (``stem.stemmed_tokens`` for stemmed ones).
    """

    model_key: str = "model"
    embed: Callable[[], judging.Embed] | None = None
    score: Callable[[], judging.Score] | None = None
    sparse: Callable[[], judging.SparseEncode] | None = None
    multi: Callable[[], judging.MultiEncode] | None = None
    stored: str | None = None
    limit: int | None = None
    tokenize: lexical.Tokenize = T.tokens


def retrievers(chunks: DataFrame, models: Models = Models(), rrf_k: int = vocab.RRF_K) -> dict[str, Retrieve]:
    """The family of retrieval methods over (chunk_idx, text): each takes queries(query_id,
    query) and a depth and returns (query_id, chunk_idx, score, rank).

    bm25 always; dense and rrf with an embedder, splade with a sparse encoder, colbert with
    a multi-vector one, and each of them reranked with a scorer.
    """
    named = lambda found: found.select(F.col("query").alias("query_id"), F.col("doc").alias("chunk_idx"), "score", "rank")

    def taken(column: str, passage: bool):
        """The text as the embedder wants it: prefixed for its kind, within its limit."""
        text = T.with_prefix(F.coalesce(F.col(column), F.lit("")), models.model_key, passage)
        return T.truncated(text, models.limit) if models.limit else text

    def vectors_of(kind: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The corpus's encoding, made once: stored, else written for this application."""
        if models.stored:
            return stores.stored_vectors(chunks, "chunk_idx", "text", models.stored, f"{models.model_key}-{kind}", make)
        return cut(make(chunks))

    def bm25(queries: DataFrame, k: int) -> DataFrame:
        return named(lexical.bm25_topk(chunks, "chunk_idx", "text", queries, "query_id", "query", k, tokenize=models.tokenize))

    out: dict[str, Retrieve] = {"bm25": bm25}
    if models.embed:

        @cache
        def corpus() -> DataFrame:
            return vectors_of("dense", lambda c: judging.embed(c.select("chunk_idx", taken("text", True).alias("text")), "chunk_idx", "text", models.embed))

        def dense(queries: DataFrame, k: int) -> DataFrame:
            q = judging.embed(queries.select("query_id", taken("query", False).alias("query")), "query_id", "query", models.embed)
            return named(vectors.dense_topk(corpus(), "id", "vector", q, "id", "vector", k))

        def rrf(queries: DataFrame, k: int) -> DataFrame:
            fused = ranking.fuse_topk([bm25(queries, 2 * k), dense(queries, 2 * k)], ["query_id"], "chunk_idx", k, rrf_k)
            return fused.select("query_id", "chunk_idx", F.col("rrf").alias("score"), "rank")

        out |= {"dense": dense, "rrf": rrf}
    if models.sparse:

        @cache
        def expanded() -> DataFrame:
            return cut(judging.sparse_encode(chunks, "chunk_idx", "text", models.sparse, "passage: "))

        def splade(queries: DataFrame, k: int) -> DataFrame:
            q = judging.sparse_encode(queries, "query_id", "query", models.sparse, "query: ")
            return named(lexical.sparse_topk(expanded().withColumnRenamed("id", "doc"), q.withColumnRenamed("id", "query"), k))

        out["splade"] = splade
    if models.multi:

        @cache
        def matrices() -> DataFrame:
            return vectors_of("multi", lambda c: judging.multi_encode(c, "chunk_idx", "text", models.multi))

        def colbert(queries: DataFrame, k: int) -> DataFrame:
            q = judging.multi_encode(queries, "query_id", "query", models.multi)
            return named(vectors.maxsim_topk(matrices(), "id", "vector", q, "id", "vector", k))

        out["colbert"] = colbert
    if models.score:

        def reranked(base: Retrieve) -> Retrieve:
            def run(queries: DataFrame, k: int) -> DataFrame:
                c = base(queries, max(2 * k, 30)).select("query_id", "chunk_idx").join(chunks.select("chunk_idx", "text"), "chunk_idx").join(queries, "query_id")
                return judging.rerank(c, ["query_id"], "chunk_idx", "query", "text", k, models.score)

            return run

        out |= {f"{name}_rerank": reranked(base) for name, base in list(out.items())}
    return out


def hybrid(chunks: DataFrame, queries: DataFrame, models: Models, top_k: int = vocab.TOP_K, rerank_top: int = vocab.RERANK_TOP, mode: str = vocab.MODES[0], max_per_document: int = 0, suppress_near_duplicates: bool = True) -> DataFrame:
    """Full hybrid retrieval: fused candidates of the whole corpus, or of each evidence group
    with its own statistics and chosen under constraints; reranked to ``rerank_top`` where
    there is a scorer.  (query_id, chunk_idx, rank)"""
    if mode not in vocab.MODES:
        raise ValueError(f"mode must be one of {vocab.MODES}")
    method = "rrf" if models.embed else "bm25"
    if mode == vocab.MODES[0]:
        runs = retrievers(chunks, models)[method](queries, top_k)
    else:
        runs = split_retrieve(chunks, queries, top_k, max_per_document, suppress_near_duplicates, models)
    if models.score is None:
        return runs.where(F.col("rank") <= rerank_top).select("query_id", "chunk_idx", "rank")
    c = runs.select("query_id", "chunk_idx").join(chunks.select("chunk_idx", "text"), "chunk_idx").join(queries, "query_id")
    return judging.rerank(c, ["query_id"], "chunk_idx", "query", "text", rerank_top, models.score).select("query_id", "chunk_idx", "rank")


def split_candidates(chunks: DataFrame, queries: DataFrame, k: int, models: Models = Models()) -> DataFrame:
    """Candidates of each evidence group by its own statistics, merged by score with their
    rank, evidence_group, document and fingerprint."""
    # names are few: their groups are worked out once and joined, not per chunk
    groups = cut(chunks.select("document").distinct().withColumn("evidence_group", T.evidence_group("document")))
    c = chunks.select("chunk_idx", "document", "text").join(groups, "document")
    top = None
    for g in vocab.GROUPS:  # two groups, each with its own statistics
        found = retrievers(c.where(F.col("evidence_group") == g), models)["rrf" if models.embed else "bm25"](queries, 2 * k)
        one = found.select("query_id", "chunk_idx", F.lit(g).alias("evidence_group"), "score")
        top = one if top is None else top.unionByName(one)
    merged = ranking.ranked(top, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_idx").desc()])
    return merged.join(chunks.select("chunk_idx", "document", T.fingerprint("text").alias("fingerprint")), "chunk_idx")


def split_retrieve(chunks: DataFrame, queries: DataFrame, k: int, max_per_document: int = 0, suppress_near_duplicates: bool = True, models: Models = Models()) -> DataFrame:
    """Split evidence mode: the candidates of both groups chosen under constraints:
    (query_id, chunk_idx, rank)."""
    return ranking.select_constrained(split_candidates(chunks, queries, k, models), "query_id", "chunk_idx", k, max_per_document, suppress_near_duplicates)


def prompt(runs: DataFrame, chunks: DataFrame, queries: DataFrame, generate: Callable[[], judging.Generate], judge: Callable[[], judging.Generate] | None = None) -> DataFrame:
    """Classification (and judgement) of each query on its retrieved chunks: the export's
    columns with label, justification and cited ids."""
    x = cut(runs.join(chunks, "chunk_idx"))
    blocks = judging.evidence_blocks(x, "query_id").join(queries, "query_id")
    ask = judging.messages("classifier", {"recommendation": F.col("query"), "k": F.col("n_chunks"), "evidence": F.col("block")})
    asked = blocks.select("query_id", "query", "n_chunks", "block", F.to_json(ask).alias("prompt"))
    answers = cut(judging.generate(asked, "query_id", "prompt", generate).select(F.col("id").alias("query_id"), judging.classifier_fields("answer").alias("c")))
    export = stores.prompt_export(x, ["query_id"]).join(answers, "query_id", "left")
    out = export.select("*", judging.best_label("c.label").alias("alignment_label"), F.col("c.justification").alias("justification"), F.array_join("c.cited_chunk_ids", "; ").alias("cited_chunk_ids")).drop("c")
    if judge is None:
        return out
    short = judging.evidence_blocks(x.withColumn("article_text", F.lit("")), "query_id")  # the judge sees the chunks only
    scores = judge_answers(short.join(queries, "query_id").join(answers, "query_id"), judge)
    return out.join(scores, "query_id", "left")


def judge_answers(asked: DataFrame, judge: Callable[[], judging.Generate]) -> DataFrame:
    """The judge's fields for rows (query_id, query, n_chunks, block, c with label,
    justification and cited_chunk_ids); an answer of which nothing can be read is asked for
    once more with a short prompt."""
    cited = F.array_join("c.cited_chunk_ids", ", ")
    values = {"recommendation": F.col("query"), "k": F.col("n_chunks"), "evidence": F.col("block"), "label": F.col("c.label"), "justification": F.substring("c.justification", 1, 2000), "cited": F.when(F.coalesce(cited, F.lit("")) == "", "none").otherwise(cited)}
    short = {"label": F.col("c.label"), "justification": F.substring("c.justification", 1, 400)}
    p = asked.select("query_id", F.to_json(judging.messages("judge", values)).alias("p"), F.to_json(judging.messages("retry", short)).alias("again"))
    return judging.judged(p, "query_id", "p", "again", judge).select(F.col("id").alias("query_id"), "j.*")


def judge_again(export: DataFrame, judge: Callable[[], judging.Generate]) -> DataFrame:
    """Judge results of an exported classification table (query_id, recommendation_query,
    alignment_label, justification, cited_chunk_ids, top_chunk_ids, top_chunk_texts): the
    retrieved chunks are rebuilt from it.  Rows without a recommendation are left out; none
    left is an error."""
    rows = cut(export.where("trim(coalesce(recommendation_query, '')) <> ''"))
    if rows.isEmpty():
        raise ValueError("no classification has a recommendation")
    chunks = judging.rebuild_chunks(rows, "query_id").withColumn("id", F.col("chunk_id")).withColumns({c: F.lit("") for c in ("article_subtitle", "paragraph", "article_text")})
    blocks = judging.evidence_blocks(chunks, "query_id")
    c = F.struct(F.col("alignment_label").alias("label"), F.col("justification"), T.semicolon_values("cited_chunk_ids").alias("cited_chunk_ids"))
    asked = rows.select("query_id", F.col("recommendation_query").alias("query"), c.alias("c")).join(blocks, "query_id", "left").na.fill({"n_chunks": 0, "block": ""})
    scores = judge_answers(asked, judge)
    return rows.select("query_id", F.col("recommendation_query").alias("recommendation"), F.col("alignment_label").alias("predicted_label")).join(scores, "query_id").drop("strategy")


def prompt_job(spark: SparkSession, chunks: DataFrame, recommendations: DataFrame, out: str, models: Models, generate: Callable[[], judging.Generate], judge: Callable[[], judging.Generate] | None = None, **retrieval) -> DataFrame:
    """Recommendations (query_id, query) to classified, and judged, rows written as CSV."""
    runs = cut(hybrid(chunks, recommendations, models, **retrieval))
    found = cut(prompt(runs, chunks, recommendations, generate, judge).join(recommendations.withColumnRenamed("query", "recommendation_query"), "query_id"))
    stores.write_csv(found, f"{out}/classifications")
    if judge:
        named = found.withColumnsRenamed({"recommendation_query": "recommendation", "alignment_label": "predicted_label"})
        stores.write_csv(stores.judge_export(named), f"{out}/judgements")
    return found


def evaluate(runs: DataFrame, chunks: DataFrame, gold: DataFrame, by: Sequence[str] = ("model_key", "method"), ks: Sequence[int] = vocab.K_VALUES) -> dict[str, DataFrame]:
    """Tables of document-level metrics of runs(by, query_id, chunk_idx, rank) against
    gold(query_id, doc_short_name): per_query, metrics, errors, intervals, comparisons."""
    names = chunks.select("document").distinct().withColumn("doc", T.document_name("document"))
    named = chunks.select("chunk_idx", "document").join(names, "document").select("chunk_idx", "doc")
    d = ranking.document_ranking(runs.join(named, "chunk_idx"), [*by, "query_id"], "doc").withColumnRenamed("query_id", "query")
    rel = gold.select(F.col("query_id").alias("query"), T.document_name("doc_short_name").alias("doc")).distinct()
    if rel.isEmpty():
        raise ValueError("gold has no queries")
    scores = cut(ir_metrics.per_query(d, rel, by, ks))
    k = 10 if 10 in ks else max(ks)
    at = scores.where(F.col("k") == k)
    long = reporting.unpivot(at, [*by, "query"], ["hit", "mrr", "ndcg"])
    pairs = statistics.method_pairs(long, ["model_key", "metric"], "method", "query", "value")
    p = statistics.permutation_test(pairs, ["model_key", "metric", "method_a", "method_b"], "a", "b", "query", together=["method_a", "method_b"])
    effects = statistics.paired_effect(pairs, ["model_key", "metric", "method_a", "method_b"]).drop("delta_mean")
    return {
        "per_query": scores,
        "metrics": ir_metrics.at_k(scores, by).select(F.lit("gold").alias("dataset"), F.lit("document").alias("level"), "*"),
        "categories": ir_metrics.error_categories(d, rel, by, k),
        "errors": ir_metrics.shares(ir_metrics.error_categories(d, rel, by, k), by, "category"),
        "intervals": statistics.bootstrap_ci(long, [*by, "metric"], "value", "query", together=["metric"]),
        "comparisons": statistics.holm(p.join(effects, ["model_key", "metric", "method_a", "method_b"]), ["model_key", "metric"], "p_value", ["method_a", "method_b"]),
        "ablation": reporting.ablation_deltas(at, ["model_key"]),
    }


def merge_evaluations(tables: Sequence[DataFrame], k: int = 10) -> dict[str, DataFrame]:
    """Merged metrics (the last table wins), ranking at k (else at the largest k), comparison."""
    for t in tables:
        missing = set(reporting.KEYS) - set(t.columns)
        if missing:
            raise ValueError(f"missing columns: {sorted(missing)}")
    merged = cut(reporting.merge_metrics(tables))
    at = reporting.at_report_k(merged, k)
    return {"metrics": merged, "ranking": at.orderBy("dataset", "level", F.desc("ndcg"), "model_key", "method"), "comparison": reporting.comparison(at), "report": reporting.text_report(at)}


@dataclass(frozen=True)
class Collection:
    """Queries over a corpus with their relevant documents: chunks(chunk_idx, id, document,
    article, paragraph, text), queries(query_id, query, source_snippet_original),
    relevant(query, doc) by document name or, at level "chunk", by chunk_idx."""

    name: str
    chunks: DataFrame
    queries: DataFrame
    relevant: DataFrame | None = None
    level: str = "document"


def unified_evaluation(spark: SparkSession, out: str, collections: Sequence[Collection], models: Sequence[Models], ks: Sequence[int] = vocab.K_VALUES, export_k: int = vocab.TOP_K, methods: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every model and method over every collection; what an earlier run finished is kept.

    A step writes its export and its metrics and then its marker.  A step with a marker and
    both tables is not run again, so the job goes on where it was broken off.  From all
    metrics come ranking, comparison, ablation and the report's lines; a summary says what
    was run.
    """
    k, ran, kept, tables = (10 if 10 in ks else max(ks)), [], [], []
    for c in collections:
        for m in models:
            family = retrievers(c.chunks, m)
            for method in [x for x in family if methods is None or x in methods]:
                step = safe_name(f"{c.name}_{c.level}_{m.model_key}_{method}")
                export, metrics = f"{out}/exports/{step}", f"{out}/metrics/{step}"
                wanted = [f"{export}/_SUCCESS"] + ([f"{metrics}/_SUCCESS"] if c.relevant is not None else [])
                if stores.is_done(spark, f"{out}/steps", step, wanted):
                    kept.append(step)
                else:
                    runs = cut(family[method](c.queries, max(max(ks), export_k)))
                    stores.gold_export(runs, c.queries, c.chunks, m.model_key, method, export_k).withColumn("dataset", F.lit(c.name)).write.mode("overwrite").parquet(export)
                    if c.relevant is not None:
                        system = [F.lit(m.model_key).alias("model_key"), F.lit(method).alias("method")]
                        ranked = _documents(runs, c.chunks) if c.level == "document" else runs.select(F.col("query_id").alias("query"), F.col("chunk_idx").alias("doc"), "rank")
                        scores = ir_metrics.per_query(ranked.select("*", *system), c.relevant, ["model_key", "method"], ks)
                        at = ir_metrics.at_k(scores, ["model_key", "method"]).select(F.lit(c.name).alias("dataset"), F.lit(c.level).alias("level"), "*")
                        at.write.mode("overwrite").parquet(metrics)
                    stores.mark_done(spark, f"{out}/steps", step, {"collection": c.name, "model": m.model_key, "method": method, "k": list(ks)})
                    ran.append(step)
                if c.relevant is not None:
                    tables.append(spark.read.parquet(metrics))
    merged = cut(reporting.merge_metrics(tables))
    at, names = reporting.at_report_k(merged, k), sorted({m.model_key for m in models})
    compared = reporting.comparison(at)
    pivot = reporting.ablation_pivot(at, names)
    found = {
        "metrics_all": merged,
        "ranking": at.orderBy("dataset", "level", F.desc("ndcg"), "model_key", "method"),
        "comparison": compared,
        "comparison_all_k": reporting.comparison(merged),
        "ablation": pivot,
        "interpretation": reporting.top_lines(at).select("line").unionByName(reporting.gap_lines(compared).select("line")),
        "ablation_report": reporting.ablation_report(pivot, names).orderBy("position").select("line"),
    }
    for name, df in found.items():
        stores.write_csv(df, f"{out}/{name}")
    stores.write_summary(spark, f"{out}/run_summary", {"models": names, "k_values": sorted(ks), "ran": ran, "kept": kept, "outputs": sorted(found)})
    return found


def _documents(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, doc, rank) of the documents of a run's chunks."""
    names = chunks.select("document").distinct().withColumn("doc", T.document_name("document"))
    named = chunks.select("chunk_idx", "document").join(names, "document").select("chunk_idx", "doc")
    return ranking.document_ranking(runs.join(named, "chunk_idx"), ["query_id"], "doc").withColumnRenamed("query_id", "query")


def safe_name(text: str) -> str:
    """A step's name as a file name."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", text)


def retrieval_study(spark: SparkSession, out: str, collections: Sequence[Collection], models: Sequence[Models], known: Sequence[str], ks: Sequence[int] = vocab.K_VALUES, old: DataFrame | None = None) -> dict[str, DataFrame]:
    """Unified evaluation of the known models, the best systems, global means and, against an
    older metrics table, the differences."""
    usable = [m for m in models if m.model_key in known]
    if not usable:
        raise ValueError(f"none of the models is known: {[m.model_key for m in models]}")
    metrics = unified_evaluation(spark, out, collections, usable, ks)["metrics_all"]
    at = reporting.at_report_k(metrics, 10)
    best, means = reporting.selection(at), reporting.global_means(at)
    found = {"selection": best, "global_means": reporting.ranked_by(means, "mean_ndcg")}
    if old is not None:
        found["old_new"] = reporting.old_new_deltas(old, at)
    for name, df in found.items():
        stores.write_csv(df, f"{out}/{name}")
    top = means.orderBy(F.round("mean_ndcg", 9).desc(), "model_key", "method").limit(5).collect()
    stores.write_summary(spark, f"{out}/study_summary", {"models": [m.model_key for m in usable], "unknown": [m.model_key for m in models if m not in usable], "best": [r.best_model for r in best.collect()], "top": [[r.model_key, r.method] for r in top]})
    return found


def robustness(runs: DataFrame, chunks: DataFrame, gold: DataFrame, by: Sequence[str] = ("model_key", "method"), ks: Sequence[int] = vocab.K_VALUES) -> dict[str, DataFrame]:
    """``evaluate`` with its negative cases, the methods' means and the report in words."""
    found = evaluate(runs, chunks, gold, by, ks)
    k = 10 if 10 in ks else max(ks)
    means = reporting.method_means(found["per_query"].where(F.col("k") == k), by)
    return found | {"means": means, "negative": reporting.negative_cases(found["categories"]), "interpretation": reporting.robustness_lines(means, found["comparisons"])}


def prompt_study(export: DataFrame) -> dict[str, DataFrame]:
    """Distributions of a prompt export, and agreement where there are human labels."""
    label = F.when(F.trim(F.coalesce("alignment_label", F.lit(""))) == "", "<empty>").otherwise(F.col("alignment_label")).alias("label")
    both = export.where("trim(coalesce(human_label, '')) <> '' and trim(coalesce(alignment_label, '')) <> ''")
    cells = classification.confusion(both, "human_label", "alignment_label")
    cited = export.select(F.explode(T.semicolon_values("cited_chunk_ids")).alias("chunk_id"))
    return {
        "labels": ir_metrics.shares(export.select(label), [], "label"),
        "citations": cited.groupBy("chunk_id").agg(F.count("*").alias("citations")),
        "filled": export.agg(*(F.count_if(F.trim(F.coalesce(c, F.lit(""))) != "").alias(c) for c in ("alignment_label", "justification", "cited_chunk_ids", "human_label"))),
        "agreement": classification.summary(cells),
        "per_class": classification.per_class(cells),
    }

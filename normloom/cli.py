"""Command line: build, retrieve, prompt, evaluate, judge, merge-eval, k-compare, prompt-study.

Models are named as ``module:function``; the function is called without arguments and
returns what the job wants (``jobs.Models``, or a factory of a generator).
"""

from __future__ import annotations

import argparse
import functools
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from normloom import jobs
from normloom.functions import text as T
from normloom.functions import vocab
from normloom.operators import reporting
from normloom.session import local_session
from normloom.sources import csv_sources, stores
from normloom.tables import cut


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="normloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="HTML files to chunks and index")
    b.add_argument("html")
    b.add_argument("out")
    r = sub.add_parser("retrieve", help="BM25 results of a recommendations CSV")
    r.add_argument("index")
    r.add_argument("recommendations")
    r.add_argument("out")
    r.add_argument("--top-k", type=int, default=10)
    r.add_argument("--mode", choices=vocab.MODES, default=vocab.MODES[0])
    r.add_argument("--max-chunks-per-doc", type=int, default=2)
    q = sub.add_parser("prompt", help="retrieve, classify and judge a recommendations CSV")
    q.add_argument("index")
    q.add_argument("recommendations")
    q.add_argument("out")
    q.add_argument("--classifier", required=True, help="module:function, a factory of a generator")
    q.add_argument("--judge", help="module:function, a factory of a generator")
    q.add_argument("--models", help="module:function that returns jobs.Models")
    q.add_argument("--top-k", type=int, default=10)
    q.add_argument("--rerank-top", type=int, default=5)
    q.add_argument("--mode", choices=vocab.MODES, default=vocab.MODES[0])
    q.add_argument("--max-chunks-per-doc", type=int, default=2)
    e = sub.add_parser("evaluate", help="all methods against gold CSV files, going on where an earlier run stopped")
    e.add_argument("index")
    e.add_argument("gold")
    e.add_argument("out")
    e.add_argument("--models", nargs="*", default=[], help="module:function that returns jobs.Models")
    e.add_argument("--whitepaper", help="a whitepaper's recommendations, for export only")
    e.add_argument("--k", type=int, nargs="*", default=list(vocab.K_VALUES))
    e.add_argument("--old", help="an older metrics table to compare with")
    j = sub.add_parser("judge", help="judge an exported classification CSV again")
    j.add_argument("classifications")
    j.add_argument("out")
    j.add_argument("--judge", required=True, help="module:function, a factory of a generator")
    m = sub.add_parser("merge-eval", help="merge metric tables, the last one wins")
    m.add_argument("out")
    m.add_argument("tables", nargs="+")
    m.add_argument("--k", type=int, default=10)
    k = sub.add_parser("k-compare", help="means and best systems at each k")
    k.add_argument("table")
    k.add_argument("out")
    s = sub.add_parser("prompt-study", help="distributions and agreement of a prompt export")
    s.add_argument("table")
    s.add_argument("out")
    return p


def _named(name: str):
    """What ``module:function`` returns."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)()


def _factory(name: str):
    """A factory that can be sent to the tasks by its name."""
    return functools.partial(_named, name)


def _recommendations(spark: SparkSession, path: str):
    recs = csv_sources.load_recommendations(csv_sources.read_csv(spark, path, places=True))
    return jobs.numbered(recs.where("text <> ''"), ["_file", "_row"], "query_id").withColumnRenamed("text", "query")


def _gold(spark: SparkSession, path: str, chunks):
    """Gold queries with their documents as a collection."""
    g = csv_sources.load_gold(csv_sources.read_csv(spark, path))
    text = lambda c: T.normalize_ws(F.coalesce(c, F.lit("")))
    rows = g.select(text("recommendation_text").alias("query"), text("source_snippet_original").alias("source_snippet_original"), T.document_name("doc_short_name").alias("doc")).where("query <> ''")
    queries = cut(jobs.numbered(rows.select("query", "source_snippet_original").distinct(), ["query", "source_snippet_original"], "query_id").withColumn("query_id", F.col("query_id") + 1))
    relevant = rows.where("doc <> ''").join(queries, ["query", "source_snippet_original"]).select(F.col("query_id").alias("query"), "doc").distinct()
    return jobs.Collection("gold_standard", chunks, queries, relevant)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or local_session("*")
    if a.command == "build":
        jobs.build(spark, a.html, a.out)
    elif a.command == "retrieve":
        chunks = stores.load_index(spark, a.index)["chunks"]
        queries = _recommendations(spark, a.recommendations).select("query_id", "query")
        if a.mode == vocab.MODES[0]:
            runs = jobs.retrievers(chunks)["bm25"](queries, a.top_k)
        else:
            runs = jobs.split_retrieve(chunks, queries, a.top_k, a.max_chunks_per_doc).withColumn("score", F.lit(None).cast("double"))
        stores.write_csv(stores.run_export(runs, chunks, ["query_id"], a.top_k), a.out, skip_empty=True)
    elif a.command == "prompt":
        chunks = stores.load_index(spark, a.index)["chunks"]
        queries = cut(_recommendations(spark, a.recommendations).select("query_id", "query"))
        models = _named(a.models) if a.models else jobs.Models()
        judge = _factory(a.judge) if a.judge else None
        retrieval = {"top_k": a.top_k, "rerank_top": a.rerank_top, "mode": a.mode, "max_per_document": a.max_chunks_per_doc}
        jobs.prompt_job(spark, chunks, queries, a.out, models, _factory(a.classifier), judge, **retrieval)
    elif a.command == "evaluate":
        chunks = stores.load_index(spark, a.index)["chunks"]
        collections = [_gold(spark, a.gold, chunks)]
        if a.whitepaper:
            w = _recommendations(spark, a.whitepaper).select("query_id", "query", F.lit("").alias("source_snippet_original"))
            collections.append(jobs.Collection("whitepaper", chunks, cut(w)))
        models = [_named(m) for m in a.models] or [jobs.Models()]
        old = csv_sources.read_metrics(spark, a.old) if a.old else None
        jobs.retrieval_study(spark, a.out, collections, models, [m.model_key for m in models], a.k, old)
    elif a.command == "judge":
        export = csv_sources.read_csv(spark, a.classifications)
        stores.write_csv(stores.judge_export(jobs.judge_again(export, _factory(a.judge))), a.out)
    elif a.command == "merge-eval":
        for name, df in jobs.merge_evaluations([csv_sources.read_metrics(spark, t) for t in a.tables], a.k).items():
            stores.write_csv(df, f"{a.out}/{name}")
    elif a.command == "k-compare":
        m = csv_sources.read_metrics(spark, a.table)
        stores.write_csv(reporting.k_trend(m), f"{a.out}/k_trend")
        stores.write_csv(reporting.k_winners(m), f"{a.out}/k_winners")
    else:
        for name, df in jobs.prompt_study(csv_sources.read_csv(spark, a.table)).items():
            stores.write_csv(df, f"{a.out}/{name}")


if __name__ == "__main__":
    main()

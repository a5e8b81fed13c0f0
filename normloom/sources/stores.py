"""Index tables, exports, checkpoints of steps and summaries as files.

Writes go through Spark's output committer, so a file is whole or absent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions.text import document_name, evidence_group, first_filled, utc_text
from normloom.operators import lexical

INDEX_TABLES = ("postings", "term_idf", "corpus_stats", "chunks")


def index_key(model_key: str, source: str, cap: int | None = None) -> str:
    """Name of an index that depends on what it was built from."""
    return hashlib.sha1(json.dumps({"model": model_key, "source": source, "cap": cap}, sort_keys=True).encode()).hexdigest()


def save_index(docs: DataFrame, doc: str, text: str, path: str, buckets: int = 32) -> None:
    """Postings (clustered by term), document frequencies, corpus numbers and chunks."""
    post = lexical.postings(docs, doc, text)
    stats = lexical.corpus_stats(docs, text)
    post.repartition(buckets, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    lexical.term_idf(spark.read.parquet(f"{path}/postings"), stats).write.mode("overwrite").parquet(f"{path}/term_idf")
    stats.write.mode("overwrite").parquet(f"{path}/corpus_stats")
    docs.write.mode("overwrite").parquet(f"{path}/chunks")


def index_exists(spark: SparkSession, path: str, tables: Sequence[str] = INDEX_TABLES) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{path}/{t}/_SUCCESS") for t in tables]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if not index_exists(spark, path):
        raise FileNotFoundError(f"no complete index in {path}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in INDEX_TABLES}


def text_digest(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """One row that changes with any document: n_docs and the sum of the rows' hashes."""
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.xxhash64(doc, text).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def stored_vectors(docs: DataFrame, doc: str, text: str, path: str, model_key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, vector) of the documents, made by ``make`` once and read again while they fit.

    Stored under a key of model and path, with the digest of the documents they were made
    of.  A missing, unreadable, short or outdated table is made anew.
    """
    spark = docs.sparkSession
    folder = f"{path}/{index_key(model_key, path)}"
    now = text_digest(docs, doc, text).first()
    try:
        then = spark.read.json(f"{folder}/made_of").first()
        vectors = spark.read.parquet(f"{folder}/vectors")
        if then and (then["n_docs"], then["digest"]) == (now["n_docs"], now["digest"]) and vector_preflight(vectors, "vector", docs).first()["ok"]:
            return vectors
    except (AnalysisException, SparkRuntimeException, Py4JJavaError):
        pass  # nothing there, or nothing that can be read
    make(docs).write.mode("overwrite").parquet(f"{folder}/vectors")
    spark.createDataFrame([now]).coalesce(1).write.mode("overwrite").json(f"{folder}/made_of")
    return spark.read.parquet(f"{folder}/vectors")


def vector_preflight(vectors: DataFrame, vector: str, docs: DataFrame) -> DataFrame:
    """One row: n_vectors, n_docs, least and largest dimension, whether a probe (a stored
    vector as a query) meets numbers only, and whether all is well."""
    numbers = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = vectors.agg(F.count("*").alias("n_vectors"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"), F.coalesce(F.bool_and(numbers), F.lit(False)).alias("probe_ok"))
    one = v.crossJoin(docs.agg(F.count("*").alias("n_docs")))  # single rows
    ok = (F.col("n_vectors") > 0) & (F.col("n_vectors") == F.col("n_docs")) & (F.col("min_dim") > 0) & (F.col("min_dim") == F.col("max_dim")) & F.col("probe_ok")
    return one.withColumn("ok", F.coalesce(ok, F.lit(False)))


def run_export(runs: DataFrame, chunks: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Retrieved chunks of each query with document, group, article and text."""
    rows = runs.where(F.col("rank") <= k).join(chunks, "chunk_idx")
    return rows.select(*by, "rank", F.col("id").alias("chunk_id"), "document", evidence_group("document").alias("evidence_group"), "article", "paragraph", "score", "text")


def _retrieved(runs: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The first k chunks of each query with the columns all exports share."""
    names = chunks.select("document").distinct().withColumn("document_canonical", document_name("document"))
    c = chunks.select("chunk_idx", F.col("id").alias("chunk_id"), "document", "article", "paragraph", "text").join(names, "document", "left")
    return runs.where(F.col("rank") <= k).join(c, "chunk_idx")


_TAIL = ("rank", "score", "chunk_id", "document", "document_canonical", "article", "paragraph", "text")


def gold_export(runs: DataFrame, queries: DataFrame, chunks: DataFrame, model_key: str, method: str, k: int) -> DataFrame:
    """Retrieved chunks of gold queries; ``queries`` has query_id (from 1), query and
    source_snippet_original."""
    rows = _retrieved(runs, chunks, k).join(queries, "query_id")
    head = (F.lit("gold_standard").alias("dataset"), F.lit(model_key).alias("model_key"), F.lit(method).alias("method"))
    return rows.select(*head, F.col("query_id").alias("query_instance_id"), "query", "source_snippet_original", *_TAIL)


def whitepaper_export(runs: DataFrame, recommendations: DataFrame, chunks: DataFrame, model_key: str, method: str, k: int) -> DataFrame:
    """Retrieved chunks of a whitepaper's recommendations; a query without a text goes by its
    section, subsection and title."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    heading = F.trim(F.concat_ws(" ", part("section"), part("subsection"), part("title")))
    query = first_filled(F.trim("recommendation"), heading).alias("query")
    q = recommendations.select("query_id", part("section").alias("section"), part("subsection").alias("subsection"), part("title").alias("title"), query)
    head = (F.lit("whitepaper").alias("dataset"), F.lit(model_key).alias("model_key"), F.lit(method).alias("method"))
    return _retrieved(runs, chunks, k).join(q, "query_id").select(*head, "section", "subsection", "title", "query", *_TAIL)


def corpus_export(runs: DataFrame, queries: DataFrame, docs: DataFrame, dataset: str, model_key: str, method: str, k: int) -> DataFrame:
    """A run over a corpus of documents(chunk_id, text) with its queries(query_id, query)."""
    rows = runs.where(F.col("rank") <= k).join(docs, "chunk_id").join(queries, "query_id")
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(model_key).alias("model_key"), F.lit(method).alias("method"), "query_id", "query", "rank", "score", "chunk_id", "text")


def prompt_export(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per query: distinct documents, groups and articles in alphabetical order, ids
    and texts in rank order.  ``runs`` has rank, id, document, article, text and comes from a
    top-k, so a query's list is bounded."""
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.concat(F.lit("["), part("document"), F.lit(" | "), part("article"), F.lit("]\n"), F.substring(part("text"), 1, 400))
    g = runs.groupBy(*by).agg(
        distinct(part("document")).alias("retrieved_documents"),
        distinct(evidence_group(part("document"))).alias("retrieved_evidence_groups"),
        distinct(F.when(part("article") != "", part("article"))).alias("retrieved_articles"),
        F.array_sort(F.collect_list(F.struct("rank", part("id").alias("id"), head.alias("text")))).alias("rows"),
    )
    joined = lambda field, sep: F.array_join(F.transform("rows", lambda r: r[field]), sep)
    return g.select(*by, "retrieved_documents", "retrieved_evidence_groups", "retrieved_articles", joined("id", "; ").alias("top_chunk_ids"), joined("text", "\n---\n").alias("top_chunk_texts"))


def judge_export(df: DataFrame) -> DataFrame:
    return df.select("recommendation", "predicted_label", "label_score", "justification_score", "evidence_score", "completeness_score", "overall_score", "reasoning")


def write_csv(df: DataFrame, path: str, skip_empty: bool = False, separator: str = ",", encoding: str = "UTF-8") -> bool:
    """CSV with a header and doubled quotes, values as they are; with ``skip_empty`` no rows
    give no file."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("sep", separator).option("encoding", encoding).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return True


def mark_done(spark: SparkSession, folder: str, step: str, summary: dict) -> None:
    """A marker of a finished step; resume wants the marker and the step's artifacts."""
    row = spark.createDataFrame([(step, json.dumps(summary, sort_keys=True))], "step string, summary string")
    row.withColumn("timestamp_utc", utc_text()).coalesce(1).write.mode("overwrite").json(f"{folder}/{step}.done")


def is_done(spark: SparkSession, folder: str, step: str, artifacts: Sequence[str] = ()) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in (f"{folder}/{step}.done/_SUCCESS", *artifacts)]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def write_summary(spark: SparkSession, path: str, summary: dict) -> None:
    """A run's summary as one JSON row, with its time."""
    row = spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "summary string")
    row.select(utc_text().alias("timestamp_utc"), "summary").coalesce(1).write.mode("overwrite").json(path)

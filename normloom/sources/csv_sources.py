"""Delivered CSV, HTML and text files as DataFrames.

Schemas are declared, never inferred; a missing column becomes its default.  Files are
decoded and parsed by the tasks; the driver sees column names only.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normloom.functions.text import chunk_id, first_filled
from normloom.operators.chunking import CHUNK_FIELDS
from normloom.tables import cut

# Encodings tried in order; the last one reads anything.
ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")
GOLD_ALIASES: dict[str, tuple[str, ...]] = {
    "paper": ("Paper", "paper"),
    "source_page": ("source_page",),
    "source_line": ("source_line",),
    "recommendation_text": ("recommendation_text", "recommendation"),
    "source_snippet_original": ("source_snippet_original",),
    "recommendation_or_statement": ("recommendation_or_statement",),
    "doc_short_name": ("doc_short_name", "legal_doc_reference", "document"),
    "doc_type": ("doc_type",),
    "doc_ref_num": ("doc_ref_num",),
    "doc_reference_raw_excerpt": ("doc_reference_raw_excerpt",),
    "evidence_span": ("evidence_span",),
    "reference_basis": ("reference_basis",),
    "needs_review": ("needs_review",),
    "context_excerpt": ("context_excerpt",),
}


def decode(content: bytes) -> str:
    """Text in the first encoding that fits; a byte-order mark is dropped."""
    for name in ENCODINGS[:-1]:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode(ENCODINGS[-1])


def sniff(header: str, candidates: Sequence[str] = (",", ";")) -> str:
    """The candidate that is most frequent outside quotes in a file's header."""
    plain = "".join(header.split('"')[::2])
    return max(candidates, key=lambda d: (plain.count(d), -candidates.index(d)))


def records_of(text: str) -> Iterator[str]:
    """The records of a CSV text: lines joined while a quote is open."""
    held = ""
    for line in text.splitlines(keepends=True):
        held += line
        if held.count('"') % 2 == 0:
            yield held.rstrip("\r\n")
            held = ""
    if held:
        yield held


def _csv_step(separator: str | None):
    """(path, row, fields) of each file's records; row 0 has the columns and their places."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        schema = pa.schema([("path", pa.string()), ("row", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = decode(content or b"")
                lines = csv.reader(io.StringIO(text, newline=""), delimiter=separator or sniff(next(records_of(text), "")))
                header: list[str] | None = None
                rows: list[list[tuple[str, str | None]]] = []
                at = 0
                for values in filter(None, lines):
                    if header is None:
                        header = [name.strip() for name in values]
                        rows.append([(name, str(i)) for i, name in enumerate(header) if name not in header[:i]])
                    else:
                        rows.append([(name, value or None) for i, (name, value) in enumerate(zip(header, values)) if name not in header[:i]])
                    if len(rows) == 10_000:
                        yield pa.record_batch([[path] * len(rows), range(at, at + len(rows)), rows], schema=schema)
                        at, rows = at + len(rows), []
                if rows:
                    yield pa.record_batch([[path] * len(rows), range(at, at + len(rows)), rows], schema=schema)

    return step


def read_csv(spark: SparkSession, path: str, separator: str | None = None, places: bool = False) -> DataFrame:
    """CSV files with headers as one table of strings: quotes doubled inside quoted values,
    values over several lines, empty values null.

    Each file is read whole and has its own encoding (the first of ``ENCODINGS`` that reads
    all of it), separator (by its header unless given) and columns; a column that a file
    lacks is null.  With ``places`` the columns _file and _row say where a row stood.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = cut(files.mapInArrow(_csv_step(separator), "path string, row bigint, fields map<string,string>"))
    heads = rows.where("row = 0").select(F.explode("fields").alias("name", "at")).groupBy("name").agg(F.min(F.col("at").cast("int")).alias("at"))
    names = [r.name for r in heads.orderBy("at", "name").collect()]
    if not names:
        raise FileNotFoundError(f"no CSV with a header in {path}")
    columns = [F.col("fields")[n].alias(n) for n in names]
    return rows.where("row > 0").select(*columns, *([F.col("path").alias("_file"), F.col("row").alias("_row")] if places else []))


def pick(df: DataFrame, names: Sequence[str], default: str = "") -> Column:
    """The first of the names that is a column and not null; an empty text counts."""
    there = {c.lstrip("﻿").strip(): c for c in df.columns}
    return F.coalesce(*(F.col(f"`{there[n]}`") for n in names if n in there), F.lit(default))


def load_chunks(df: DataFrame) -> DataFrame:
    """Evidence rows with all fields; missing ones are "" or 0, a missing id is made."""
    text = {c: pick(df, [c]) for c in CHUNK_FIELDS}
    rows = df.select(*(text[c].alias(c) for c in CHUNK_FIELDS if c != "char_offset"), F.coalesce(text["char_offset"].try_cast("int"), F.lit(0)).alias("char_offset"))
    made = chunk_id("document", "article", "paragraph", "text")
    return rows.withColumn("id", F.when(F.trim("id") != "", F.col("id")).otherwise(made)).select(*CHUNK_FIELDS)


def merge_chunks(frames: Sequence[DataFrame], order: str) -> DataFrame:
    """Union of chunk tables; of equal ids the first row (by ``order``) of the first table stays."""
    every = None
    for i, df in enumerate(frames):
        part = df.withColumn("_file", F.lit(i))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy("id").orderBy("_file", order)
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_file")


def load_recommendations(df: DataFrame) -> DataFrame:
    """section, subsection, title, text; a missing text falls back to the headings."""
    part = {c: pick(df, [c]) for c in ("section", "subsection", "title")}
    heading = F.trim(F.concat_ws(" ", *part.values()))
    places = [c for c in ("_file", "_row") if c in df.columns]
    return df.select(*places, *(v.alias(k) for k, v in part.items()), first_filled(pick(df, ["recommendation"]), pick(df, ["text"]), heading).alias("text"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics table written as CSV, numbers typed."""
    df = read_csv(spark, path)
    numbers = [c for c in ("hit_rate", "recall", "precision", "mrr", "map", "ndcg", "mean_rank", "num_queries") if c in df.columns]
    return df.withColumns({**{c: F.col(c).cast("double") for c in numbers}, "k": F.col("k").cast("int")})


def read_whitepaper(spark: SparkSession, path: str) -> DataFrame:
    """section, subsection, title, text of a whitepaper's recommendations, a CSV parted by semicolons."""
    return load_recommendations(read_csv(spark, path, ";"))


def load_gold(df: DataFrame) -> DataFrame:
    """Gold rows under the canonical names; the label alone may be null."""
    columns = [pick(df, names).alias(name) for name, names in GOLD_ALIASES.items()]
    label = F.nullif(F.trim(pick(df, ["alignment_label"])), F.lit("")).alias("alignment_label")
    return df.select(*columns, label)


def read_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """(path, content) of the files of a folder, not of folders below it; none is an error.
    Rows have no order; ``jobs.numbered`` orders what is made of them by path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    if files.select("path").isEmpty():  # no content is read for that
        raise FileNotFoundError(f"no {pattern} in {path}")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([decode(c or b"") for c in b.column(1).to_pylist()], pa.string())], names=["path", "content"])

    return files.mapInArrow(step, "path string, content string")


def read_records(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(file_name, record_no, raw) of delivered CSV files, cut quote-aware, for
    ``csv_records.parse_records``; ids are file and number."""
    files = read_files(spark, path, pattern)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = list(records_of(content))
                n = len(raw)
                yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(raw, pa.string())], names=["file_name", "record_no", "raw"])

    rows = files.mapInArrow(step, "file_name string, record_no int, raw string")
    return rows.withColumn("record_id", F.xxhash64("file_name", "record_no"))


def load_split(spark: SparkSession, folder: str, config: str, split: str) -> DataFrame:
    """A local dataset split, parquet or JSON lines, with the configuration's folder or without."""
    jvm = spark.sparkContext._jvm
    for base in (f"{folder}/{config}", folder):
        for kind in ("parquet", "json"):
            for name in (f"{base}/{split}.{kind}", f"{base}/{split}"):
                p = jvm.org.apache.hadoop.fs.Path(name)
                if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                    return spark.read.format(kind).load(name)
    raise FileNotFoundError(f"{folder}: no split {split}")


def corpus_chunks(df: DataFrame, order: str, max_corpus: int | None = None) -> DataFrame:
    """Corpus rows as (doc, text): the first rows by order, then blank ones dropped; text is
    title and text on two lines."""
    rows = df.orderBy(order).limit(max_corpus) if max_corpus else df
    text = F.trim(F.concat_ws("\n", F.nullif(F.trim(pick(rows, ["title"])), F.lit("")), F.nullif(F.trim(pick(rows, ["text"])), F.lit(""))))
    return rows.select(F.col(order).alias("doc"), text.alias("text")).where("text <> ''")


def queries_and_qrels(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with a text and qrels with a positive score; a repeated query id is an error."""
    repeated = queries.groupBy("query").count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"repeated query ids: {[r['query'] for r in repeated]}")
    q = queries.where(F.trim("text") != "")
    return q, qrels.where("score > 0").join(q, "query", "left_semi").select("query", "doc").distinct()

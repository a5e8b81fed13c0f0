"""Registered queries of single operators whose inputs are made from the tables: files that
are written and read again, HTML and answers put together from columns, reports and exports.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom import jobs
from normloom.functions import text as T
from normloom.functions import vocab
from normloom.operators import chunking, ir_metrics, judging, lexical, ranking, reporting
from normloom.plans.catalogue import (
    AT_K_SQL, BM25_CTE, DOCS_CTE, EXPORT_CTE, K, LABEL_SQL, METRICS_CTE, MODELS, PASSAGE_RELEVANCE, PER_QUERY_CTE, ROUND_SQL, RUNS_CTE, SPLIT_CTE, SYSTEM,
    _bm25, _document_runs, _gold_relevance, _merged, _metrics, _passage_relevance, _query_runs, _rounded, _runs, _scores, clean_sql, norm_sql, query, tokens_sql,
)
from normloom.sources import csv_records, csv_sources, stores
from normloom.streaming import events as streams
from normloom.tables import cut, job_folder, parallel, table


def _filled(*columns: str) -> str:
    return ", ".join(f"coalesce({c}, '') AS {c}" for c in columns)


# --- files written and read again -----------------------------------------------------------

GOLD_TEXTS = [c for c in csv_sources.GOLD_ALIASES if c not in ("source_page", "source_line")]


@query(f"SELECT {_filled(*GOLD_TEXTS)}, nullif(trim(coalesce(alignment_label, '')), '') AS alignment_label FROM gold")
def gold_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Gold as a delivered CSV under alias headers, parted by semicolons."""
    path = job_folder(spark)
    renamed = {"paper": "Paper", "recommendation_text": "recommendation", "doc_short_name": "legal_doc_reference"}
    stores.write_csv(table(spark, folder, "gold").select(*csv_sources.GOLD_ALIASES, "alignment_label").withColumnsRenamed(renamed), path, separator=";")
    return csv_sources.load_gold(csv_sources.read_csv(spark, path)).select(*GOLD_TEXTS, "alignment_label")


@query("SELECT coalesce(section, '') AS section, coalesce(title, '') AS title, CASE WHEN trim(coalesce(recommendation, '')) <> '' THEN recommendation ELSE trim(concat_ws(' ', coalesce(section, ''), coalesce(subsection, ''), coalesce(title, ''))) END AS text FROM recommendations")
def recommendations_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = job_folder(spark)
    stores.write_csv(table(spark, folder, "recommendations").select("section", "subsection", "title", "recommendation"), path)
    return csv_sources.load_recommendations(csv_sources.read_csv(spark, path)).select("section", "title", "text")


@query("SELECT coalesce(section, '') AS section, coalesce(subsection, '') AS subsection, CASE WHEN trim(coalesce(recommendation, '')) <> '' THEN recommendation ELSE trim(concat_ws(' ', coalesce(section, ''), coalesce(subsection, ''), coalesce(title, ''))) END AS text FROM recommendations")
def whitepaper_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = job_folder(spark)
    stores.write_csv(table(spark, folder, "recommendations").select("section", "subsection", "title", "recommendation"), path, separator=";")
    return csv_sources.read_whitepaper(spark, path).select("section", "subsection", "text")


@query(f"SELECT {_filled(*(c for c in chunking.CHUNK_FIELDS if c not in ('id', 'char_offset', 'text', 'article_text')))}, CAST(coalesce(char_offset, 0) AS INTEGER) AS char_offset, md5(coalesce(text, '')) AS text_md5, md5(coalesce(article_text, '')) AS article_md5 FROM chunks")
def evidence_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks through the evidence CSV writer and its loader."""
    path = job_folder(spark)
    stores.write_csv(table(spark, folder, "chunks").select(*chunking.CHUNK_FIELDS), path)
    back = csv_sources.load_chunks(csv_sources.read_csv(spark, path))
    rest = [c for c in chunking.CHUNK_FIELDS if c not in ("id", "text", "article_text")]
    return back.select(*rest, F.md5("text").alias("text_md5"), F.md5("article_text").alias("article_md5"))


_LATIN = "[\\x{00}-\\x{7f}\\x{a0}-\\x{ff}]*"


@query(f"SELECT coalesce(source, '') AS section, md5(text) AS text_md5 FROM documents WHERE trim(text) <> '' AND regexp_full_match(concat(coalesce(source, ''), text), '(?s){_LATIN}')")
def encoded_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of Latin letters delivered in an eight-bit encoding, told from UTF-8 by their content."""
    path = job_folder(spark)
    d = table(spark, folder, "documents").where("trim(text) <> ''").where(F.concat(F.coalesce("source", F.lit("")), "text").rlike(f"(?s)^{_LATIN}$"))
    stores.write_csv(d.select(F.col("source").alias("section"), F.col("text").alias("recommendation")), path, encoding="iso-8859-1")
    return csv_sources.load_recommendations(csv_sources.read_csv(spark, path)).select("section", F.md5("text").alias("text_md5"))


@query(f"SELECT md5({clean_sql('text')}) AS line_md5, count(*) AS n FROM documents WHERE {clean_sql('text')} <> '' GROUP BY 1")
def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files, a line each, and read as whole files."""
    path = job_folder(spark)
    table(spark, folder, "documents").select(T.clean_text("text").alias("value")).where("value <> ''").write.text(path)
    lines = csv_sources.read_files(spark, path, "*.txt").select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''")
    return lines.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


@query(f"WITH {METRICS_CTE} SELECT dataset, level, model_key, method, k, round(ndcg, 6) AS ndcg, num_queries::DOUBLE AS num_queries FROM metrics")
def metrics_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = job_folder(spark)
    stores.write_csv(_metrics(spark, folder), path)
    return _rounded(csv_sources.read_metrics(spark, path).select(*reporting.KEYS, "ndcg", "num_queries"))


@query(f"WITH {BM25_CTE} SELECT term, df, round(idf, 9) AS idf, (SELECT n_docs FROM stats) AS n_docs, CAST((SELECT sum(tf) FROM post p WHERE p.term = idf.term) AS BIGINT) AS cf FROM idf")
def index_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The lexical index saved and loaded."""
    path = job_folder(spark)
    stores.save_index(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", path)
    index = stores.load_index(spark, path)
    cf = index["postings"].groupBy("term").agg(F.sum("tf").alias("cf"))
    n_docs = index["corpus_stats"].first()["n_docs"]
    return index["term_idf"].join(cf, "term").select("term", "df", F.round("idf", 9).alias("idf"), F.lit(n_docs).alias("n_docs"), "cf")


@query("SELECT count(*) AS n_vectors, CAST(64 AS INTEGER) AS min_dim, CAST(64 AS INTEGER) AS max_dim, true AS probe_ok, count(*) AS n_docs, true AS ok, CAST(1 AS INTEGER) AS made FROM chunks")
def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the chunks stored once and read twice."""
    path, made = job_folder(spark), []

    def make(c: DataFrame) -> DataFrame:
        made.append(1)
        return judging.embed(parallel(c), "chunk_idx", "text", judging.hashing_embedder)

    chunks = table(spark, folder, "chunks").select("chunk_idx", F.coalesce("text", F.lit("")).alias("text"))
    stores.stored_vectors(chunks, "chunk_idx", "text", path, "hashed", make)
    found = stores.stored_vectors(chunks, "chunk_idx", "text", path, "hashed", make)
    return stores.vector_preflight(found, "vector", chunks).withColumn("made", F.lit(len(made)))


@query("SELECT query_id AS query, chunk_idx AS doc FROM (SELECT DISTINCT r.query_id, r.chunk_idx FROM retrieval_results r JOIN recommendations q ON q.query_id = r.query_id WHERE r.scores > 0 AND NOT isnan(r.scores) AND trim(coalesce(q.recommendation, '')) <> '')")
def corpus_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """Queries and relevances of a corpus read from a split folder."""
    path = job_folder(spark)
    r = table(spark, folder, "retrieval_results").where("scores is not null and not isnan(scores)")
    r.select(F.col("query_id").alias("query"), F.col("chunk_idx").alias("doc"), F.col("scores").alias("score")).write.parquet(f"{path}/en/qrels")
    table(spark, folder, "recommendations").select(F.col("query_id").alias("query"), F.coalesce("recommendation", F.lit("")).alias("text")).write.json(f"{path}/queries.json")
    return csv_sources.queries_and_qrels(csv_sources.load_split(spark, path, "en", "queries"), csv_sources.load_split(spark, path, "en", "qrels"))[1]


_OK = {c: f"regexp_replace(coalesce({c}, ''), '^{T.WS}+|{T.WS}+$', '', 'g')" for c in csv_records.COLUMNS}
_BAD = (
    " OR ".join(f"NOT regexp_matches(coalesce({c}, ''), '\\p{{L}}') OR contains(coalesce({c}, ''), chr(65533))" for c in csv_records.TEXTS) + " OR "
    + " OR ".join(f"NOT regexp_full_match({_OK[c]}, '[0-9]*')" for c in csv_records.NUMBERS) + " OR "
    + " OR ".join(f"lower({_OK[c]}) NOT IN ({', '.join(repr(v) for v in sorted(values))})" for c, values in csv_records.VALUES.items())
)


@query(f"SELECT CASE WHEN {_BAD} THEN 'invalid_value' END AS reason, CASE WHEN NOT ({_BAD}) THEN TRY_CAST(nullif({_OK['source_page']}, '') AS BIGINT) END AS source_page, CASE WHEN NOT ({_BAD}) THEN md5(recommendation_text) END AS text_md5 FROM gold")
def delivered_records(spark: SparkSession, folder: str) -> DataFrame:
    """Gold as delivered CSV files, cut into records quote-aware and parsed with reasons."""
    path = job_folder(spark)
    rows = parallel(table(spark, folder, "gold")).select(*csv_records.COLUMNS)
    stores.write_csv(rows, path, separator="|")
    parsed = csv_records.parse_records(csv_sources.read_records(spark, path))
    return parsed.select("reason", "source_page", F.md5("recommendation_text").alias("text_md5"))


# --- HTML and recommendation texts ------------------------------------------------------------


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk as a file in either layout of the journal, with an annex."""
    c = parallel(table(spark, folder, "chunks")).where(F.length(T.clean_text(F.coalesce("text", F.lit("")))) > 15)
    e = {n: _escaped(n) for n in ("chapter", "article", "article_subtitle", "text")}
    parts = (
        '<html><body><div id="cpt_1">\n<p class="title-division-1">', e["chapter"], '</p>\n<div class="eli-subdivision" id="art_1"><p class="title-article-norm">', e["article"],
        '</p><div class="eli-title"><p class="stitle-article-norm">', e["article_subtitle"], '</p></div><div class="norm"><span class="no-parag">7.</span><div class="inline-element">', e["text"],
        '</div></div></div>\n<div class="eli-subdivision" id="art_2"><p class="oj-ti-art">', e["article"], '</p><div class="eli-title"><p class="oj-sti-art">', e["article_subtitle"],
        '</p></div>\n<p class="oj-normal">(3) ', e["text"], '</p></div></div>\n<div id="anx_1">\n<p class="title-annex-1">ANNEX</p>\n<p class="title-annex-2">', e["chapter"], "</p>\n<p>", e["text"], "</p></div></body></html>",
    )
    return c.select(F.format_string("/in/REACH-%d.html", "chunk_idx").alias("path"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("content"))


_E = f"e AS (SELECT 'REACH-' || chunk_idx || '.html' AS source_file, {clean_sql('coalesce(chapter, $$$$)')} AS chapter, {clean_sql('coalesce(article, $$$$)')} AS article, {clean_sql('coalesce(article_subtitle, $$$$)')} AS article_subtitle, {clean_sql('coalesce(text, $$$$)')} AS t FROM chunks WHERE length({clean_sql('coalesce(text, $$$$)')}) > 15)".replace("$$$$", "''")


@query(f"WITH {_E} SELECT source_file, chapter, article, article_subtitle, md5(t) AS article_md5 FROM e UNION SELECT source_file, chapter, article, article_subtitle, md5('(3) ' || t) FROM e")
def html_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with chapter, heading and whole text, in both layouts."""
    c = chunking.chunk_html(_pages(spark, folder)).where("chapter <> 'Annex' or article_text <> ''")
    return c.select("source_file", "chapter", "article", "article_subtitle", F.md5("article_text").alias("article_md5")).distinct()


@query(f"WITH {_E} SELECT source_file, 'REACH' AS document, regexp_replace(source_file, 'REACH-|\\.html', '', 'g') AS version, '7' AS paragraph, md5(t) AS text_md5 FROM e WHERE length(t) <= 2400 OR NOT contains(t, ' ') UNION ALL SELECT source_file, 'REACH', regexp_replace(source_file, 'REACH-|\\.html', '', 'g'), '3', md5('(3) ' || t) FROM e WHERE length(t) <= 2396")
def html_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs that came out uncut, with their numbers."""
    c = chunking.chunk_html(_pages(spark, folder)).where("article_text <> '' and text = article_text")
    return c.select("source_file", "document", "version", "paragraph", F.md5("text").alias("text_md5"))


@query(f"WITH {_E} SELECT source_file, concat_ws(' — ', 'ANNEX', nullif(chapter, '')) AS article, CASE WHEN length(t) > 2000 THEN md5(rtrim(substr(t, 1, 2000)) || ' [...]') ELSE md5(t) END AS text_md5 FROM e")
def html_annexes(spark: SparkSession, folder: str) -> DataFrame:
    """Annexes with their titles, long ones cut with a mark."""
    return chunking.chunk_html(_pages(spark, folder)).where("chapter = 'Annex' and article_text = ''").select("source_file", "article", F.md5("text").alias("text_md5"))


@query(f"SELECT chunk_idx, concat_ws(' — ', nullif({clean_sql('coalesce(document, $$$$)')}, ''), nullif({clean_sql('coalesce(version, $$$$)')}, '')) AS title FROM chunks".replace("$$$$", "''"))
def html_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of documents from their title blocks."""
    content = F.concat(F.lit('<html><body><div class="eli-main-title"><p class="title-doc-first">'), _escaped("document"), F.lit('</p>\n<p class="other">x</p>\n<p class="title-doc-last">'), _escaped("version"), F.lit("</p></div></body></html>"))
    files = parallel(table(spark, folder, "chunks")).select(F.col("chunk_idx").cast("string").alias("path"), content.alias("content"))
    return chunking.titles(files).select(F.col("path").cast("bigint").alias("chunk_idx"), "title")


_LINES = f"l AS (SELECT chunk_idx, {clean_sql('coalesce(document, $$$$)')} AS h, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM web_chunks), n AS (SELECT *, {clean_sql('line')} AS t FROM l)".replace("$$$$", "''")


@query(f"WITH {_LINES} SELECT 'page-' || chunk_idx || '.html' AS source_file, CASE WHEN length(h) >= 4 THEN 'Section: ' || h ELSE 'General' END AS article, CAST(row_number() OVER (PARTITION BY chunk_idx ORDER BY pos) AS VARCHAR) AS paragraph, md5(t) AS text_md5 FROM n WHERE length(t) >= 40")
def html_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Pages marked up with navigation, a heading, paragraphs and items, cut into chunks by the HTML reader."""
    w = parallel(table(spark, folder, "web_chunks"))
    lines = F.transform(F.split(_escaped("text"), "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("<p>"), x, F.lit("</p>"))).otherwise(F.concat(F.lit("<ul><li>"), x, F.lit("</li></ul>"))))
    content = F.concat(F.lit("<html><body><nav><p>"), _escaped("text"), F.lit("</p></nav><main><header><h3>"), _escaped("text"), F.lit("</h3></header><h2>"), _escaped("document"), F.lit('</h2><p class="footnote">'), _escaped("text"), F.lit("</p>"), F.array_join(lines, "\n"), F.lit("</main><footer><p>"), _escaped("text"), F.lit("</p></footer></body></html>"))
    c = chunking.chunk_html(w.select(F.format_string("page-%d.html", "chunk_idx").alias("path"), content.alias("content")))
    return c.select("source_file", "article", "paragraph", F.md5("text").alias("text_md5"))


_R = f"r AS (SELECT query_id, {norm_sql('coalesce(section, $$$$)')} AS s, {norm_sql('coalesce(recommendation, $$$$)')} AS t FROM recommendations WHERE query_id IS NOT NULL)".replace("$$$$", "''")


@query(f"WITH {_R} SELECT 'f' || query_id AS path, rtrim('1.1. Section ' || s) AS section, 'Actions needed' AS subsection, 'Lead' AS title, t AS recommendation FROM r WHERE t <> '' UNION ALL SELECT 'f' || query_id, rtrim('1.1. Section ' || s), 'Best practices', 'A title of these', 'a body that is longer than thirty characters ' || query_id FROM r")
def recommendation_text(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendation files with sections, subsections, titled bullets, comments and sub-bullets."""
    one = lambda c: T.normalize_ws(F.coalesce(c, F.lit("")))
    parts = ("1.1.  Section ", one("section"), "\n\n· Best practices\n•\tA title of these: a body that is longer than\nthirty characters ", F.col("query_id").cast("string"), " -> seen\n\nACTIONS NEEDED\n- Lead:\no ", one("recommendation"), "\n\n* too short\n")
    files = parallel(table(spark, folder, "recommendations")).where("query_id is not null").select(F.concat(F.lit("f"), F.col("query_id").cast("string")).alias("path"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("content"))
    return chunking.chunk_recommendations(files).where("recommendation <> ''")


# --- text ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?]){T.WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL")
def capital_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(T.capital_sentences("text")).alias("n"))


@query("SELECT model_key, CASE WHEN starts_with(model_key, 'e5-') THEN 'passage: ' ELSE '' END || document AS passage, CASE WHEN starts_with(model_key, 'e5-') THEN 'query: ' ELSE '' END || document AS query FROM (SELECT DISTINCT unnest([model_key, 'e5-' || model_key]) AS model_key, document FROM retrieval_results WHERE document IS NOT NULL)")
def model_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "retrieval_results").where("document is not null").select("model_key", "document").distinct()
    r = r.select(F.explode(F.array("model_key", F.concat(F.lit("e5-"), "model_key"))).alias("model_key"), "document")
    plain = r.where("model_key not like 'e5-%'").select("model_key", F.col("document").alias("passage"), F.col("document").alias("query"))
    e5 = r.where("model_key like 'e5-%'").select("model_key", T.with_prefix("document", "e5-base", True).alias("passage"), T.with_prefix("document", "e5-base", False).alias("query"))
    return plain.unionByName(e5)


@query("SELECT doc_id, md5(CASE WHEN len(w) > 42 THEN regexp_extract(text, '^(\\s*(?:[^\\s]+\\s+){41}[^\\s]+)\\s', 1) ELSE text END) AS text_md5 FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)")
def truncated_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The first 42 words, where a model of 50 tokens takes no more."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(T.truncated("text", 50)).alias("text_md5"))


@query("SELECT judge_id, strftime(judged_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS judged_text FROM judge_results WHERE judged_at IS NOT NULL")
def utc_texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "judge_results").where("judged_at is not null").select("judge_id", T.utc_text(F.col("judged_at").cast("timestamp_ntz")).alias("judged_text"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}]') THEN '{judging.CJK_REASONING}' ELSE 'kept' END AS reasoning FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN '判断 ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents)")
def cjk_reasoning(spark: SparkSession, folder: str) -> DataFrame:
    """French texts with Chinese characters in front, as reasoning."""
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("lang") == "fr", F.concat(F.lit("判断 "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    found = judging.english_reasoning("text")
    return d.select("doc_id", F.when(found == judging.CJK_REASONING, found).otherwise("kept").alias("reasoning"))


# --- lexical, sparse and group retrieval ----------------------------------------------------------


@query(
    f"WITH {BM25_CTE}, every AS (SELECT i.item_id, t.doc, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM test_items) i CROSS JOIN tok t LEFT JOIN scored s ON s.item_id = i.item_id AND s.doc = t.doc), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM every) SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 50"
)
def bm25_fill_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty documents of every passage: documents without a shared term follow with score 0."""
    found = lexical.bm25_topk(parallel(table(spark, folder, "documents")), "doc_id", "text", table(spark, folder, "test_items"), "item_id", "text", 50)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", F.round(F.round("score", 9), 6).alias("score"))


GROUP_CTE = f"""
gnames AS (SELECT document, {T.evidence_group_sql('document')} AS g FROM (SELECT DISTINCT document FROM chunks WHERE document IS NOT NULL)),
tok AS (SELECT chunk_idx AS doc, g, {tokens_sql('text')} AS t FROM chunks JOIN gnames USING (document)),
stats AS (SELECT g, count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok GROUP BY g),
post AS (SELECT doc, g, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc, g, t, unnest(t) AS term FROM tok) GROUP BY doc, g, len(t), term),
df AS (SELECT g, term, count(*) AS df FROM post GROUP BY g, term),
raw AS (SELECT g, term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN stats USING (g)),
mean AS (SELECT g, avg(r) AS m FROM raw GROUP BY g),
idf AS (SELECT g, term, CASE WHEN r < 0 THEN {vocab.BM25_EPSILON} * m ELSE r END AS idf FROM raw JOIN mean USING (g)),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM test_items) GROUP BY item_id, term),
scored AS (SELECT item_id, g, doc, sum(times * idf * tf * ({vocab.BM25_K1} + 1) / (tf + {vocab.BM25_K1} * (1 - {vocab.BM25_B} + {vocab.BM25_B} * dl / avgdl))) AS score
  FROM asked JOIN post USING (term) JOIN idf USING (g, term) JOIN stats USING (g) GROUP BY item_id, g, doc)"""


@query(f"WITH {GROUP_CTE} SELECT item_id, g AS evidence_group, doc AS chunk_idx, CAST(floor(score * 1000 + 0.5) AS BIGINT) AS score_milli FROM scored")
def bm25_group_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all matching chunks by the statistics of their evidence group, as a join."""
    c = table(spark, folder, "chunks").where("document is not null")
    names = c.select("document").distinct().withColumn("evidence_group", T.evidence_group("document"))
    found = lexical.bm25_scores(c.join(names, "document"), "chunk_idx", "text", table(spark, folder, "test_items"), "item_id", "text", ["evidence_group"])
    return found.select(F.col("query").alias("item_id"), "evidence_group", F.col("doc").alias("chunk_idx"), F.floor(F.col("score") * 1000 + 0.5).alias("score_milli"))


#: The choice under constraints from ranked candidates: two a document with unlike
#: fingerprints, the first of each group ahead.  The first of a group is the first of its document.
CHOSEN_SQL = f"""
fi AS (SELECT *, first_value(fingerprint) OVER (PARTITION BY query_id, document ORDER BY rank) AS f1, row_number() OVER (PARTITION BY query_id, document ORDER BY rank) AS n, min(rank) OVER (PARTITION BY query_id, evidence_group) AS lead FROM merged),
se AS (SELECT *, row_number() OVER (PARTITION BY query_id, document, fingerprint <> f1 ORDER BY rank) AS m FROM fi),
ch AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <> lead THEN 2 WHEN evidence_group = '{vocab.GROUPS[0]}' THEN 0 ELSE 1 END, rank) AS place FROM se WHERE n = 1 OR (fingerprint <> f1 AND m = 1))
SELECT query_id, chunk_idx, CAST(place AS INTEGER) AS rank FROM ch WHERE place <= {K}"""


@query(f"WITH {SPLIT_CTE}, {CHOSEN_SQL}")
def select_constrained(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage of both groups first, then by score, two chunks a document, no near-duplicates."""
    return ranking.select_constrained(_merged(spark, folder), "query_id", "chunk_idx", K, 2, True)


@query(
    f"WITH {GROUP_CTE}, every AS (SELECT i.item_id AS query_id, t.g AS evidence_group, t.doc AS chunk_idx, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM test_items) i CROSS JOIN tok t LEFT JOIN scored s ON s.item_id = i.item_id AND s.doc = t.doc), "
    f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, evidence_group ORDER BY round(score, 9) DESC, chunk_idx DESC) AS n FROM every) WHERE n <= {2 * K}), "
    f"merged AS (SELECT r.query_id, r.chunk_idx, r.evidence_group, c.document, substr(regexp_replace({norm_sql('lower(coalesce(c.text, $$$$))')}, '[^a-z0-9 ]', '', 'g'), 1, 220) AS fingerprint, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r.chunk_idx DESC) AS rank FROM near r JOIN chunks c USING (chunk_idx)), {CHOSEN_SQL}".replace("$$$$", "''")
)
def split_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 per evidence group with its own statistics, merged and chosen under constraints."""
    chunks = parallel(table(spark, folder, "chunks")).where("document is not null").select("chunk_idx", "document", F.coalesce("text", F.lit("")).alias("text"))
    items = table(spark, folder, "test_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return jobs.split_retrieve(chunks, items, K, 2)


@query(
    """WITH d AS (SELECT vec_id AS doc, i - 1 AS term, CAST(embedding[i] AS DOUBLE) AS w FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE embedding[i] > 0),
s AS (SELECT q.doc AS query, d.doc, sum(q.w * d.w) AS score FROM d q JOIN d ON d.term = q.term WHERE q.doc % 100 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM s) SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def sparse_given_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse vectors with given weights: the positive places of each vector as its terms."""
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc"), F.transform("embedding", lambda x, i: i.cast("string")).alias("terms"), F.col("embedding").cast("array<double>").alias("weights"))
    found = lexical.sparse_topk(e, e.where("doc % 100 = 0").withColumnRenamed("doc", "query"), K)
    return found.select("query", "doc", "rank", F.round(F.round("score", 9), 6).alias("score"))


#: Counts of letters as vectors, a model that SQL has too.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_embedder():
    def embed(texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(x) for x in LETTERS] for t in texts], dtype=np.float32).reshape(len(texts), len(LETTERS))

    return embed


def _vector(c: str) -> str:
    return "[" + ", ".join(f"CAST(length({c}) - length(replace({c}, '{x}', '')) AS DOUBLE)" for x in LETTERS) + "]"


EVERY_CTE = f"""{BM25_CTE},
bevery AS (SELECT i.item_id, t.doc, coalesce(s.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM test_items) i CROSS JOIN tok t LEFT JOIN scored s ON s.item_id = i.item_id AND s.doc = t.doc),
bruns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM bevery) WHERE rank <= 30),
ld AS (SELECT doc_id AS doc, {_vector("lower(coalesce(text, ''))")} AS v FROM documents),
lq AS (SELECT item_id, {_vector("lower(coalesce(text, ''))")} AS v FROM test_items),
ls AS (SELECT item_id, doc, list_sum(list_transform(range(1, 27), lambda i: lq.v[i] * ld.v[i])) AS score FROM lq, ld),
lruns AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM ls) WHERE rank <= 30)"""


def _letter_family(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    chunks = parallel(table(spark, folder, "documents")).select(F.col("doc_id").alias("chunk_idx"), "text")
    models = jobs.Models("letters", lambda: letter_embedder(), lambda: judging.overlap_scorer, lambda: judging.word_sparse_encoder)
    return jobs.retrievers(chunks, models), table(spark, folder, "test_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _method(spark: SparkSession, folder: str, name: str) -> DataFrame:
    family, queries = _letter_family(spark, folder)
    found = family[name](queries, K)
    return found.select(F.col("query_id").alias("item_id"), F.col("chunk_idx").alias("doc_id"), "rank", F.round(F.round("score", 9), 6).alias("score"))


@query(f"WITH {EVERY_CTE} SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, score FROM lruns WHERE rank <= {K}")
def method_dense(spark: SparkSession, folder: str) -> DataFrame:
    """The dense method with counts of letters as vectors."""
    return _method(spark, folder, "dense")


@query(
    f"WITH {EVERY_CTE}, l AS (SELECT item_id, doc, rank, 0 AS l FROM bruns WHERE rank <= {2 * K} UNION ALL SELECT item_id, doc, rank, 1 FROM lruns WHERE rank <= {2 * K}), f AS (SELECT item_id, doc, sum(1.0 / ({vocab.RRF_K} + rank)) AS rrf, min(l * 1000 + rank) AS seen FROM l GROUP BY item_id, doc), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM f) SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(rrf, 6) AS score FROM r WHERE rank <= {K}"
)
def method_rrf(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid method: BM25 with fill and the dense list, fused."""
    return _method(spark, folder, "rrf")


@query(
    f"WITH {EVERY_CTE}, c AS (SELECT r.item_id, r.doc, list_distinct(regexp_extract_all(lower(coalesce(i.text, '')), '[\\p{{L}}\\p{{N}}]+')) AS a, list_distinct(regexp_extract_all(lower(coalesce(d.text, '')), '[\\p{{L}}\\p{{N}}]+')) AS b FROM lruns r JOIN test_items i USING (item_id) JOIN documents d ON d.doc_id = r.doc WHERE r.rank <= {max(2 * K, 30)}), "
    f"s AS (SELECT item_id, doc, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM s) SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= {K}"
)
def method_dense_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Thirty dense candidates rescored by a pair scorer."""
    return _method(spark, folder, "dense_rerank")


@query(
    "WITH d AS (SELECT doc_id AS doc, term, ln(1.0 + count(*)) AS w FROM (SELECT doc_id, unnest(regexp_extract_all('passage: ' || lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL), "
    "q AS (SELECT item_id, term, ln(1.0 + count(*)) AS w FROM (SELECT item_id, unnest(regexp_extract_all('query: ' || lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')) AS term FROM test_items) GROUP BY ALL), "
    f"s AS (SELECT item_id, doc, sum(q.w * d.w) AS score FROM q JOIN d USING (term) GROUP BY item_id, doc), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM s) SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= {K}"
)
def method_splade(spark: SparkSession, folder: str) -> DataFrame:
    """The sparse method with log counts of words as weights."""
    return _method(spark, folder, "splade")


def _unified_sql() -> str:
    return f"WITH {BM25_CTE}, {PASSAGE_RELEVANCE}, {PER_QUERY_CTE.format(q='item_id', by='', runs='hits')}, m AS (SELECT k, {AT_K_SQL} FROM pq GROUP BY k) SELECT 'corpus' AS dataset, 'chunk' AS level, 'model' AS model_key, 'bm25' AS method, k, {ROUND_SQL}, num_queries, CAST(1 AS INTEGER) AS kept FROM m"


@query(_unified_sql())
def unified_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Unified evaluation of BM25 over the documents, run twice: the second run keeps the first's step."""
    blank = {c: F.lit("") for c in ("document", "article", "paragraph")}
    chunks = parallel(table(spark, folder, "documents")).select(F.col("doc_id").alias("chunk_idx"), F.col("doc_id").cast("string").alias("id"), "text").withColumns(blank)
    queries = table(spark, folder, "test_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("").alias("source_snippet_original"))
    corpus = jobs.Collection("corpus", chunks, queries, cut(_passage_relevance(spark, folder)), "chunk")
    out = job_folder(spark)
    jobs.unified_evaluation(spark, out, [corpus], [jobs.Models()])
    metrics = jobs.unified_evaluation(spark, out, [corpus], [jobs.Models()])["metrics_all"]
    kept = json.loads(spark.read.json(f"{out}/run_summary").first()["summary"])["kept"]
    return _rounded(metrics).withColumn("kept", F.lit(len(kept)))


_RERANK = f"c AS (SELECT x.query_id, x.chunk_idx, regexp_extract_all(lower(coalesce(r.recommendation, '')), '[\\p{{L}}\\p{{N}}]+') AS a, regexp_extract_all(lower(coalesce(x.text, '')), '[\\p{{L}}\\p{{N}}]+') AS b FROM x JOIN recommendations r USING (query_id)), s AS (SELECT query_id, chunk_idx, CASE WHEN len(a) > 0 THEN len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(a)) ELSE 0.0 END AS score FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx DESC) AS rank FROM s)"


@query(f"WITH {EXPORT_CTE}, {_RERANK} SELECT query_id, chunk_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= {vocab.RERANK_TOP}")
def rerank_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates rescored by a pluggable pair scorer (here the word-overlap stand-in)."""
    x = _query_runs(spark, folder).join(table(spark, folder, "chunks", ["chunk_idx", "text"]), "chunk_idx").join(table(spark, folder, "recommendations", ["query_id", "recommendation"]), "query_id")
    return _rounded(judging.rerank(x, ["query_id"], "chunk_idx", "recommendation", "text", vocab.RERANK_TOP))


# --- answers ------------------------------------------------------------------------------------------


@query(f"WITH x AS (SELECT judge_id, trim(predicted_label) AS l, trim(reasoning) AS r FROM judge_results) SELECT judge_id, CASE WHEN l <> '' AND r <> '' THEN l ELSE 'PARSE_ERROR' END AS label, CASE WHEN l <> '' AND r <> '' THEN md5(r) END AS justification_md5, CASE WHEN l <> '' AND r <> '' THEN 'a; b' ELSE '' END AS cited FROM x WHERE l IS NOT NULL AND r IS NOT NULL")
def classifier_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Classifier answers put together from columns, fenced and with text around, read back."""
    j = table(spark, folder, "judge_results").where("predicted_label is not null and reasoning is not null")
    answer = F.to_json(F.struct(F.col("predicted_label").alias("label"), F.col("reasoning").alias("justification"), F.array(F.lit("a"), F.lit(" "), F.lit("b")).alias("cited_chunk_ids")))
    raw = F.when(F.length("reasoning") % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(F.concat(F.lit("My answer: "), answer, F.lit(" Done.")))
    c = j.select("judge_id", judging.classifier_fields(raw).alias("c"))
    failed = F.col("c.label") == vocab.PARSE_ERROR
    return c.select("judge_id", F.col("c.label").alias("label"), F.when(~failed, F.md5("c.justification")).alias("justification_md5"), F.array_join("c.cited_chunk_ids", "; ").alias("cited"))


_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(raw_response, ''), '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '', 'g'), '^\\s+|\\s+$', '', 'g'), '^```(?:json)?\\s*', ''), '\\s*```$', '')"
_JUDGE = (
    f"WITH t AS (SELECT judge_id, trim(regexp_replace({_STRIP}, '^\\s+|\\s+$', '', 'g')) AS t FROM judge_results), u AS (SELECT judge_id, t, nullif(regexp_extract(t, '(?s)(\\{{.*\\}})', 1), '') AS e FROM t), "
    "o AS (SELECT *, CASE WHEN json_valid(t) AND json_type(t) = 'OBJECT' THEN t END AS a, CASE WHEN json_valid(e) AND json_type(e) = 'OBJECT' THEN e END AS b FROM u), "
    "s AS (SELECT judge_id, t, "
    + ", ".join(f"CASE WHEN {x} IS NULL OR (TRY_CAST(json_extract_string({x}, '$.{f}') AS DOUBLE) IS NULL AND contains({x}, '\"{f}\"')) THEN NULL ELSE CAST(trunc(coalesce(TRY_CAST(json_extract_string({x}, '$.{f}') AS DOUBLE), 1)) AS INTEGER) END AS {x}{i}" for x in "ab" for i, f in enumerate(judging.SCORES))
    + ", " + ", ".join(f"TRY_CAST(nullif(regexp_extract(t, '\"{f}\"\\s*:\\s*([1-5])', 1), '') AS INTEGER) AS c{i}" for i, f in enumerate(judging.SCORES))
    + ", json_extract_string(a, '$.reasoning') AS ar, json_extract_string(b, '$.reasoning') AS br, regexp_extract(t, '\"reasoning\"\\s*:\\s*\"([^\"]*)\"', 1) AS cr FROM o), "
    "p AS (SELECT *, CASE WHEN a0 + a1 + a2 + a3 IS NOT NULL THEN 1 WHEN b0 + b1 + b2 + b3 IS NOT NULL THEN 2 WHEN coalesce(c0, c1, c2, c3) IS NOT NULL THEN 3 ELSE 4 END AS strategy FROM s), "
    "v AS (SELECT judge_id, strategy, " + ", ".join(f"CASE strategy WHEN 1 THEN a{i} WHEN 2 THEN b{i} WHEN 3 THEN coalesce(c{i}, 1) ELSE 1 END AS {f}" for i, f in enumerate(judging.SCORES))
    + f", CASE strategy WHEN 1 THEN coalesce(ar, '') WHEN 2 THEN coalesce(br, '') WHEN 3 THEN CASE WHEN cr <> '' THEN cr ELSE '{judging.PARTIAL_REASONING}' END ELSE '{judging.NO_REASONING}' END AS reasoning FROM p) "
    "SELECT judge_id, strategy, " + ", ".join(judging.SCORES) + f", CAST(({' + '.join(judging.SCORES)}) / 4.0 AS DOUBLE) AS overall_score, CASE WHEN regexp_matches(reasoning, '[\\x{{4e00}}-\\x{{9fff}}]') THEN '{judging.CJK_REASONING}' ELSE reasoning END AS reasoning FROM v"
)


@query(_JUDGE)
def judge_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and reasoning read from raw answers by four strategies."""
    j = parallel(table(spark, folder, "judge_results")).select("judge_id", judging.judge_fields("raw_response").alias("f"))
    return j.select("judge_id", "f.*").withColumn("reasoning", judging.english_reasoning("reasoning"))


_ENTRY = """e AS (SELECT query_id, rank, '[' || rank || '] id=' || coalesce(id, '') || ' | ' || coalesce(document, '') || ' | ' || coalesce(article, '') || CASE WHEN coalesce(article_subtitle, '') <> '' THEN ' — ' || article_subtitle ELSE '' END
|| CASE WHEN coalesce(paragraph, '') <> '' THEN ' | §' || paragraph ELSE '' END || chr(10) || CASE WHEN length(b) > 600 THEN substr(b, 1, 600) || '…' ELSE b END || chr(10) AS entry FROM (SELECT *, CASE WHEN coalesce(article_text, '') <> '' THEN article_text ELSE coalesce(text, '') END AS b FROM x)),
k AS (SELECT query_id, count(*) AS k, string_agg(entry, chr(10) ORDER BY rank) AS block FROM e GROUP BY query_id)"""


@query(f"WITH {EXPORT_CTE}, {_ENTRY} SELECT query_id, '{judging.DEFAULT_TEMPLATES['classifier'][0]}' AS system_text, md5('Recommendation:' || chr(10) || coalesce(recommendation, '') || chr(10) || chr(10) || 'Evidence (' || k || ' chunks):' || chr(10) || block || chr(10)) AS user_md5 FROM k JOIN recommendations USING (query_id)")
def classifier_messages(spark: SparkSession, folder: str) -> DataFrame:
    x = _query_runs(spark, folder).join(table(spark, folder, "chunks"), "chunk_idx")
    b = judging.evidence_blocks(x, "query_id").join(table(spark, folder, "recommendations"), "query_id")
    m = judging.messages("classifier", {"recommendation": F.col("recommendation"), "k": F.col("n_chunks"), "evidence": F.col("block")})
    return b.select("query_id", m[0]["content"].alias("system_text"), F.md5(m[1]["content"]).alias("user_md5"))


_ENDS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(
    f"WITH {EXPORT_CTE}, p AS (SELECT query_id, list_filter(list_transform(string_split(string_agg(coalesce(id, ''), '; ' ORDER BY rank), ';'), lambda i: trim(i)), lambda i: i <> '') AS ids, "
    "string_agg('[' || coalesce(document, '') || ' | ' || coalesce(article, '') || ']' || chr(10) || substr(coalesce(text, ''), 1, 400), chr(10) || '---' || chr(10) ORDER BY rank) AS texts FROM x GROUP BY query_id), "
    f"t AS (SELECT query_id, ids, list_filter(list_transform(string_split(texts, chr(10) || '---' || chr(10)), lambda s: {_ENDS.format('s')}), lambda s: s <> '') AS t FROM p), "
    "r AS (SELECT query_id, ids, unnest(t) AS text, generate_subscripts(t, 1) AS rank FROM t) "
    "SELECT query_id, CAST(rank AS INTEGER) AS rank, coalesce(ids[rank], 'generated_' || rank) AS chunk_id, trim(regexp_extract(string_split(text, chr(10))[1], '^\\[(.*?)\\s*\\|\\s*(.*?)\\]', 1)) AS document, trim(regexp_extract(string_split(text, chr(10))[1], '^\\[(.*?)\\s*\\|\\s*(.*?)\\]', 2)) AS article FROM r"
)
def rebuild_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Retrieved chunks rebuilt from an exported classification table."""
    x = _query_runs(spark, folder).join(table(spark, folder, "chunks"), "chunk_idx")
    return judging.rebuild_chunks(stores.prompt_export(x, ["query_id"]), "query_id").drop("text")


# --- exports --------------------------------------------------------------------------------------------

_TAIL_SQL = f"CAST(rank AS INTEGER) AS rank, score, id AS chunk_id, document, CASE WHEN document IS NOT NULL THEN {T.document_name_sql('document')} END AS document_canonical, article, paragraph, md5(text) AS text_md5"


def _with_md5(df: DataFrame) -> DataFrame:
    return df.withColumn("text_md5", F.md5("text")).drop("text")


@query(f"WITH {EXPORT_CTE} SELECT 'gold_standard' AS dataset, 'm' AS model_key, 'bm25' AS method, x.query_id AS query_instance_id, {norm_sql('g.recommendation_text')} AS query, coalesce(g.source_snippet_original, '') AS source_snippet_original, {_TAIL_SQL} FROM x JOIN gold g ON g.gold_id = x.query_id")
def gold_export(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "gold").select(F.col("gold_id").alias("query_id"), T.normalize_ws("recommendation_text").alias("query"), F.coalesce("source_snippet_original", F.lit("")).alias("source_snippet_original"))
    return _with_md5(stores.gold_export(_query_runs(spark, folder), q, table(spark, folder, "chunks"), "m", "bm25", K))


@query(
    f"WITH {EXPORT_CTE} SELECT 'whitepaper' AS dataset, 'm' AS model_key, 'bm25' AS method, coalesce(r.section, '') AS section, coalesce(r.subsection, '') AS subsection, coalesce(r.title, '') AS title, "
    f"CASE WHEN trim(coalesce(r.recommendation, '')) <> '' THEN trim(r.recommendation) ELSE trim(concat_ws(' ', coalesce(r.section, ''), coalesce(r.subsection, ''), coalesce(r.title, ''))) END AS query, {_TAIL_SQL} FROM x JOIN recommendations r USING (query_id)"
)
def whitepaper_export(spark: SparkSession, folder: str) -> DataFrame:
    return _with_md5(stores.whitepaper_export(_query_runs(spark, folder), table(spark, folder, "recommendations"), table(spark, folder, "chunks"), "m", "bm25", K))


@query(f"WITH {BM25_CTE} SELECT 'corpus' AS dataset, 'm' AS model_key, 'bm25' AS method, h.item_id AS query_id, i.text AS query, CAST(h.rank AS INTEGER) AS rank, round(h.score, 6) AS score, h.doc AS chunk_id, md5(d.text) AS text_md5 FROM hits h JOIN test_items i USING (item_id) JOIN documents d ON d.doc_id = h.doc WHERE h.rank <= {K}")
def corpus_export(spark: SparkSession, folder: str) -> DataFrame:
    runs = _bm25(spark, folder, 20).select(F.col("item_id").alias("query_id"), F.col("doc").alias("chunk_id"), "rank", F.round(F.round("score", 9), 6).alias("score"))
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = table(spark, folder, "test_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _with_md5(stores.corpus_export(runs, q, docs, "corpus", "m", "bm25", K))


# --- evaluation and reports ---------------------------------------------------------------------------------


@query(f"SELECT {norm_sql('recommendation_text')} AS query, string_agg(DISTINCT {T.document_name_sql('coalesce(doc_short_name, $$$$)')}, '; ' ORDER BY {T.document_name_sql('coalesce(doc_short_name, $$$$)')}) AS relevant_docs FROM gold WHERE {norm_sql('coalesce(recommendation_text, $$$$)')} <> '' GROUP BY 1".replace("$$$$", "''"))
def gold_by_query(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows collapsed by their query alone."""
    g = table(spark, folder, "gold").select(T.normalize_ws(F.coalesce("recommendation_text", F.lit(""))).alias("query"), F.coalesce("doc_short_name", F.lit("")).alias("name")).where("query <> ''")
    names = g.select("name").distinct().withColumn("doc", T.document_name("name"))
    return g.join(names, "name").groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("doc")), "; ").alias("relevant_docs"))


JOB_CTE = DOCS_CTE.split("rel AS (", 1)[0] + f"rel AS (SELECT DISTINCT gold_id AS query_id, {T.document_name_sql('doc_short_name')} AS doc FROM gold WHERE trim(coalesce(doc_short_name, '')) <> '')"


def _job(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    gold = table(spark, folder, "gold").where("trim(coalesce(doc_short_name, '')) <> ''").select(F.col("gold_id").alias("query_id"), "doc_short_name")
    return jobs.robustness(_runs(spark, folder, 1 << 30), table(spark, folder, "chunks").where("document is not null"), gold)


def _pq(rest: str) -> str:
    return f"WITH {JOB_CTE}, {PER_QUERY_CTE.format(q='query_id', by='model_key, method,', runs='druns')}{rest}"


@query(_pq(", m AS (SELECT model_key, method, k, avg(hit) AS hit_rate, avg(ndcg) AS ndcg, count(*) AS num_queries FROM pq GROUP BY ALL) SELECT 'gold' AS dataset, 'document' AS level, model_key, method, k, round(hit_rate, 6) AS hit_rate, round(ndcg, 6) AS ndcg, num_queries FROM m"))
def evaluation_job(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of the evaluation job."""
    return _rounded(_job(spark, folder)["metrics"].select(*reporting.KEYS, "hit_rate", "ndcg", "num_queries"))


@query(_pq(" SELECT model_key, method, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, CASE WHEN count(first_rank) = count(*) THEN round(avg(first_rank), 6) ELSE 'inf'::DOUBLE END AS first_rank FROM pq WHERE k = 10 GROUP BY 1, 2"))
def method_means(spark: SparkSession, folder: str) -> DataFrame:
    """Means per method, an infinite rank among them making the mean infinite."""
    m = _job(spark, folder)["means"]
    return m.select(*SYSTEM, *(F.round(F.round(c, 9), 6).alias(c) for c in ("hit", "mrr", "ndcg", "first_rank")))


@query(
    f"WITH {DOCS_CTE}, nrel AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1), g AS (SELECT r.model_key, r.method, r.query_id, max(n_rel) AS n_rel, count(x.doc) FILTER (r.rank <= 3) AS near, count(x.doc) FILTER (r.rank <= 20) AS far "
    "FROM druns r JOIN nrel USING (query_id) LEFT JOIN rel x ON x.query_id = r.query_id AND x.doc = r.doc GROUP BY 1, 2, 3) SELECT model_key, method, query_id, CASE WHEN far > 0 THEN 'late_hit' ELSE 'complete_miss' END AS category FROM g WHERE near = 0"
)
def negative_cases(spark: SparkSession, folder: str) -> DataFrame:
    c = ir_metrics.error_categories(_document_runs(spark, folder), _gold_relevance(spark, folder), SYSTEM, 3)
    return reporting.negative_cases(c).withColumnRenamed("query", "query_id")


@query(f"SELECT document, arg_min(source_file, chunk_idx) AS source_file, arg_min(version, chunk_idx) AS version, arg_min(article_subtitle, chunk_idx) AS article_subtitle, min(chunk_idx) AS chunk_idx FROM chunks WHERE document IS NOT NULL GROUP BY document")
def first_filled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Of each column the first value of a document that is not null."""
    c = table(spark, folder, "chunks").where("document is not null").select("document", "source_file", "version", "article_subtitle", "chunk_idx")
    return reporting.first_filled_rows(c, ["document"], [F.col("chunk_idx")])


LONG_CTE = f"{METRICS_CTE}, long AS (SELECT dataset, level, method, k, model_key, unnest(['hit_rate', 'mrr', 'ndcg']) AS metric, unnest([hit_rate, mrr, ndcg]) AS value FROM metrics WHERE k = 10), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, level, method, k, metric ORDER BY round(value, 9) DESC, model_key) AS n FROM long), b AS (SELECT a.*, z.model_key AS second_model_key, a.value - z.value AS gap FROM r a JOIN r z ON z.method = a.method AND z.metric = a.metric AND z.n = 2 WHERE a.n = 1)"


@query(f"WITH {LONG_CTE} SELECT 'gold | document | ' || method || ' | ' || metric || ': ' || model_key || ' leads ' || second_model_key || ' by ' || printf('%.4f', round(round(gap, 9), 4)) AS line, round(gap, 6) AS gap FROM b ORDER BY round(gap, 9) DESC, method, metric LIMIT 6")
def gap_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The report's six largest gaps between models."""
    return _rounded(reporting.gap_lines(reporting.comparison(_metrics(spark, folder).where("k = 10"))))


@query(f"WITH {METRICS_CTE}, r AS (SELECT *, row_number() OVER (ORDER BY round(ndcg, 9) DESC, model_key, method) AS n FROM metrics WHERE k = 10) SELECT dataset, level, dataset || ' | ' || level || ': ' || model_key || ' + ' || method || ' (NDCG ' || printf('%.4f', round(round(ndcg, 9), 4)) || ', MRR ' || printf('%.4f', round(round(mrr, 9), 4)) || ', hit rate ' || printf('%.4f', round(round(hit_rate, 9), 4)) || ')' AS line FROM r WHERE n = 1")
def top_lines(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.top_lines(_metrics(spark, folder).where("k = 10"))


_CELL = "lpad(coalesce(printf('%.3f', round(round(max(CASE WHEN model_key = '{m}' THEN {v} END), 9), 3)), '-'), {n}, ' ')"


@query(
    f"WITH {METRICS_CTE} SELECT CAST(coalesce(list_position(['bm25', 'dense', 'rrf', 'bm25_rerank', 'dense_rerank', 'rrf_rerank'], method), 7) AS BIGINT) AS position, rpad(method, 16, ' ') || '  ' || "
    + " || '  ' || ".join(_CELL.format(m=m, v=v, n=len(f"{v}__{m}")) for v in ("hit_rate", "mrr", "ndcg") for m in MODELS)
    + " AS line FROM metrics WHERE k = 10 GROUP BY method UNION ALL SELECT -2, '" + "  ".join(["method".ljust(16), *(f"{v}__{m}" for v in ("hit_rate", "mrr", "ndcg") for m in MODELS)]) + "' UNION ALL SELECT -1, '" + "best order".ljust(16) + "  NDCG 1.000'"
)
def ablation_report(spark: SparkSession, folder: str) -> DataFrame:
    pivot = reporting.ablation_pivot(_metrics(spark, folder).where("k = 10"), MODELS)
    return reporting.ablation_report(pivot, MODELS, baselines=[("best order", 1.0)])


@query(
    f"WITH {METRICS_CTE}, s AS (SELECT model_key, method, avg(ndcg) AS v FROM pq WHERE k = 10 GROUP BY 1, 2), t AS (SELECT a.model_key, a.method, round(abs(a.v - b.v), 9) / 2 AS p FROM s a JOIN s b ON b.model_key = a.model_key AND b.method = 'bm25' WHERE a.method <> 'bm25') "
    "SELECT s.model_key, s.method, printf('%.3f', round(round(v, 9), 3)) || CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS cell FROM s LEFT JOIN t ON t.model_key = s.model_key AND t.method = s.method"
)
def starred_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Means with the marks of given p-values against the baseline (half the difference stands in for a p-value)."""
    means = _scores(spark, folder).where("k = 10").groupBy(*SYSTEM).agg(F.avg("ndcg").alias("ndcg"))
    base = means.where("method = 'bm25'").select("model_key", F.lit("bm25").alias("method_b"), F.col("ndcg").alias("b"))
    tests = means.where("method <> 'bm25'").join(base, "model_key").select("model_key", F.col("method").alias("method_a"), "method_b", (F.round(F.abs(F.col("ndcg") - F.col("b")), 9) / 2).alias("p_value"))
    return reporting.starred(means, tests, "ndcg")


@query("SELECT model_key, count(*) AS n FROM retrieval_results WHERE model_key IN ('encoder_base', 'encoder_small') GROUP BY 1")
def known_models(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = reporting.known_models(table(spark, folder, "retrieval_results"), ["encoder_base", "encoder_small", "encoder_other"])
    return found.groupBy("model_key").agg(F.count("*").alias("n"))


_BOTH = "(SELECT g.alignment_label AS human_label, j.predicted_label AS alignment_label FROM judge_results j JOIN gold g ON g.gold_id = j.judge_id)"


def _study(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold").select(F.col("gold_id").alias("judge_id"), F.col("alignment_label").alias("human_label"))
    j = table(spark, folder, "judge_results").select("judge_id", F.col("predicted_label").alias("alignment_label"), F.col("reasoning").alias("justification"), F.lit("a; ;b").alias("cited_chunk_ids"))
    return j.join(g, "judge_id")


@query(f"SELECT round(avg(CASE WHEN human_label = alignment_label THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM {_BOTH} WHERE trim(coalesce(human_label, '')) <> '' AND trim(coalesce(alignment_label, '')) <> '' AND human_label IN {LABEL_SQL} AND alignment_label IN {LABEL_SQL}")
def human_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of labels where both are given."""
    return _rounded(jobs.prompt_study(_study(spark, folder))["agreement"].select("accuracy", "n"))


@query("SELECT count(*) FILTER (trim(coalesce(predicted_label, '')) <> '') AS alignment_label, count(*) FILTER (trim(coalesce(reasoning, '')) <> '') AS justification, count(*) AS cited_chunk_ids, count(*) FILTER (trim(coalesce(g.alignment_label, '')) <> '') AS human_label FROM judge_results j JOIN gold g ON g.gold_id = j.judge_id")
def filled_counts(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.prompt_study(_study(spark, folder))["filled"]


_MISSING = "SELECT unnest(list_filter(['dataset', 'level', 'model_key', 'method', 'k'], lambda x: NOT list_contains(['query_id', 'model_key', 'method', 'scores'], x))) AS missing"


@query(_MISSING)
def missing_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Columns that a metrics table must have and the results lack."""
    have = table(spark, folder, "retrieval_results").columns
    return spark.range(1).select(F.explode(F.array_except(F.array(*map(F.lit, reporting.KEYS)), F.array(*map(F.lit, have)))).alias("missing"))


@query(f"WITH {PASSAGE_RELEVANCE} SELECT item_id, doc AS doc_id FROM rel")
def passage_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a held-out passage verbatim."""
    return _passage_relevance(spark, folder).toDF("item_id", "doc_id")


@query(
    "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM e) "
    "SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM s GROUP BY user_id, s"
)
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = streams.sessions(table(spark, folder, "events"))
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "ended")})


@query(f"WITH {RUNS_CTE} SELECT query_id, chunk_idx, max(scores) AS score FROM retrieval_results WHERE scores IS NOT NULL AND NOT isnan(scores) GROUP BY ALL")
def best_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming form of the best score of query and chunk, run as a batch."""
    return streams.best_scores(table(spark, folder, "retrieval_results"))

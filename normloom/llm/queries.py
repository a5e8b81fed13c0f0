"""The queries of this package over the project's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import fold_dedup, leak, mix, near_dup, page_body, pair_defects, spam, split_tree, topn
from normloom.tables import cut, parallel, table

Query = Callable[[SparkSession, str], DataFrame]

# --- 1: splitting oversized values -------------------------------------------

PIECE_LIMIT, PIECE_OVERLAP = 2400, 320


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_tree.split_oversized(parallel(table(spark, folder, "chunks")), "chunk_idx", ["text", "article_text", "paragraph"], PIECE_LIMIT, PIECE_OVERLAP)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values of chunks that are over the budget."""
    return _pieces(spark, folder).where("piece_no = 1").select(F.col("id").alias("chunk_idx"), "field")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves."""
    return _pieces(spark, folder).withColumnRenamed("id", "chunk_idx")


def p1_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per value: whether limit and overlaps hold, and the text its pieces give back."""
    sound = (F.length("text") <= PIECE_LIMIT) & (F.col("overlap").between(0, PIECE_OVERLAP)) & (F.length("text") > F.col("overlap"))
    rows = F.array_sort(F.collect_list(F.struct("piece_no", "start", "overlap", "text")))
    g = _pieces(spark, folder).groupBy(F.col("id").alias("chunk_idx"), "field").agg(F.bool_and(sound).alias("sound"), rows.alias("p"))
    own = lambda x: F.substr(x["text"], x["overlap"] + 1)
    gap = lambda t, x: F.when(x["start"] + x["overlap"] > F.length(t), F.lit(" ")).otherwise(F.lit(""))
    whole = F.aggregate("p", F.lit(""), lambda t, x: F.concat(t, gap(t, x), own(x)))
    return g.select("chunk_idx", "field", "sound", F.md5(whole).alias("text_md5"))


P1_CTE = """
WITH v AS (
  SELECT chunk_idx, 'text' AS field, text AS value FROM chunks
  UNION ALL SELECT chunk_idx, 'article_text', article_text FROM chunks
  UNION ALL SELECT chunk_idx, 'paragraph', paragraph FROM chunks),
m AS (SELECT chunk_idx, field, regexp_replace(regexp_replace(value, '[▼►◄▲][A-ZÀ-ÖØ-Þ0-9]+([^\\p{L}\\p{N}]|$)', '\\1', 'g'), '[▼►◄▲][A-ZÀ-ÖØ-Þ0-9]+([^\\p{L}\\p{N}]|$)', '\\1', 'g') AS value
  FROM v WHERE length(value) > 2400),
c AS (SELECT chunk_idx, field, trim(regexp_replace(value, '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}\\x{0c}]+', ' ', 'g')) AS value FROM m)
"""
P1_SQL = P1_CTE + "SELECT chunk_idx, field FROM c WHERE length(value) > 2400"

# --- 2: top N per group -----------------------------------------------------


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks of every query."""
    return p2_ranked(spark, folder, "query_id", "chunk_idx")


def p2_ranked(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The ten best chunks of every query with their scores."""
    found = topn.top_n(parallel(table(spark, folder, "retrieval_results")), "query_id", "chunk_idx", "scores", 10)
    return found.select(*columns) if columns else found


P2_SQL = """
WITH best AS (
  SELECT query_id, chunk_idx, max(scores + 0.0) AS scores FROM retrieval_results
  WHERE scores IS NOT NULL AND NOT isnan(scores) AND query_id IS NOT NULL AND chunk_idx IS NOT NULL
  GROUP BY query_id, chunk_idx)
SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY scores DESC, chunk_idx) AS place FROM best)
WHERE place <= 10"""

# --- 4: broken pairs -----------------------------------------------------------


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Judge answers that are unusable, each with its defect."""
    languages = pair_defects.fit_languages(table(spark, folder, "documents"), "doc_id", "text", "lang")
    found = pair_defects.pair_defects(parallel(table(spark, folder, "judge_results")), "judge_id", "prompt", "raw_response", languages)
    return found.where("defect is not null").select(F.col("id").alias("judge_id"), "defect")


# --- 5: page boilerplate ---------------------------------------------------------


def _site():
    """A page's site: what its file name begins with."""
    return F.substring_index("source_file", "/", 1)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each page that belong to the site's frame."""
    return page_body.page_lines(parallel(table(spark, folder, "web_chunks")), "chunk_idx", "text", _site()).where("is_frame").select("chunk_idx", "line_no")


def p5_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """The body of each page."""
    return page_body.page_bodies(parallel(table(spark, folder, "web_chunks")), "chunk_idx", "text", _site())


# --- 6: near-duplicates -----------------------------------------------------


def _near(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_dup.near_duplicates(parallel(table(spark, folder, "chunks")), "chunk_idx", "text", 0.7, 3, clean=True)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with similarity 0.7 or more on runs of three words."""
    return near_dup.all_links(*_near(spark, folder)).toDF("chunk_idx_a", "chunk_idx_b")


def p6_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's class of equal sets and that class's number of links; no pairs within a class."""
    return near_dup.linked_classes(*_near(spark, folder)).withColumnRenamed("id", "chunk_idx")


def p6_class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The linked pairs of classes with their similarity."""
    return _near(spark, folder)[1].select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


# the sets as SQL: words of the lower-cased text without marks, runs of three
P6_CTE = """
w AS (SELECT chunk_idx, regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce(text, ''), '[▼►◄▲][A-ZÀ-ÖØ-Þ0-9]+([^\\p{L}\\p{N}]|$)', '\\1', 'g'), '[▼►◄▲][A-ZÀ-ÖØ-Þ0-9]+([^\\p{L}\\p{N}]|$)', '\\1', 'g')), '[\\p{L}\\p{N}]+') AS w FROM chunks WHERE chunk_idx IS NOT NULL),
s AS (SELECT chunk_idx, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 3),
c AS (SELECT s, min(chunk_idx) AS class_id, len(s) AS n FROM s GROUP BY s),
g AS (SELECT class_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n FROM g a JOIN g b ON a.g = b.g AND a.class_id < b.class_id GROUP BY 1, 2),
l AS (SELECT a, b, shared / (m + n - shared) AS similarity FROM p WHERE shared >= 0.7 * (m + n - shared) - 1e-9),
m AS (SELECT s.chunk_idx, c.class_id FROM s JOIN c USING (s))"""
P6_SQL = {
    "p6_found": "SELECT least(x.chunk_idx, y.chunk_idx) AS chunk_idx_a, greatest(x.chunk_idx, y.chunk_idx) AS chunk_idx_b FROM l JOIN m x ON x.class_id = l.a JOIN m y ON y.class_id = l.b "
    "UNION ALL SELECT x.chunk_idx, y.chunk_idx FROM m x JOIN m y ON x.class_id = y.class_id AND x.chunk_idx < y.chunk_idx",
    "p6_classes": "SELECT chunk_idx, class_id, (SELECT count(*) FROM l WHERE l.a = m.class_id OR l.b = m.class_id) AS links FROM m",
    "p6_class_pairs": "SELECT a AS class_a, b AS class_b, round(similarity, 6) AS similarity FROM l",
}


# --- 7: copies hidden by formatting ----------------------------------------------


def _copies(spark: SparkSession, folder: str) -> fold_dedup.Copies:
    return fold_dedup.folded_copies(parallel(table(spark, folder, "gold")), "gold_id", "recommendation_text", "source_snippet_original")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each annotation that is a copy, with the one that is kept."""
    return _copies(spark, folder).groups.where("id <> keep_id").select("keep_id", F.col("id").alias("gold_id"))


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per distinct annotation with its number of copies."""
    return _copies(spark, folder).records


P7_SQL = """
WITH f AS (
  SELECT gold_id, regexp_replace(lower(coalesce(recommendation_text, '')), '[^\\p{L}\\p{N}]+', '', 'g') AS a,
         regexp_replace(lower(coalesce(source_snippet_original, '')), '[^\\p{L}\\p{N}]+', '', 'g') AS b FROM gold WHERE gold_id IS NOT NULL),
g AS (SELECT gold_id, min(gold_id) OVER (PARTITION BY least(a, b), greatest(a, b)) AS keep_id FROM f)
"""

# --- 8: leaks of evaluation texts -------------------------------------------


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(parallel(table(spark, folder, "documents")), "doc_id", "text", table(spark, folder, "test_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items that share twelve consecutive words or more."""
    return _leaks(spark, folder).where("run >= 12").select("doc_id", "item_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the items it gives away, wholly or partly: twelve words in
    a row, or half the item with at most two substituted words."""
    found = _leaks(spark, folder).where("run >= 12 or (overlap >= 12 and 2 * overlap >= item_words)")
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.max("run").alias("longest_run"), F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), " ").alias("items")
    )


P8_SQL = """
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
v AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM test_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
a AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM w WHERE len(w) >= 12),
b AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM v WHERE len(w) >= 12)
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM a JOIN b USING (g)"""

# --- 9: mixing sources -------------------------------------------------------------


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that stay below their target, sizes in pieces between white space."""
    sizes = mix.sized(parallel(table(spark, folder, "documents")), "doc_id", "source", "text")
    plan = mix.plan_mix(sizes, table(spark, folder, "mix_targets"))
    return spark.createDataFrame([(q.source,) for q in plan.quotas if q.below], "source string")


def _mix(spark: SparkSession, folder: str, tokenizer: str = mix.TOKENIZER) -> tuple:
    return mix.mix(parallel(table(spark, folder, "documents")), "doc_id", "source", "text", table(spark, folder, "mix_targets"), tokenizer, prepare=cut)


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source, sizes in tokens of a public tokenizer."""
    return _mix(spark, folder)[2]


def p9_selected(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix and how often each is taken."""
    return _mix(spark, folder)[1].select(F.col("id").alias("doc_id"), "source", "tokens", "repeats")


P9_SQL = """
WITH s AS (SELECT source, coalesce(length(regexp_replace(regexp_replace(text, '[^\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}\\x{0b}]+', 'x', 'g'), '[^x]+', '', 'g')), 0) AS n FROM documents),
z AS (SELECT source, sum(n) AS size FROM s WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT source, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 1)) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY source)
SELECT t.source FROM t LEFT JOIN z USING (source)
WHERE t.cap * coalesce(z.size, 0) < t.share * (SELECT sum(n) FROM s)"""

# --- 10: keyword-stuffed and link-list pages ---------------------------------


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are no prose but made for search engines."""
    return spam.keyword_spam(parallel(table(spark, folder, "documents")), "doc_id", "text").where("is_spam").select("doc_id")


def queries() -> dict[str, Query]:
    names = (
        p1_found, p1_pieces, p1_roundtrip, p2_found, p2_ranked, p4_found, p5_found, p5_bodies, p6_found, p6_classes, p6_class_pairs,
        p7_found, p7_records, p8_found, p8_report, p9_found, p9_report, p9_selected, p10_found,
    )
    return {q.__name__: q for q in names}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p1_roundtrip": P1_CTE + "SELECT chunk_idx, field, true AS sound, md5(value) AS text_md5 FROM c WHERE length(value) > 2400",
        "p2_found": P2_SQL.format(columns="query_id, chunk_idx"),
        "p2_ranked": P2_SQL.format(columns="query_id, chunk_idx, scores"),
        **{name: f"WITH {P6_CTE} {sql}" for name, sql in P6_SQL.items()},
        "p7_found": P7_SQL + "SELECT keep_id, gold_id FROM g WHERE gold_id <> keep_id",
        "p7_records": P7_SQL + "SELECT keep_id, count(*) AS copies FROM g GROUP BY keep_id",
        "p8_found": P8_SQL,
        "p9_found": P9_SQL,
    }

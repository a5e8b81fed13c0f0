"""The registered queries of the core over the project's tables, and their SQL.

Roles: documents and chunks are corpora; test_items and recommendations are queries;
retrieval_results holds the runs of many systems; relevance comes from verbatim
passages (test_items in documents) or from gold (document names by query id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normloom.functions import stem, vocab
from normloom.functions import text as T
from normloom.operators import chunking, classification, ir_metrics, judging, lexical, passages, ranking, reporting, statistics, vectors
from normloom.sources import csv_records, csv_sources, stores
from normloom.streaming import events as streams
from normloom.tables import cut, kept, parallel, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = _steady(sql)
        return f

    return register


def _steady(sql: str) -> str:
    """round(x, 6) becomes round(round(x, 9), 6): two engines may differ in a mean's last
    digit, which must not decide a half."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        body = _steady(inner)
        out += sql[i:j] + (f"round(round({body.removesuffix(', 6')}, 9), 6)" if inner.endswith(", 6") else f"round({body})")
        i = k
    return out + sql[i:]


def queries() -> dict[str, Query]:
    from normloom.plans import details  # registers its queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from normloom.plans import details  # noqa: F401

    return dict(_SQL)


WS = T.WS
TOKENS_SQL = (
    "list_filter(list_transform(regexp_split_to_array(lower(coalesce({c}, '')), '" + WS + "+'), "
    "lambda x: regexp_replace(x, '^" + T.EDGE.replace("'", "''") + "+|" + T.EDGE.replace("'", "''") + "+$', '', 'g')), lambda x: length(x) >= 2)"
)
MARK_RULE = r"[▼►◄▲][\p{Lu}\p{Nd}]+([^\p{L}\p{N}]|$)"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def clean_sql(c: str) -> str:
    once = f"regexp_replace({c}, '{MARK_RULE}', '\\1', 'g')"  # twice, for marks side by side
    return norm_sql(f"regexp_replace({once}, '{MARK_RULE}', '\\1', 'g')")


def tokens_sql(c: str) -> str:
    return TOKENS_SQL.replace("{c}", c)


# --- text functions ------------------------------------------------------------------


@query(f"SELECT chunk_idx, CAST(length({clean_sql('text')}) AS INTEGER) AS clean_len, md5({clean_sql('text')}) AS clean_md5 FROM chunks")
def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    c = T.clean_text("text")
    return table(spark, folder, "chunks").select("chunk_idx", F.length(c).alias("clean_len"), F.md5(c).alias("clean_md5"))


@query("SELECT chunk_idx, coalesce(document, '') || '|' || coalesce(article, '') || '|' || coalesce(paragraph, '') || '|' || substr(sha256(coalesce(text, '')), 1, 8) AS made_id FROM chunks")
def chunk_id_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_idx", T.chunk_id("document", "article", "paragraph", "text").alias("made_id"))


@query(f"SELECT doc_id, CAST(len(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))) AS INTEGER) AS n_sentences FROM documents WHERE text IS NOT NULL")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(T.sentences("text")).alias("n_sentences"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_counts(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", T.tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT gold_id, {T.document_name_sql('doc_short_name')} AS canonical, {T.evidence_group_sql('doc_short_name')} AS evidence_group FROM gold WHERE doc_short_name IS NOT NULL")
def document_names(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold").where("doc_short_name is not null")
    return g.select("gold_id", T.document_name("doc_short_name").alias("canonical"), T.evidence_group("doc_short_name").alias("evidence_group"))


@query(
    "SELECT chunk_idx, CASE WHEN contains(upper(s), 'ESPR') THEN 'ESPR' WHEN contains(upper(s), 'REACH') THEN 'REACH' WHEN contains(upper(s), 'ROHS') THEN 'RoHS' WHEN contains(upper(s), 'WEE') THEN 'WEEE' "
    "WHEN contains(upper(s), 'CAEP') THEN 'CAEP' ELSE trim(split_part(upper(s), '-', 1)) END AS short_name, CASE WHEN contains(s, '-') THEN substr(s, strpos(s, '-') + 1) ELSE '' END AS file_version "
    "FROM (SELECT chunk_idx, regexp_replace(list_extract(string_split(source_file, '/'), -1), '\\.[^.]*$', '') AS s FROM chunks WHERE source_file IS NOT NULL)"
)
def file_names(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").where("source_file is not null")
    return c.select("chunk_idx", T.file_short_name("source_file").alias("short_name"), T.file_version("source_file").alias("file_version"))


@query(f"SELECT substr(regexp_replace({norm_sql('lower(text)')}, '[^a-z0-9 ]', '', 'g'), 1, 220) AS fingerprint, count(*) AS n FROM chunks WHERE text IS NOT NULL GROUP BY 1")
def near_dup_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").where("text is not null").groupBy(T.fingerprint("text").alias("fingerprint")).agg(F.count("*").alias("n"))


@query(
    "SELECT query_id, CASE WHEN trim(coalesce(recommendation, '')) <> '' THEN recommendation WHEN trim(concat_ws(' ', section, subsection, title)) <> '' THEN concat_ws(' ', section, subsection, title) ELSE '' END AS query_text, "
    "regexp_extract(section, '^([0-9]+\\.[0-9]+)\\.\\s*(.+)', 1) AS section_no, regexp_replace(section, '[^A-Za-z0-9._-]+', '_', 'g') AS safe_name FROM recommendations"
)
def text_fallback(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "recommendations")
    return r.select(
        "query_id",
        T.first_filled("recommendation", F.concat_ws(" ", "section", "subsection", "title")).alias("query_text"),
        F.regexp_extract("section", r"^([0-9]+\.[0-9]+)\.\s*(.+)", 1).alias("section_no"),
        T.safe_file_name("section").alias("safe_name"),
    )


@query("SELECT CAST(1200 AS INTEGER) AS token_limit, max(n) AS max_tokens, avg(n) AS mean_tokens, count(*) FILTER (n > 1200) AS n_over, avg(CASE WHEN n > 1200 THEN 100.0 ELSE 0 END) AS pct_over FROM (SELECT CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '" + WS + "+'), lambda x: x <> '')) AS INTEGER) AS n FROM documents)")
def token_length_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.token_lengths(table(spark, folder, "documents"), "text", 1200)


# --- sources -----------------------------------------------------------------------------


@query(
    "SELECT id, chunk_idx FROM (SELECT id, chunk_idx, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN version IS NULL THEN 1 ELSE 0 END, chunk_idx) AS n FROM chunks WHERE id IS NOT NULL AND trim(id) <> '') WHERE n = 1"
)
def merge_first_id(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries, chunks with a version and those without: the first table wins."""
    c = table(spark, folder, "chunks").where("id is not null and trim(id) <> ''")
    return csv_sources.merge_chunks([c.where("version is not null"), c.where("version is null")], "chunk_idx").select("id", "chunk_idx")


@query("SELECT coalesce(id, '') AS id, coalesce(document, '') AS document, coalesce(article_text, '') AS article_text, CAST(coalesce(char_offset, 0) AS INTEGER) AS char_offset FROM chunks WHERE id IS NOT NULL AND trim(id) <> ''")
def chunk_defaults(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks").where("id is not null and trim(id) <> ''").withColumn("char_offset", F.col("char_offset").cast("string"))
    return csv_sources.load_chunks(c).select("id", "document", "article_text", "char_offset")


# a record's delimiter d, its fields by the grammar of the format, and its failure
P3_CTE = r"""
h AS (SELECT file_name, arg_min(raw, record_id) AS header FROM gold_raw WHERE record_no = 1 GROUP BY file_name),
n AS (SELECT g.*, coalesce(g.raw, '') AS r, coalesce(h.header, '') AS header FROM gold_raw g LEFT JOIN h ON h.file_name IS NOT DISTINCT FROM g.file_name WHERE g.record_no IS NULL OR g.record_no <> 1),
d AS (SELECT *, CASE WHEN greatest(len(string_split(header, ',')), len(string_split(header, ';')), len(string_split(header, chr(9))), len(string_split(header, '|'))) > 1
    THEN list_extract([',', ';', chr(9), '|'], list_position([len(string_split(header, ',')), len(string_split(header, ';')), len(string_split(header, chr(9))), len(string_split(header, '|'))],
      greatest(len(string_split(header, ',')), len(string_split(header, ';')), len(string_split(header, chr(9))), len(string_split(header, '|')))))
    ELSE coalesce(list_extract(list_filter([',', ';', chr(9), '|'], lambda x: len(string_split(r, x)) = 15), 1), ',') END AS d FROM n),
w AS (SELECT *, CASE d WHEN ',' THEN regexp_full_match(r, '("([^"]|"")*"|[^",\n\r]*)(,("([^"]|"")*"|[^",\n\r]*))*') WHEN ';' THEN regexp_full_match(r, '("([^"]|"")*"|[^";\n\r]*)(;("([^"]|"")*"|[^";\n\r]*))*')
    WHEN '|' THEN regexp_full_match(r, '("([^"]|"")*"|[^"|\n\r]*)([|]("([^"]|"")*"|[^"|\n\r]*))*') ELSE regexp_full_match(r, '("([^"]|"")*"|[^"\t\n\r]*)(\t("([^"]|"")*"|[^"\t\n\r]*))*') END AS good FROM d),
f AS (SELECT *, CASE WHEN good THEN list_transform(regexp_extract_all(d || r, CASE d WHEN ',' THEN ',("(?:[^"]|"")*"|[^",\n\r]*)' WHEN ';' THEN ';("(?:[^"]|"")*"|[^";\n\r]*)' WHEN '|' THEN '[|]("(?:[^"]|"")*"|[^"|\n\r]*)' ELSE '\t("(?:[^"]|"")*"|[^"\t\n\r]*)' END, 1),
    lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM w),
v AS (SELECT record_id, f, CASE WHEN NOT good THEN 'quoting' WHEN len(f) <> 15 THEN 'column_count'
    WHEN NOT regexp_matches(f[4], '\p{L}') OR contains(f[4], chr(65533)) OR NOT regexp_matches(f[7], '\p{L}') OR contains(f[7], chr(65533)) OR NOT regexp_full_match({page}, '[0-9]*') OR NOT regexp_full_match({line}, '[0-9]*')
      OR lower({kind}) NOT IN ('recommendation', 'statement') OR lower({basis}) NOT IN ('explicit_mention', 'citation_mapping') OR lower({review}) NOT IN ('yes', 'no', '')
      OR lower({label}) NOT IN ('', 'aligned', 'conditional', 'conflicting', 'no explicit legal basis', 'beyond compliance') THEN 'invalid_value' END AS reason FROM f)"""
for _name, _at in {"page": 2, "line": 3, "kind": 6, "basis": 12, "review": 13, "label": 15}.items():
    P3_CTE = P3_CTE.replace("{" + _name + "}", f"regexp_replace(f[{_at}], '^{WS}+|{WS}+$', '', 'g')")


@query(f"WITH {P3_CTE} SELECT record_id, reason FROM v WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Gold records that can't be read, each with its first reason."""
    return csv_records.parse_records(parallel(table(spark, folder, "gold_raw"))).where("reason is not null").select("record_id", "reason")


def _p3_column(i: int, name: str) -> str:
    text = f"regexp_replace(f[{i}], '^{WS}+|{WS}+$', '', 'g')"
    if name in csv_records.NUMBERS:
        return f"TRY_CAST(nullif({text}, '') AS BIGINT) AS {name}"
    return f"{f'lower({text})' if name in ('recommendation_or_statement', 'reference_basis', 'needs_review') else f'f[{i}]'} AS {name}"


@query(f"WITH {P3_CTE} SELECT record_id, {', '.join(_p3_column(i, c) for i, c in enumerate(csv_records.COLUMNS, 1))} FROM v WHERE reason IS NULL")
def p3_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The records that can be read, as typed rows."""
    return csv_records.parse_records(parallel(table(spark, folder, "gold_raw"))).where("reason is null").drop("reason", "beyond")


@query("SELECT 'doc_' || doc_id AS corpus_id, trim(text) AS text FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def corpus_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text")
    return csv_sources.corpus_chunks(d, "doc_id").select(F.concat(F.lit("doc_"), F.col("doc").cast("string")).alias("corpus_id"), "text")


@query("SELECT doc_id, trim(concat_ws(chr(10), nullif(trim(document), ''), nullif(trim(text), ''))) AS text FROM (SELECT * FROM documents WHERE doc_id IS NOT NULL ORDER BY doc_id LIMIT 500) WHERE concat_ws('', nullif(trim(document), ''), nullif(trim(text), '')) <> ''")
def corpus_cap(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 documents of a corpus (the reader's cap) with their titles."""
    d = table(spark, folder, "documents").where("doc_id is not null").select("doc_id", F.col("document").alias("title"), "text")
    return csv_sources.corpus_chunks(d, "doc_id", 500).select(F.col("doc").alias("doc_id"), "text")


# --- lexical retrieval: test_items over documents --------------------------------------------

K = vocab.TOP_K
BM25_CTE = f"""
tok AS (SELECT doc_id AS doc, {tokens_sql('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT doc, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc, t, unnest(t) AS term FROM tok) GROUP BY doc, len(t), term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS r FROM df, stats),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN {vocab.BM25_EPSILON} * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM test_items) GROUP BY item_id, term),
scored AS (SELECT item_id, doc, sum(times * idf * tf * ({vocab.BM25_K1} + 1) / (tf + {vocab.BM25_K1} * (1 - {vocab.BM25_B} + {vocab.BM25_B} * dl / avgdl))) AS score
  FROM asked JOIN post USING (term) JOIN idf USING (term), stats GROUP BY item_id, doc),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM scored) WHERE rank <= 20)"""


def _bm25(spark: SparkSession, folder: str, k: int) -> DataFrame:
    found = lexical.bm25_topk(parallel(table(spark, folder, "documents")), "doc_id", "text", table(spark, folder, "test_items"), "item_id", "text", k, fill=False)
    return found.withColumnRenamed("query", "item_id")


@query(f"WITH {BM25_CTE} SELECT term, df, round(idf, 9) AS idf FROM idf")
def bm25_idf(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    idf = lexical.term_idf(lexical.postings(d, "doc_id", "text"), lexical.corpus_stats(d, "text"))
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {BM25_CTE} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
def postings(spark: SparkSession, folder: str) -> DataFrame:
    p = lexical.postings(table(spark, folder, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {BM25_CTE} SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM hits WHERE rank <= {K}")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: ten best documents of every held-out passage."""
    return _bm25(spark, folder, K).select("item_id", F.col("doc").alias("doc_id"), "rank", F.round(F.round("score", 9), 6).alias("score"))


SPARSE_CTE = f"""
tok AS (SELECT doc_id AS doc, {tokens_sql('text')} AS t FROM documents),
dw AS (SELECT doc, term, CAST(ln(1 + count(*)) AS DOUBLE) AS w FROM (SELECT doc, unnest(t) AS term FROM tok) GROUP BY doc, term),
qw AS (SELECT item_id, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT item_id, unnest({tokens_sql('text')}) AS term FROM test_items) GROUP BY item_id, term),
sdot AS (SELECT item_id, doc, sum(qw.w * dw.w) AS score FROM qw JOIN dw USING (term) GROUP BY item_id, doc),
shits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM sdot) WHERE rank <= 20)"""


def _sparse(spark: SparkSession, folder: str, k: int) -> DataFrame:
    d = parallel(table(spark, folder, "documents")).select(F.col("doc_id").alias("doc"), T.tokens("text").alias("terms"))
    q = lexical.query_terms(table(spark, folder, "test_items"), "item_id", "text").withColumnRenamed("times", "w")
    return lexical.block_topk(d, q, k, lexical.log_weight()).withColumnRenamed("query", "item_id")


@query(f"WITH {SPARSE_CTE} SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM shits WHERE rank <= {K}")
def sparse_dot_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _sparse(spark, folder, K).select("item_id", F.col("doc").alias("doc_id"), "rank", F.round(F.round("score", 9), 6).alias("score"))


RRF_CTE = f"""{BM25_CTE},
{SPARSE_CTE.split('AS doc', 1)[1].split('documents),', 1)[1]},
lists AS (SELECT item_id, doc, rank, 0 AS l FROM hits UNION ALL SELECT item_id, doc, rank, 1 FROM shits),
fused AS (SELECT item_id, doc, sum(1.0 / ({vocab.RRF_K} + rank)) AS rrf, min(l * 1000 + rank) AS seen FROM lists GROUP BY item_id, doc),
fhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM fused) WHERE rank <= {K})"""


@query(f"WITH {RRF_CTE} SELECT item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(rrf, 9) AS rrf FROM fhits")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 and sparse lists, twice as deep as the result, fused by reciprocal ranks."""
    f = ranking.fuse_topk([_bm25(spark, folder, 2 * K), _sparse(spark, folder, 2 * K)], ["item_id"], "doc", K)
    return f.select("item_id", F.col("doc").alias("doc_id"), "rank", F.round("rrf", 9).alias("rrf"))


PASSAGE_RELEVANCE = "rel AS (SELECT DISTINCT i.item_id, d.doc_id AS doc FROM test_items i JOIN documents d ON contains(d.text, i.text) WHERE i.text <> '')"


def _passage_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a passage verbatim: one automaton of all passages, no join."""
    found = passages.passages_in(parallel(table(spark, folder, "documents")), "doc_id", "text", table(spark, folder, "test_items"), "item_id", "text")
    return found.withColumnRenamed("item", "query").distinct()


PER_QUERY_CTE = """
kk AS (SELECT unnest([1, 3, 5, 10, 20]) AS k),
nrel AS (SELECT {q} AS q, count(*) AS n_rel FROM rel GROUP BY 1),
j AS (SELECT r.*, CASE WHEN x.doc IS NULL THEN 0 ELSE 1 END AS is_rel FROM {runs} r LEFT JOIN rel x ON x.{q} = r.{q} AND x.doc = r.doc),
jj AS (SELECT j.*, coalesce(n.n_rel, 0) AS n_rel, sum(is_rel) OVER (PARTITION BY {by} j.{q} ORDER BY rank) AS hits FROM j LEFT JOIN nrel n ON n.q = j.{q}),
g AS (SELECT {by} {q}, k, max(n_rel) AS n_rel, sum(CASE WHEN rank <= k THEN is_rel ELSE 0 END) AS h, sum(CASE WHEN rank <= k AND is_rel = 1 THEN hits / rank ELSE 0 END) AS a,
  sum(CASE WHEN rank <= k AND is_rel = 1 THEN 1.0 / log2(rank + 1.0) ELSE 0 END) AS d, min(CASE WHEN rank <= k AND is_rel = 1 THEN rank END) AS first_rank FROM jj, kk GROUP BY {by} {q}, k),
pq AS (SELECT {by} {q}, CAST(k AS INTEGER) AS k, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN n_rel > 0 THEN h / n_rel ELSE 0 END AS recall, h / k AS precision, coalesce(1.0 / first_rank, 0) AS mrr,
  CASE WHEN n_rel > 0 THEN a / n_rel ELSE 0 END AS ap, CASE WHEN h > 0 THEN d / list_sum(list_transform(range(1, CAST(h AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0 END AS ndcg, first_rank FROM g)"""

AT_K_SQL = "avg(hit) AS hit_rate, avg(recall) AS recall, avg(precision) AS precision, avg(mrr) AS mrr, avg(ap) AS map, avg(ndcg) AS ndcg, avg(first_rank) AS mean_rank, count(*) AS num_queries"
ROUND_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in ("hit_rate", "recall", "precision", "mrr", "map", "ndcg", "mean_rank"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to six digits, infinities as nulls (as the SQL side has them)."""
    fix = {c: F.round(F.round(F.when(F.abs(F.col(c)) < ir_metrics.INFINITY, F.col(c)), 9), 6) for c, t in df.dtypes if t == "double" and (not names or c in names)}
    return df.withColumns(fix)


@query(f"WITH {BM25_CTE}, {PASSAGE_RELEVANCE}, {PER_QUERY_CTE.format(q='item_id', by='', runs='hits')}, m AS (SELECT k, {AT_K_SQL} FROM pq GROUP BY k) SELECT k, {ROUND_SQL}, num_queries FROM m")
def ir_metrics_at_k(spark: SparkSession, folder: str) -> DataFrame:
    runs = _bm25(spark, folder, 20).withColumnRenamed("item_id", "query")
    scores = ir_metrics.per_query(runs, cut(_passage_relevance(spark, folder)))
    return _rounded(ir_metrics.at_k(scores))


# --- runs of retrieval_results against gold ---------------------------------------------------

RUNS_CTE = """
best AS (SELECT model_key, method, query_id, chunk_idx, max(scores) AS score FROM retrieval_results WHERE scores IS NOT NULL AND NOT isnan(scores) GROUP BY ALL),
allruns AS (SELECT *, row_number() OVER (PARTITION BY model_key, method, query_id ORDER BY round(score, 9) DESC, chunk_idx DESC) AS rank FROM best),
runs AS (SELECT * FROM allruns WHERE rank <= 60)"""
DOCS_CTE = RUNS_CTE + f""",
names AS (SELECT chunk_idx, document, {T.document_name_sql('document')} AS doc FROM chunks WHERE document IS NOT NULL),
firsts AS (SELECT model_key, method, query_id, doc, min(rank) AS f FROM allruns JOIN names USING (chunk_idx) GROUP BY ALL),
druns AS (SELECT model_key, method, query_id, doc, row_number() OVER (PARTITION BY model_key, method, query_id ORDER BY f) AS rank FROM firsts),
rel AS (SELECT DISTINCT gold_id AS query_id, {T.document_name_sql('doc_short_name')} AS doc FROM gold WHERE trim(coalesce(doc_short_name, '')) <> ''
  UNION SELECT DISTINCT g.gold_id, c.doc FROM gold g JOIN recommendations r ON r.query_id = g.gold_id JOIN names c ON c.chunk_idx = r.query_id)"""
SYSTEM = ["model_key", "method"]


def _runs(spark: SparkSession, folder: str, k: int = 60) -> DataFrame:
    """Ranked chunks of each system and query: one shuffle, its aggregation and the window
    share the hash of (system, query)."""
    r = table(spark, folder, "retrieval_results").where("scores is not null and not isnan(scores)")
    best = r.groupBy(*SYSTEM, "query_id", "chunk_idx").agg(F.max("scores").alias("score"))
    return ranking.topk(best, [*SYSTEM, "query_id"], "score", "chunk_idx", k)


def _names(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunks", ["chunk_idx", "document"]).where("document is not null")
    known = c.select("document").distinct().withColumn("doc", T.document_name("document"))
    return c.join(known, "document").select("chunk_idx", "doc")


def _document_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked documents of each system and query over all its rows: a document stands where
    its best chunk does, so that one aggregation of the rows is enough, with no rank of chunks."""
    r = table(spark, folder, "retrieval_results").where("scores is not null and not isnan(scores)")
    first = r.join(_names(spark, folder), "chunk_idx").groupBy(*SYSTEM, "query_id", "doc").agg(F.max(F.struct(F.round("scores", 9).alias("s"), "chunk_idx")).alias("best"))
    return ranking.ranked(first, [*SYSTEM, "query_id"], [F.col("best").desc()]).select(*SYSTEM, F.col("query_id").alias("query"), "doc", "rank")


def _gold_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Documents named by the gold row with the query's number, and the document of the chunk
    with that number (a stand-in for annotations of these queries)."""
    g = table(spark, folder, "gold").where("trim(coalesce(doc_short_name, '')) <> ''").select(F.col("gold_id").alias("query"), "doc_short_name")
    known = g.select("doc_short_name").distinct().withColumn("doc", T.document_name("doc_short_name"))
    g = g.join(known, "doc_short_name").select("query", "doc")
    r = table(spark, folder, "recommendations").select(F.col("query_id").alias("query")).join(table(spark, folder, "gold").select(F.col("gold_id").alias("query")), "query", "left_semi")
    c = r.join(_names(spark, folder).withColumnRenamed("chunk_idx", "query"), "query").select("query", "doc")
    return g.unionByName(c).distinct()


@query(f"WITH {RUNS_CTE} SELECT model_key, method, query_id, chunk_idx, CAST(rank AS INTEGER) AS rank, score FROM runs WHERE rank <= {K}")
def run_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder, K).select(*SYSTEM, "query_id", "chunk_idx", "rank", "score")


@query(f"WITH {DOCS_CTE} SELECT model_key, method, query_id, doc, CAST(rank AS INTEGER) AS rank FROM druns")
def doc_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _document_runs(spark, folder).withColumnRenamed("query", "query_id")


@query(f"WITH {DOCS_CTE}, {PER_QUERY_CTE.format(q='query_id', by='model_key, method,', runs='druns')} SELECT model_key, method, query_id, k, CAST(hit AS DOUBLE) AS hit, round(recall, 6) AS recall, round(precision, 6) AS precision, round(mrr, 6) AS mrr, round(ap, 6) AS ap, round(ndcg, 6) AS ndcg, CAST(first_rank AS DOUBLE) AS first_rank FROM pq")
def ir_per_query(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_scores(spark, folder)).withColumnRenamed("query", "query_id")


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """The per-query table that all reports read: made and written once for a folder."""
    return kept(spark, f"scores {folder}", lambda: ir_metrics.per_query(_document_runs(spark, folder), _gold_relevance(spark, folder), SYSTEM))


METRICS_CTE = f"{DOCS_CTE}, {PER_QUERY_CTE.format(q='query_id', by='model_key, method,', runs='druns')}, metrics AS (SELECT 'gold' AS dataset, 'document' AS level, model_key, method, k, {AT_K_SQL} FROM pq GROUP BY model_key, method, k)"


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = ir_metrics.at_k(_scores(spark, folder), SYSTEM)
    return m.select(F.lit("gold").alias("dataset"), F.lit("document").alias("level"), "*")


@query(f"WITH {METRICS_CTE} SELECT dataset, level, model_key, method, k, {ROUND_SQL}, num_queries FROM metrics")
def metrics_all(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_metrics(spark, folder))


@query(f"WITH {DOCS_CTE} SELECT model_key, method, round(avg(CASE WHEN x.doc IS NULL THEN 0.0 ELSE 1 END), 6) AS chunk_hit_rate FROM (SELECT r.*, n.doc FROM runs r JOIN names n USING (chunk_idx) WHERE rank = 1) r LEFT JOIN rel x ON x.query_id = r.query_id AND x.doc = r.doc GROUP BY model_key, method")
def chunk_hit_rate(spark: SparkSession, folder: str) -> DataFrame:
    runs = _runs(spark, folder, 1).join(_names(spark, folder), "chunk_idx").select(*SYSTEM, F.col("query_id").alias("query"), "rank", F.col("doc").alias("document"))
    return _rounded(ir_metrics.chunk_hit_rate(runs, _gold_relevance(spark, folder).withColumnRenamed("doc", "document"), SYSTEM))


@query(
    f"WITH {RUNS_CTE}, {DOCS_CTE.split(RUNS_CTE + ',', 1)[1].replace('rel AS', 'drel AS', 1)}, cruns AS (SELECT r.model_key, r.method, r.query_id, r.chunk_idx AS doc, r.rank, n.doc AS document FROM runs r JOIN names n USING (chunk_idx)), "
    "rel AS (SELECT DISTINCT r.query_id, r.doc FROM cruns r JOIN drel x ON x.query_id = r.query_id AND x.doc = r.document), "
    f"{PER_QUERY_CTE.format(q='query_id', by='model_key, method,', runs='cruns')}, m AS (SELECT model_key, method, k, {AT_K_SQL} FROM pq GROUP BY model_key, method, k) SELECT model_key, method, k, {ROUND_SQL}, num_queries FROM m"
)
def projected_chunk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of chunks, relevant being the retrieved chunks of relevant documents."""
    runs = _runs(spark, folder).join(_names(spark, folder), "chunk_idx").select(*SYSTEM, F.col("query_id").alias("query"), F.col("chunk_idx").alias("doc"), "rank", F.col("doc").alias("document"))
    rel = ir_metrics.projected_qrels(runs, _gold_relevance(spark, folder).withColumnRenamed("doc", "document"))
    return _rounded(ir_metrics.at_k(ir_metrics.per_query(runs, rel, SYSTEM), SYSTEM))


@query(
    f"WITH {DOCS_CTE}, nrel AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1), g AS (SELECT r.model_key, r.method, r.query_id, max(n_rel) AS n_rel, count(x.doc) FILTER (r.rank <= 3) AS near, count(x.doc) FILTER (r.rank <= 20) AS far "
    "FROM druns r JOIN nrel USING (query_id) LEFT JOIN rel x ON x.query_id = r.query_id AND x.doc = r.doc GROUP BY 1, 2, 3), "
    "c AS (SELECT model_key, method, CASE WHEN near >= n_rel THEN 'success' WHEN near > 0 THEN 'partial' WHEN far > 0 THEN 'late_hit' ELSE 'complete_miss' END AS category, count(*) AS count FROM g GROUP BY ALL) "
    "SELECT model_key, method, category, count, round(count / sum(count) OVER (PARTITION BY model_key, method), 6) AS share FROM c"
)
def error_categories(spark: SparkSession, folder: str) -> DataFrame:
    c = ir_metrics.error_categories(_document_runs(spark, folder), _gold_relevance(spark, folder), SYSTEM, 3)
    return _rounded(ir_metrics.shares(c, SYSTEM, "category"))


@query(f"WITH {DOCS_CTE} SELECT query_id, string_agg(doc, '; ' ORDER BY doc) AS relevant_docs FROM rel GROUP BY query_id")
def gold_instances(spark: SparkSession, folder: str) -> DataFrame:
    g = _gold_relevance(spark, folder).groupBy(F.col("query").alias("query_id"))
    return g.agg(F.array_join(F.array_sort(F.collect_set("doc")), "; ").alias("relevant_docs"))


@query(
    f"SELECT {norm_sql('recommendation_text')} AS query, {norm_sql("coalesce(source_snippet_original, '')")} AS snippet, string_agg(DISTINCT {T.document_name_sql("coalesce(doc_short_name, '')")}, '; ' ORDER BY {T.document_name_sql("coalesce(doc_short_name, '')")}) AS relevant_docs "
    f"FROM gold WHERE {norm_sql("coalesce(recommendation_text, '')")} <> '' GROUP BY 1, 2"
)
def gold_query_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Gold rows grouped by query and snippet, with the set of canonical documents."""
    g = table(spark, folder, "gold")
    query_text, snippet = T.normalize_ws(F.coalesce("recommendation_text", F.lit(""))), T.normalize_ws(F.coalesce("source_snippet_original", F.lit("")))
    docs = F.array_join(F.array_sort(F.collect_set(T.document_name(F.coalesce("doc_short_name", F.lit(""))))), "; ")
    return g.select(query_text.alias("query"), snippet.alias("snippet"), "doc_short_name").where("query <> ''").groupBy("query", "snippet").agg(docs.alias("relevant_docs"))


@query("SELECT DISTINCT r.query_id, r.chunk_idx FROM retrieval_results r SEMI JOIN chunks c ON c.chunk_idx = r.chunk_idx SEMI JOIN recommendations q ON q.query_id = r.query_id")
def qrels_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Query and chunk pairs whose sides both exist: two semi-joins."""
    r = table(spark, folder, "retrieval_results").select("query_id", "chunk_idx").distinct()
    return r.join(table(spark, folder, "chunks", ["chunk_idx"]), "chunk_idx", "left_semi").join(table(spark, folder, "recommendations", ["query_id"]), "query_id", "left_semi").select("query_id", "chunk_idx")


@query("SELECT q.query_id FROM recommendations q ANTI JOIN retrieval_results r ON r.query_id = q.query_id")
def pending_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Queries without results yet."""
    return reporting.missing_steps(table(spark, folder, "recommendations", ["query_id"]), table(spark, folder, "retrieval_results", ["query_id"]), ["query_id"])


# --- evidence groups and selection --------------------------------------------------------------

SPLIT_CTE = f"""
best AS (SELECT query_id, chunk_idx, max(scores) AS score FROM retrieval_results WHERE scores IS NOT NULL AND NOT isnan(scores) GROUP BY ALL),
named AS (SELECT b.*, c.document, {T.evidence_group_sql('c.document')} AS evidence_group, substr(regexp_replace({norm_sql("lower(coalesce(c.text, ''))")}, '[^a-z0-9 ]', '', 'g'), 1, 220) AS fingerprint FROM best b JOIN chunks c USING (chunk_idx) WHERE c.document IS NOT NULL),
grouped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, evidence_group ORDER BY round(score, 9) DESC, chunk_idx DESC) AS group_rank FROM named) WHERE group_rank <= 20),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx DESC) AS rank FROM grouped)"""


def _group_candidates(spark: SparkSession, folder: str, k: int = 20) -> DataFrame:
    r = table(spark, folder, "retrieval_results").where("scores is not null and not isnan(scores)")
    best = r.groupBy("query_id", "chunk_idx").agg(F.max("scores").alias("score"))
    c = table(spark, folder, "chunks").where("document is not null")
    c = c.select("chunk_idx", "document", T.evidence_group("document").alias("evidence_group"), T.fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    return ranking.topk(best.join(c, "chunk_idx"), ["query_id", "evidence_group"], "score", "chunk_idx", k, rank="group_rank")


@query(f"WITH {SPLIT_CTE} SELECT query_id, evidence_group, CAST(group_rank AS INTEGER) AS group_rank, chunk_idx, score FROM grouped")
def split_group_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _group_candidates(spark, folder).select("query_id", "evidence_group", "group_rank", "chunk_idx", "score")


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.ranked(_group_candidates(spark, folder), ["query_id"], [F.round("score", 9).desc(), F.col("chunk_idx").desc()])


@query(f"WITH {SPLIT_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_idx, score FROM merged WHERE rank <= {K}")
def split_merge_best(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).where(F.col("rank") <= K).select("query_id", "rank", "chunk_idx", "score")


@query(f"WITH {SPLIT_CTE}, capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, document ORDER BY rank) AS n FROM merged) SELECT query_id, CAST(r AS INTEGER) AS rank, chunk_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM capped WHERE n <= 2) WHERE r <= {K}")
def doc_cap(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.document_cap(_merged(spark, folder), ["query_id"], "document", 2, K).select("query_id", "rank", "chunk_idx")



# --- vectors ----------------------------------------------------------------------------------------

VECTORS_SQL = """
WITH q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT vec_id AS doc, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT query, doc, {score} AS score FROM q, d),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) {order}, doc DESC) AS rank FROM s)
SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""


def _dense(spark: SparkSession, folder: str, metric: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    found = vectors.dense_topk(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), "vec_id", "embedding", K, metric)
    return found.select("query", "doc", "rank", F.round(F.round("score", 9), 6).alias("score"))


@query(VECTORS_SQL.format(score="list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))", order="DESC"))
def dense_ip_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Every hundredth vector as a query against all vectors, by inner product."""
    return _dense(spark, folder, "ip")


@query(VECTORS_SQL.format(score="list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - d.v[i]) * (q.v[i] - d.v[i])))", order="ASC"))
def dense_l2_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same by squared distance."""
    return _dense(spark, folder, "l2")


MULTI = "vec_id div 4"


@query(
    """WITH m AS (SELECT vec_id // 4 AS g, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM m WHERE g % 100 = 0),
b AS (SELECT q.g AS query, d.g AS doc, q.vec_id, max(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.v[i]))) AS best FROM q, m d GROUP BY 1, 2, 3),
s AS (SELECT query, doc, sum(best) AS score FROM b GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc DESC) AS rank FROM s)
SELECT query, doc, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10"""
)
def maxsim_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Late interaction over groups of four vectors as multi-vectors."""
    e = table(spark, folder, "embeddings").groupBy(F.expr(MULTI).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    e = e.select("g", F.transform("m", lambda x: x["embedding"]).alias("v"))
    found = vectors.maxsim_topk(e, "g", "v", e.where("g % 100 = 0"), "g", "v", K)
    return found.select("query", "doc", "rank", F.round(F.round("score", 9), 6).alias("score"))


_PREFLIGHT = "SELECT '{0}' AS corpus, n_vectors, CAST(a AS INTEGER) AS min_dim, CAST(b AS INTEGER) AS max_dim, probe_ok, (SELECT count(*) FROM {0}) AS n_docs, n_vectors > 0 AND a > 0 AND a = b AND probe_ok AND n_vectors = (SELECT count(*) FROM {0}) AS ok FROM v"


@query(f"WITH v AS (SELECT count(*) AS n_vectors, min(len(embedding)) AS a, max(len(embedding)) AS b, bool_and(list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)) AS probe_ok FROM embeddings) {_PREFLIGHT.format('embeddings')} UNION ALL {_PREFLIGHT.format('documents')}")
def index_preflight(spark: SparkSession, folder: str) -> DataFrame:
    """An index of vectors against the corpus it was made of, and against another one."""
    e = table(spark, folder, "embeddings")
    checks = [stores.vector_preflight(e, "embedding", table(spark, folder, c)).select(F.lit(c).alias("corpus"), "*") for c in ("embeddings", "documents")]
    return checks[0].unionByName(checks[1])


# --- reports -----------------------------------------------------------------------------------------


@query(f"WITH {METRICS_CTE} SELECT dataset, level, model_key, method, k, round(ndcg, 6) AS ndcg FROM metrics WHERE k = 10")
def ranking_k(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.at_report_k(_metrics(spark, folder), 10).select("dataset", "level", "model_key", "method", "k", "ndcg"))


BEST_SQL = """, r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(value, 9) DESC, {tie}) AS n, count(*) OVER (PARTITION BY {by}) AS c FROM long)
SELECT {by}, max(CASE WHEN n = 1 THEN model_key END) AS best_model_key, round(max(CASE WHEN n = 1 THEN value END), 6) AS best_value, max(CASE WHEN n = 2 THEN model_key END) AS second_model_key,
round(max(CASE WHEN n = 2 THEN value END), 6) AS second_value, max(c) AS num_compared, round(max(CASE WHEN n = 1 THEN value END) - max(CASE WHEN n = 2 THEN value END), 6) AS gap_to_second FROM r GROUP BY {by}"""


@query(f"WITH {METRICS_CTE}, long AS (SELECT dataset, level, method, k, model_key, unnest(['hit_rate', 'mrr', 'ndcg']) AS metric, unnest([hit_rate, mrr, ndcg]) AS value FROM metrics)" + BEST_SQL.format(by="dataset, level, method, k, metric", tie="model_key"))
def best_second_gap(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.comparison(_metrics(spark, folder)))


@query(
    f"WITH {METRICS_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, level ORDER BY round(ndcg, 9) DESC, model_key, method) AS n FROM metrics WHERE k = 10) "
    "SELECT a.dataset, a.level, a.model_key AS best_model, a.method AS best_method, round(a.ndcg, 6) AS best_ndcg, b.model_key AS second_model, b.method AS second_method, round(b.ndcg, 6) AS second_ndcg, round(a.ndcg - b.ndcg, 6) AS gap_ndcg "
    "FROM r a LEFT JOIN r b ON b.dataset = a.dataset AND b.level = a.level AND b.n = 2 WHERE a.n = 1"
)
def selection_table(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.selection(_metrics(spark, folder).where("k = 10")))


MODELS = ("encoder_base", "encoder_multi", "encoder_small")


@query(
    f"WITH {METRICS_CTE} SELECT method, " + ", ".join(f"round(max(CASE WHEN model_key = '{m}' THEN {v} END), 6) AS {v}__{m}" for v in ("hit_rate", "mrr", "ndcg") for m in MODELS)
    + ", CAST(coalesce(list_position(['bm25', 'dense', 'rrf', 'bm25_rerank', 'dense_rerank', 'rrf_rerank'], method), 7) AS BIGINT) AS position FROM metrics WHERE k = 10 GROUP BY method"
)
def ablation_pivot(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.ablation_pivot(_metrics(spark, folder).where("k = 10"), MODELS)).withColumn("position", F.col("position").cast("bigint"))


@query(
    f"WITH {METRICS_CTE}, s AS (SELECT model_key, method, avg(hit) AS hit, avg(mrr) AS mrr, avg(ndcg) AS ndcg, CASE WHEN count(first_rank) = count(*) THEN avg(first_rank) END AS first_rank FROM pq WHERE k = 10 GROUP BY 1, 2), p AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}', '{n}')" for a, b, n in reporting.ABLATIONS)
    + ") AS t(base, variant, ablation)) SELECT b.model_key, p.ablation, p.base, p.variant, round(v.hit - b.hit, 6) AS delta_hit, round(v.mrr - b.mrr, 6) AS delta_mrr, round(v.ndcg - b.ndcg, 6) AS delta_ndcg, round(v.first_rank - b.first_rank, 6) AS delta_first_rank FROM p JOIN s b ON b.method = p.base JOIN s v ON v.method = p.variant AND v.model_key = b.model_key"
)
def ablation_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.ablation_deltas(_scores(spark, folder).where("k = 10"), ["model_key"], ("hit", "mrr", "ndcg", "first_rank")), "delta_hit", "delta_mrr", "delta_ndcg", "delta_first_rank")


@query(f"WITH {METRICS_CTE} SELECT model_key, method, round(avg(hit_rate), 6) AS mean_hit_rate, round(avg(mrr), 6) AS mean_mrr, round(avg(ndcg), 6) AS mean_ndcg FROM metrics GROUP BY 1, 2")
def global_mean_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.global_means(_metrics(spark, folder)))


@query(f"WITH {METRICS_CTE} SELECT k, round(avg(hit_rate), 6) AS mean_hit_rate, round(avg(mrr), 6) AS mean_mrr, round(avg(ndcg), 6) AS mean_ndcg, CAST(rank() OVER (ORDER BY round(avg(ndcg), 9) DESC) AS INTEGER) AS rank FROM metrics GROUP BY k")
def k_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.k_trend(_metrics(spark, folder)))


@query(f"WITH {METRICS_CTE} SELECT dataset, level, k, model_key, method, round(ndcg, 6) AS ndcg FROM (SELECT *, row_number() OVER (PARTITION BY dataset, level, k ORDER BY round(ndcg, 9) DESC, model_key, method) AS n FROM metrics) WHERE n = 1")
def k_winners(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(reporting.k_winners(_metrics(spark, folder)))


OLD_SQL = "SELECT dataset, level, model_key, method, k, hit_rate / 2 AS hit_rate, mrr / 2 AS mrr, ndcg / 2 AS ndcg FROM metrics WHERE method <> 'rrf'"


def _old(m: DataFrame) -> DataFrame:
    """A second metrics table, as an earlier run would leave it: no rrf, half the values."""
    return m.where("method <> 'rrf'").select(*reporting.KEYS, *((F.col(v) / 2).alias(v) for v in ("hit_rate", "mrr", "ndcg")))


@query(
    f"WITH {METRICS_CTE}, o AS ({OLD_SQL}) SELECT n.dataset, n.level, n.model_key, n.method, n.k, " + ", ".join(f"round(o.{v}, 6) AS {v}_old, round(n.{v}, 6) AS {v}_new, round(n.{v} - o.{v}, 6) AS delta_{v}" for v in ("hit_rate", "mrr", "ndcg"))
    + " FROM metrics n JOIN o USING (dataset, level, model_key, method, k)"
)
def old_new_delta(spark: SparkSession, folder: str) -> DataFrame:
    m = _metrics(spark, folder)
    return _rounded(reporting.old_new_deltas(_old(m), m))


@query(f"WITH {METRICS_CTE}, o AS ({OLD_SQL}) SELECT m.dataset, m.level, m.model_key, m.method, m.k, round(coalesce(o.ndcg, m.ndcg), 6) AS ndcg FROM metrics m LEFT JOIN o USING (dataset, level, model_key, method, k)")
def merge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Union of two tables in which the later one wins."""
    m = _metrics(spark, folder).select(*reporting.KEYS, "ndcg")
    return _rounded(reporting.merge_metrics([m, _old(_metrics(spark, folder)).select(*reporting.KEYS, "ndcg")]))


@query(f"WITH {METRICS_CTE} SELECT dataset, level, model_key, method, count(DISTINCT k) FILTER (k IN (1, 3, 5, 10, 20)) = 5 AS complete FROM metrics GROUP BY 1, 2, 3, 4")
def complete_systems(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.complete_systems(_metrics(spark, folder))


@query(f"WITH {METRICS_CTE} SELECT dataset, level, model_key, method, k, printf('%-14s %-14s k=%-3d hit=%.3f mrr=%.3f ndcg=%.3f', model_key, method, k, round(round(hit_rate, 9), 3), round(round(mrr, 9), 3), round(round(ndcg, 9), 3)) AS line FROM metrics")
def text_report(spark: SparkSession, folder: str) -> DataFrame:
    return reporting.text_report(_metrics(spark, folder))


@query(
    f"WITH {METRICS_CTE}, o AS ({OLD_SQL}), l AS (SELECT model_key, method, k, round(ndcg, 6) AS ndcg FROM metrics WHERE k = 10), r AS (SELECT model_key, method, k, round(CASE WHEN method = 'bm25' THEN ndcg * 2 ELSE ndcg END, 6) AS ndcg FROM o WHERE k = 10) "
    "SELECT (SELECT count(*) FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)) AS only_left, (SELECT count(*) FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)) AS only_right"
)
def ranking_consistency(spark: SparkSession, folder: str) -> DataFrame:
    """The report's ranking against an earlier report that agrees with it for bm25 only."""
    m = _metrics(spark, folder)
    new = reporting.at_report_k(m, 10).select("model_key", "method", "k", F.round(F.round("ndcg", 9), 6).alias("ndcg"))
    old = _old(m).where("k = 10").withColumn("ndcg", F.when(F.col("method") == "bm25", F.col("ndcg") * 2).otherwise(F.col("ndcg")))
    return reporting.same_frames(new, old.select("model_key", "method", "k", F.round(F.round("ndcg", 9), 6).alias("ndcg")))


# --- statistics ----------------------------------------------------------------------------------------

PAIRS_CTE = f"{METRICS_CTE}, pairs AS (SELECT a.model_key, a.method AS method_a, b.method AS method_b, a.query_id, a.ndcg AS a, b.ndcg AS b FROM pq a JOIN pq b ON a.model_key = b.model_key AND a.query_id = b.query_id AND a.k = b.k AND a.method < b.method WHERE a.k = 10)"
PAIR = ["model_key", "method_a", "method_b"]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.method_pairs(_scores(spark, folder).where("k = 10"), ["model_key"], "method", "query", "ndcg")


@query(
    f"WITH {PAIRS_CTE}, pg AS (SELECT model_key, method_a, method_b, avg(a - b) AS d, stddev_samp(a - b) AS sd, count(*) AS n FROM pairs GROUP BY 1, 2, 3), z AS (SELECT *, CASE WHEN n < 2 OR coalesce(sd, 0) < 1e-12 THEN 0 ELSE d / sd END AS dz FROM pg) "
    "SELECT model_key, method_a, method_b, round(d, 6) AS delta_mean, round(dz, 6) AS effect_size_dz, CASE WHEN abs(dz) < 0.2 THEN 'negligible' WHEN abs(dz) < 0.5 THEN 'small' WHEN abs(dz) < 0.8 THEN 'medium' ELSE 'large' END AS effect_label, n FROM z"
)
def paired_effect(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(statistics.paired_effect(_pairs(spark, folder), PAIR))


P_SQL = "SELECT label AS family, vec_id AS test, round(abs(CAST(embedding[1] AS DOUBLE)) / 20, 9) AS p_value FROM embeddings"


@query(
    f"WITH p AS ({P_SQL}), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p_value, test) + 1) * p_value) AS adj FROM p), "
    "h AS (SELECT family, test, p_value, max(adj) OVER (PARTITION BY family ORDER BY p_value, test) AS p_value_holm FROM s) SELECT family, test, p_value, round(p_value_holm, 9) AS p_value_holm, p_value_holm < 0.05 AS significant_holm_0_05, "
    "CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE '' END AS stars FROM h"
)
def holm_adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Holm's correction within families; p-values made from vectors to have many and ties."""
    e = table(spark, folder, "embeddings").select(F.col("label").alias("family"), F.col("vec_id").alias("test"), F.round(F.abs(F.col("embedding")[0].cast("double")) / 20, 9).alias("p_value"))
    h = statistics.holm(e, ["family"], "p_value", ["test"])
    return h.withColumn("stars", statistics.stars(F.col("p_value"))).withColumn("p_value_holm", F.round("p_value_holm", 9))


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    s = reporting.unpivot(_scores(spark, folder).where("k = 10"), [*SYSTEM, "query"], ["hit", "mrr", "ndcg"])
    return _rounded(statistics.bootstrap_ci(s, [*SYSTEM, "metric"], "value", "query", together=["method", "metric"]))


@query()
def permutation_p(spark: SparkSession, folder: str) -> DataFrame:
    p = statistics.permutation_test(_pairs(spark, folder), PAIR, "a", "b", "query", together=["method_a", "method_b"])
    return _rounded(statistics.holm(p, ["model_key"], "p_value", ["method_a", "method_b"]))


@query()
def significance_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Mean NDCG of each system with the stars of its permutation test against BM25."""
    s = _scores(spark, folder).where("k = 10")
    pairs = statistics.method_pairs(s, ["model_key"], "method", "query", "ndcg").where("method_a = 'bm25' or method_b = 'bm25'")
    tests = statistics.permutation_test(pairs, PAIR, "a", "b", "query", together=["method_a", "method_b"])
    return reporting.starred(s.groupBy(*SYSTEM).agg(F.avg("ndcg").alias("ndcg")), tests, "ndcg")


@query("SELECT source, round(quantile_cont(n_chars, 0.025), 6) AS low, round(quantile_cont(n_chars, 0.975), 6) AS high FROM documents WHERE source IS NOT NULL GROUP BY source")
def percentile_ci(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("source is not null")
    return d.groupBy("source").agg(F.round(F.round(F.percentile("n_chars", 0.025), 9), 6).alias("low"), F.round(F.round(F.percentile("n_chars", 0.975), 9), 6).alias("high"))


# --- classification: predicted labels against those of gold ----------------------------------------------

LABEL_SQL = "(" + ", ".join(f"'{x}'" for x in vocab.LABELS) + ")"
CELLS_CTE = f"""
lab AS (SELECT unnest([{', '.join(f"'{x}'" for x in vocab.LABELS)}]) AS l),
obs AS (SELECT g.alignment_label AS y_true, j.predicted_label AS y_pred FROM judge_results j JOIN gold g ON g.gold_id = j.judge_id WHERE g.alignment_label IN {LABEL_SQL} AND j.predicted_label IN {LABEL_SQL}),
cells AS (SELECT a.l AS y_true, b.l AS y_pred, count(o.y_true) AS n FROM lab a CROSS JOIN lab b LEFT JOIN obs o ON o.y_true = a.l AND o.y_pred = b.l GROUP BY 1, 2),
cls AS (SELECT l AS label, sum(CASE WHEN y_true = l AND y_pred = l THEN n ELSE 0 END) AS tp, sum(CASE WHEN y_true = l THEN n ELSE 0 END) AS support, sum(CASE WHEN y_pred = l THEN n ELSE 0 END) AS predicted FROM cells, lab GROUP BY 1),
pr AS (SELECT label, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM cls),
prf AS (SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, CAST(support AS BIGINT) AS support FROM pr)"""


def _cells(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "gold").select(F.col("gold_id").alias("judge_id"), F.col("alignment_label").alias("t"))
    return classification.confusion(table(spark, folder, "judge_results").join(g, "judge_id"), "t", "predicted_label")


@query(f"WITH {CELLS_CTE} SELECT y_true, y_pred, n FROM cells")
def cls_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return _cells(spark, folder)


@query(f"WITH {CELLS_CTE} SELECT y_true, " + ", ".join(f"CAST(sum(CASE WHEN y_pred = '{x}' THEN n ELSE 0 END) AS BIGINT) AS {x.lower().replace(' ', '_')}" for x in vocab.LABELS) + " FROM cells GROUP BY y_true")
def cls_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return classification.confusion_matrix(_cells(spark, folder))


@query(f"WITH {CELLS_CTE} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf")
def cls_prf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(classification.per_class(_cells(spark, folder)))


@query(
    f"WITH {CELLS_CTE}, t AS (SELECT sum(n) AS n, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS same FROM cells), e AS (SELECT sum(a.s * b.s) AS ab FROM (SELECT y_true AS l, sum(n) AS s FROM cells GROUP BY 1) a JOIN (SELECT y_pred AS l, sum(n) AS s FROM cells GROUP BY 1) b USING (l)) "
    "SELECT round(same / n, 6) AS accuracy, round((SELECT avg(f1) FROM prf), 6) AS macro_f1, round((SELECT sum(f1 * support) / sum(support) FROM prf), 6) AS weighted_f1, round((same / n - ab / (n * n)) / (1 - ab / (n * n)), 6) AS cohen_kappa, CAST(n AS BIGINT) AS n FROM t, e"
)
def cls_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(classification.summary(_cells(spark, folder)))


@query("SELECT CASE WHEN trim(coalesce(alignment_label, '')) = '' THEN '<empty>' ELSE alignment_label END AS label, count(*) AS count, round(count(*) / (SELECT count(*) FROM gold), 6) AS share FROM gold GROUP BY 1")
def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.trim(F.coalesce("alignment_label", F.lit(""))) == "", "<empty>").otherwise(F.col("alignment_label"))
    return _rounded(ir_metrics.shares(table(spark, folder, "gold").select(label.alias("label")), [], "label"))


# --- judge and classifier answers ---------------------------------------------------------------------------

BAND_SQL = "CASE WHEN overall_score BETWEEN 0 AND 2 THEN '0-2' WHEN overall_score > 2 AND overall_score <= 3 THEN '2-3' WHEN overall_score > 3 AND overall_score <= 4 THEN '3-4' WHEN overall_score > 4 AND overall_score <= 5 THEN '4-5' END"


@query(f"SELECT {BAND_SQL} AS band, count(*) AS count, round(avg(overall_score), 6) AS mean_score, round(stddev_pop(overall_score), 6) AS std_score FROM judge_results GROUP BY 1")
def judge_bands(spark: SparkSession, folder: str) -> DataFrame:
    j = table(spark, folder, "judge_results").groupBy(judging.score_band("overall_score").alias("band"))
    return _rounded(j.agg(F.count("*").alias("count"), F.avg("overall_score").alias("mean_score"), F.stddev_pop("overall_score").alias("std_score")))



@query("SELECT judge_id, CASE " + " ".join(f"WHEN contains(trim(lower(predicted_label)), '{x.lower()}') OR contains('{x.lower()}', trim(lower(predicted_label))) THEN '{x}'" for x in vocab.LABELS) + " ELSE predicted_label END AS label FROM judge_results WHERE predicted_label IS NOT NULL")
def fuzzy_label(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "judge_results").where("predicted_label is not null").select("judge_id", judging.best_label("predicted_label").alias("label"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT recommendation, predicted_label, label_score, justification_score, evidence_score, completeness_score, overall_score, reasoning FROM judge_results")
def judge_export(spark: SparkSession, folder: str) -> DataFrame:
    return stores.judge_export(table(spark, folder, "judge_results"))


# --- exports and prompts ---------------------------------------------------------------------------------------

EXPORT_CTE = f"""
best AS (SELECT query_id, chunk_idx, max(scores) AS score FROM retrieval_results WHERE scores IS NOT NULL AND NOT isnan(scores) GROUP BY ALL),
runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_idx DESC) AS rank FROM best) WHERE rank <= {K}),
x AS (SELECT r.query_id, r.rank, r.score, c.* FROM runs r JOIN chunks c USING (chunk_idx))"""


def _query_runs(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "retrieval_results").where("scores is not null and not isnan(scores)")
    return ranking.topk(r.groupBy("query_id", "chunk_idx").agg(F.max("scores").alias("score")), ["query_id"], "score", "chunk_idx", K)


@query(f"WITH {EXPORT_CTE} SELECT query_id, CAST(rank AS INTEGER) AS rank, id AS chunk_id, document, {T.evidence_group_sql('document')} AS evidence_group, article, paragraph, score, md5(text) AS text_md5 FROM x")
def run_export(spark: SparkSession, folder: str) -> DataFrame:
    e = stores.run_export(_query_runs(spark, folder), table(spark, folder, "chunks"), ["query_id"], K)
    return e.withColumn("text_md5", F.md5("text")).drop("text")


@query(
    f"""WITH {EXPORT_CTE} SELECT query_id, array_to_string(list_sort(list(DISTINCT coalesce(document, ''))), '; ') AS retrieved_documents, array_to_string(list_sort(list(DISTINCT {T.evidence_group_sql("coalesce(document, '')")})), '; ') AS retrieved_evidence_groups,
coalesce(array_to_string(list_sort(list(DISTINCT article) FILTER (coalesce(article, '') <> '')), '; '), '') AS retrieved_articles, string_agg(coalesce(id, ''), '; ' ORDER BY rank) AS top_chunk_ids,
md5(string_agg('[' || coalesce(document, '') || ' | ' || coalesce(article, '') || ']' || chr(10) || substr(coalesce(text, ''), 1, 400), chr(10) || '---' || chr(10) ORDER BY rank)) AS texts_md5 FROM x GROUP BY query_id"""
)
def prompt_export(spark: SparkSession, folder: str) -> DataFrame:
    x = _query_runs(spark, folder).join(table(spark, folder, "chunks"), "chunk_idx")
    return stores.prompt_export(x, ["query_id"]).withColumn("texts_md5", F.md5("top_chunk_texts")).drop("top_chunk_texts")


@query(
    f"""WITH {EXPORT_CTE}, e AS (SELECT query_id, rank, '[' || rank || '] id=' || coalesce(id, '') || ' | ' || coalesce(document, '') || ' | ' || coalesce(article, '') || CASE WHEN coalesce(article_subtitle, '') <> '' THEN ' — ' || article_subtitle ELSE '' END
|| CASE WHEN coalesce(paragraph, '') <> '' THEN ' | §' || paragraph ELSE '' END || chr(10) || CASE WHEN length(b) > 600 THEN substr(b, 1, 600) || '…' ELSE b END || chr(10) AS entry FROM (SELECT *, CASE WHEN coalesce(article_text, '') <> '' THEN article_text ELSE coalesce(text, '') END AS b FROM x))
SELECT query_id, CAST(count(*) AS INTEGER) AS n_chunks, md5(string_agg(entry, chr(10) ORDER BY rank)) AS block_md5 FROM e GROUP BY query_id"""
)
def evidence_block(spark: SparkSession, folder: str) -> DataFrame:
    x = _query_runs(spark, folder).join(table(spark, folder, "chunks"), "chunk_idx")
    return judging.evidence_blocks(x, "query_id").select("query_id", "n_chunks", F.md5("block").alias("block_md5"))



@query(
    f"WITH {EXPORT_CTE}, ids AS (SELECT query_id, string_agg(coalesce(id, ''), '; ' ORDER BY rank) AS s FROM x GROUP BY query_id), v AS (SELECT trim(unnest(string_split(s, ';'))) AS chunk_id FROM ids) SELECT chunk_id, count(*) AS citations FROM v WHERE chunk_id <> '' GROUP BY 1"
)
def explode_cited(spark: SparkSession, folder: str) -> DataFrame:
    """Ids joined by semicolons, cut apart and counted."""
    x = _query_runs(spark, folder).join(table(spark, folder, "chunks"), "chunk_idx")
    e = stores.prompt_export(x, ["query_id"]).select(F.explode(T.semicolon_values("top_chunk_ids")).alias("chunk_id"))
    return e.groupBy("chunk_id").agg(F.count("*").alias("citations"))




# --- chunking -------------------------------------------------------------------------------------------------------


# units are sentences, or the words of one over the limit; a recursion over them keeps where
# the open chunk begins and ends, and the bounds of the one that was closed
BUDGET_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, {clean_sql("coalesce(text, '')")} AS w FROM documents),
se AS (SELECT doc_id, unnest(string_split(regexp_replace(w, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1))) AS s, generate_subscripts(string_split(regexp_replace(w, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM t WHERE length(w) > {vocab.CHUNK_CHARS}),
sp AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS a FROM se),
wo AS (SELECT doc_id, i, a, unnest(string_split(s, ' ')) AS x, generate_subscripts(string_split(s, ' '), 1) AS j FROM sp WHERE length(s) > {vocab.CHUNK_CHARS}),
un AS (SELECT doc_id, i, 0 AS j, a, a + length(s) AS z, false AS apart FROM sp WHERE length(s) <= {vocab.CHUNK_CHARS}
  UNION ALL SELECT doc_id, i, j, a + sum(length(x) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - length(x) - 1, a + sum(length(x) + 1) OVER (PARTITION BY doc_id, i ORDER BY j) - 1, j = 1 FROM wo),
n AS (SELECT doc_id, a, z, apart, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS n FROM un),
r AS (SELECT doc_id, n, CAST(0 AS HUGEINT) AS b, CAST(z AS HUGEINT) AS l, CAST(NULL AS HUGEINT) AS cb, CAST(NULL AS HUGEINT) AS cl FROM n WHERE n = 1
  UNION ALL SELECT doc_id, n, CASE WHEN NOT closed THEN b WHEN apart OR l - b <= {vocab.CHUNK_OVERLAP} THEN a
      ELSE low + CASE WHEN substr(w, CAST(low + 1 AS BIGINT), 1) = ' ' THEN 1 ELSE 0 END END, z, CASE WHEN closed THEN b END, CASE WHEN closed THEN l END
    FROM (SELECT r.doc_id, u.n, r.b, r.l, u.a, u.z, u.apart, t.w, r.l > r.b AND (u.apart OR u.z - r.b > {vocab.CHUNK_CHARS}) AS closed,
        r.l - {vocab.CHUNK_OVERLAP} + length(regexp_extract(substr(t.w, CAST(r.l - {vocab.CHUNK_OVERLAP} + 1 AS BIGINT), {vocab.CHUNK_OVERLAP}), '^(?s:.*?)[.!?] ')) AS low
      FROM r JOIN n u ON u.doc_id = r.doc_id AND u.n = r.n + 1 JOIN t ON t.doc_id = r.doc_id)),
c AS (SELECT doc_id, cb AS b, cl AS l FROM r WHERE cb IS NOT NULL UNION ALL SELECT doc_id, arg_max(b, n), arg_max(l, n) FROM r GROUP BY doc_id),
p AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY l) AS part_no, substr(w, CAST(b + 1 AS BIGINT), CAST(l - b AS BIGINT)) AS part FROM c JOIN t USING (doc_id) UNION ALL SELECT doc_id, 1, w FROM t WHERE w <> '' AND length(w) <= {vocab.CHUNK_CHARS})
SELECT doc_id, CAST(part_no AS INTEGER) AS part_no, CAST(length(part) AS INTEGER) AS part_len, md5(part) AS part_md5 FROM p"""


@query(BUDGET_SQL)
def budget_chunks(spark: SparkSession, folder: str) -> DataFrame:
    p = chunking.split_for_budget(parallel(table(spark, folder, "documents")), "doc_id", "text")
    return p.select(F.col("id").alias("doc_id"), "part_no", F.length("part").alias("part_len"), F.md5("part").alias("part_md5"))


@query("SELECT document, version, article, chunk_idx, last_value(article_subtitle IGNORE NULLS) OVER (PARTITION BY document, version, article ORDER BY chunk_idx ROWS UNBOUNDED PRECEDING) AS heading FROM chunks WHERE document IS NOT NULL AND version IS NOT NULL AND article IS NOT NULL")
def heading_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("document", "version", "article").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, folder, "chunks").where("document is not null and version is not null and article is not null")
    return c.select("document", "version", "article", "chunk_idx", F.last("article_subtitle", ignorenulls=True).over(w).alias("heading"))




@query()
def stemmed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens without stop words, stemmed."""
    d = parallel(table(spark, folder, "documents")).select("doc_id", stem.stemmed_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").alias("n_stems"), F.size(F.array_distinct("t")).alias("n_distinct"))



# --- event tables: the streaming forms run as batches here --------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    e = streams.event_counts(table(spark, folder, "events"))
    return _rounded(e).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

"""Reading model answers, building messages, and pluggable model steps."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions import vocab
from normloom.functions.text import as_column
from normloom.tables import cut

# --- reading answers ------------------------------------------------------------------------

# Score fields of the judge, and texts that stand for an unreadable answer.
SCORES = ("label_score", "justification_score", "evidence_score", "completeness_score")
PARTIAL_REASONING = "Scores extracted from malformed JSON response."
NO_REASONING = "PARSE_ERROR: Judge response was not valid JSON. Default scores were assigned."
CJK_REASONING = "Reasoning contained non-English text; the judge result was retained, but the explanation was normalized to English."


def strip_wrapping(c: Column | str) -> Column:
    """Thinking (closed, then unclosed) and code fences at the ends removed, trimmed."""
    text = F.trim(F.regexp_replace(as_column(c), r"(?s)<think>.*?</think>", ""))
    text = F.trim(F.regexp_replace(text, r"(?s)<think>.*", ""))
    text = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", "")
    return F.regexp_replace(F.regexp_replace(text, r"\s*```$", ""), r"^\s+|\s+$", "")


def embedded_object(c: Column | str) -> Column:
    """From the first { to the last }, null without both."""
    return F.nullif(F.regexp_extract(as_column(c), r"(?s)(\{.*\})", 1), F.lit(""))


def _object(text: Column) -> Column:
    """The JSON object as a variant, null for anything else."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def judge_fields(c: Column | str) -> Column:
    """STRUCT(strategy, four scores, overall_score, reasoning) of a judge's answer.

    Strategies: 1 the text is JSON; 2 an object inside it is; 3 single scores by pattern;
    4 all scores 1.  Missing scores are 1; they are not clamped; a null or non-numeric
    score makes 1 and 2 fail.
    """
    text = strip_wrapping(F.coalesce(as_column(c), F.lit("")))
    first, second = _object(text), _object(embedded_object(text))

    def score(v: Column, field: str) -> Column:
        raw = F.try_variant_get(v, f"$.{field}", "double")
        return F.when(raw.isNull() & v.cast("string").contains(f'"{field}"'), None).otherwise(F.coalesce(raw, F.lit(1.0)).cast("int"))

    def fits(v: Column) -> Column:
        ok = v.isNotNull()
        for s in SCORES:
            ok = ok & score(v, s).isNotNull()
        return ok

    patterns = {s: F.nullif(F.regexp_extract(text, f'"{s}"\\s*:\\s*([1-5])', 1), F.lit("")).cast("int") for s in SCORES}
    any_score = F.coalesce(*patterns.values()).isNotNull()
    quoted = F.regexp_extract(text, r'"reasoning"\s*:\s*"([^"]*)"', 1)

    def answer(n: int, values: list[Column], reasoning: Column) -> Column:
        total = (values[0] + values[1] + values[2] + values[3]) / 4.0
        return F.struct(F.lit(n).alias("strategy"), *(v.alias(s) for s, v in zip(SCORES, values)), F.round(total, 2).alias("overall_score"), reasoning.alias("reasoning"))

    def from_json(n: int, v: Column) -> Column:
        return answer(n, [score(v, s) for s in SCORES], F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")))

    return (
        F.when(fits(first), from_json(1, first))
        .when(fits(second), from_json(2, second))
        .when(any_score, answer(3, [F.coalesce(p, F.lit(1)) for p in patterns.values()], F.when(quoted != "", quoted).otherwise(PARTIAL_REASONING)))
        .otherwise(answer(4, [F.lit(1)] * 4, F.lit(NO_REASONING)))
    )


def classifier_fields(c: Column | str) -> Column:
    """STRUCT(label, justification, cited_chunk_ids) of a classifier's answer: the text as
    JSON, an object inside it, else PARSE_ERROR with the raw answer."""
    raw = F.coalesce(as_column(c), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")

    def read(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        label, why = (F.trim(F.try_variant_get(v, f"$.{f}", "string")) for f in ("label", "justification"))
        strings = kind.rlike(r"\blabel: STRING\b") & kind.rlike(r"\bjustification: STRING\b") & kind.rlike(r"\bcited_chunk_ids: ARRAY")
        ids = F.filter(F.transform(F.try_variant_get(v, "$.cited_chunk_ids", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
        good = strings & (label != "") & (why != "")
        return F.when(good, F.struct(label.alias("label"), why.alias("justification"), F.coalesce(ids, F.array().cast("array<string>")).alias("cited_chunk_ids")))

    failed = F.struct(F.lit(vocab.PARSE_ERROR).alias("label"), raw.alias("justification"), F.array().cast("array<string>").alias("cited_chunk_ids"))
    return F.coalesce(read(_object(text)), read(_object(embedded_object(text))), failed)


def best_label(c: Column | str) -> Column:
    """The first label that contains the candidate or lies in it, else the candidate."""
    low = F.trim(F.lower(as_column(c)))
    out = None
    for label in vocab.LABELS:
        hit = low.contains(label.lower()) | F.lit(label.lower()).contains(low)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(as_column(c))


def english_reasoning(c: Column | str) -> Column:
    """Reasoning with Chinese characters is replaced by a fixed sentence."""
    return F.when(as_column(c).rlike("[\\u4e00-\\u9fff]"), CJK_REASONING).otherwise(as_column(c))


def score_band(c: Column | str) -> Column:
    """Bands of the overall score: [0,2], (2,3], (3,4], (4,5], else null."""
    x = as_column(c)
    return F.when((x >= 0) & (x <= 2), "0-2").when((x > 2) & (x <= 3), "2-3").when((x > 3) & (x <= 4), "3-4").when((x > 4) & (x <= 5), "4-5")


# --- messages ------------------------------------------------------------------------------------


def evidence_entry(rank: Column, limit: int = 600) -> Column:
    """One numbered entry of an evidence block; the article's text goes before the chunk's."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    body = F.when(part("article_text") != "", part("article_text")).otherwise(part("text"))
    cut = F.when(F.length(body) > limit, F.concat(F.substring(body, 1, limit), F.lit("…"))).otherwise(body)
    return F.concat(
        F.format_string("[%d] id=%s | %s | %s", rank, part("id"), part("document"), part("article")),
        F.when(part("article_subtitle") != "", F.concat(F.lit(" — "), part("article_subtitle"))).otherwise(""),
        F.when(part("paragraph") != "", F.concat(F.lit(" | §"), part("paragraph"))).otherwise(""),
        F.lit("\n"),
        cut,
        F.lit("\n"),
    )


def evidence_blocks(runs: DataFrame, query: str, limit: int = 600) -> DataFrame:
    """(query, n_chunks, block): the entries of each query's chunks in rank order."""
    entries = runs.withColumn("entry", evidence_entry(F.col("rank"), limit)).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "entry"))).alias("e"))
    return entries.select(query, F.size("e").alias("n_chunks"), F.array_join(F.transform("e", lambda x: x["entry"]), "\n").alias("block"))


DEFAULT_TEMPLATES = {
    "classifier": ("Compare a recommendation with numbered legal evidence and answer in JSON.", "Recommendation:\n{recommendation}\n\nEvidence ({k} chunks):\n{evidence}\n"),
    "judge": ("Score a classification from 1 to 5 in four respects and answer in JSON.", "Recommendation:\n{recommendation}\n\nEvidence ({k} chunks):\n{evidence}\n\nLabel: {label}\nJustification: {justification}\nCited: {cited}\n"),
    "retry": ("Answer with one JSON object of four scores and a reasoning.", "Label: {label}\nJustification: {justification}\n"),
}


def messages(kind: str, values: dict[str, Column], templates: dict[str, tuple[str, str]] = DEFAULT_TEMPLATES) -> Column:
    """ARRAY<STRUCT<role, content>> with the user template's fields filled in; the template
    is cut at its fields, so that braces in values are kept as they are."""
    system, user = templates[kind]
    parts = [values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\{(\w+)\}", user))]
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.concat(*(F.coalesce(p, F.lit("")) for p in parts)).alias("content")),
    )


def rebuild_chunks(export: DataFrame, query: str) -> DataFrame:
    """(query, rank, chunk_id, document, article, text) from an exported classification row."""
    texts = F.filter(F.transform(F.split(F.coalesce("top_chunk_texts", F.lit("")), "\n---\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    ids = F.filter(F.transform(F.split(F.coalesce("top_chunk_ids", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    rows = export.select(query, texts.alias("t"), ids.alias("ids")).select(query, F.posexplode("t").alias("i", "text"), "ids")
    head = F.split(F.col("text"), "\n")[0]
    return rows.select(
        query,
        (F.col("i") + 1).alias("rank"),
        F.coalesce(F.get("ids", F.col("i")), F.format_string("generated_%d", F.col("i") + 1)).alias("chunk_id"),
        F.trim(F.regexp_extract(head, r"^\[(.*?)\s*\|\s*(.*?)\]", 1)).alias("document"),
        F.trim(F.regexp_extract(head, r"^\[(.*?)\s*\|\s*(.*?)\]", 2)).alias("article"),
        "text",
    )


# --- model steps ----------------------------------------------------------------------------------

Embed = Callable[[list[str]], np.ndarray]
Score = Callable[[list[tuple[str, str]]], list[float]]
Generate = Callable[[list[str]], list[str]]


def hashing_embedder(width: int = 64) -> Embed:
    """A deterministic stand-in for an embedding model: signed hashed words, unit norm."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % width] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def overlap_scorer(pairs: list[tuple[str, str]]) -> list[float]:
    """A deterministic stand-in for a cross-encoder: share of the query's words in the text."""
    out = []
    for q, t in pairs:
        a, b = set(re.findall(r"[^\W_]+", q.lower())), set(re.findall(r"[^\W_]+", t.lower()))
        out.append(len(a & b) / len(a) if a else 0.0)
    return out


def word_sparse_encoder(texts: list[str]) -> list[dict[str, float]]:
    """A deterministic stand-in for a learned sparse encoder: log1p of word counts."""
    out = []
    for t in texts:
        counts: dict[str, float] = {}
        for w in re.findall(r"[^\W_]+", t.lower()):
            counts[w] = counts.get(w, 0.0) + 1.0
        out.append({w: float(np.log1p(n)) for w, n in counts.items()})
    return out


def word_multi_encoder(width: int = 16, most: int = 200) -> Callable[[list[str]], list[np.ndarray]]:
    """A deterministic stand-in for a late-interaction encoder: a vector a word, ``most`` at most."""
    single = hashing_embedder(width)
    return lambda texts: [single(re.findall(r"[^\W_]+", t.lower())[:most] or [""]) for t in texts]


def _in_batches(model: Callable[[list[str]], object], texts: list[str], size: int) -> list:
    """The model's results, batches halved down to single texts where one does not fit into memory."""
    out: list = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        try:
            out.extend(model(part))
        except MemoryError:
            if size == 1:
                raise
            out.extend(_in_batches(model, part, max(1, size // 2)))
    return out


SparseEncode = Callable[[list[str]], list[dict[str, float]]]
MultiEncode = Callable[[list[str]], list[np.ndarray]]


def sparse_encode(df: DataFrame, id_col: str, text_col: str, make: Callable[[], SparseEncode], prefix: str = "", batch: int = 32) -> DataFrame:
    """(id, terms, weights) by a sparse encoder, each text after ``prefix``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            found = _in_batches(model, [prefix + (t or "") for t in b.column(1).to_pylist()], batch)
            yield pa.record_batch([b.column(0), pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))], names=["id", "terms", "weights"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(step, f"id {kind}, terms array<string>, weights array<double>")


def multi_encode(df: DataFrame, id_col: str, text_col: str, make: Callable[[], MultiEncode], batch: int = 32) -> DataFrame:
    """(id, vector): one array of vectors a text."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            found = _in_batches(model, [t or "" for t in b.column(1).to_pylist()], batch)
            yield pa.record_batch([b.column(0), pa.array([np.asarray(x, dtype=np.float32).tolist() for x in found], pa.list_(pa.list_(pa.float32())))], names=["id", "vector"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(step, f"id {kind}, vector array<array<float>>")


def embed(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Embed], batch: int = 32) -> DataFrame:
    """(id, vector); the model is made once a task and fed batches, halved down to single
    texts where one does not fit into memory."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()

        for b in batches:
            vectors = _in_batches(model, [t or "" for t in b.column(1).to_pylist()], batch)
            yield pa.record_batch([b.column(0), pa.array([np.asarray(v, dtype=np.float32) for v in vectors], pa.list_(pa.float32()))], names=["id", "vector"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(step, f"id {kind}, vector array<float>")


def rerank(candidates: DataFrame, by: list[str], key: str, query_text: str, text: str, k: int, make: Callable[[], Score] = lambda: overlap_scorer) -> DataFrame:
    """The k best candidates of each group by a pair scorer: (by, key, score, rank)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        n = len(by) + 1
        for b in batches:
            s = score([(q or "", t or "") for q, t in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())])
            yield pa.record_batch([*(b.column(i) for i in range(n)), pa.array(s, pa.float64())], names=[*by, key, "score"])

    schema = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in [*by, key]) + ", score double"
    scored = candidates.select(*by, key, query_text, text).mapInArrow(step, schema)
    from normloom.operators.ranking import topk

    return topk(scored, by, "score", key, k)


def generate(prompts: DataFrame, id_col: str, prompt_col: str, make: Callable[[], Generate]) -> DataFrame:
    """(id, answer); the model is made once a task and asked a batch at a time."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model([p or "" for p in b.column(1).to_pylist()]), pa.string())], names=["id", "answer"])

    kind = prompts.schema[id_col].dataType.simpleString()
    return prompts.select(F.col(id_col).alias("id"), F.col(prompt_col)).mapInArrow(step, f"id {kind}, answer string")


def judged(prompts: DataFrame, id_col: str, prompt_col: str, retry_col: str, make: Callable[[], Generate]) -> DataFrame:
    """(id, answer, j): each prompt's answer with the judge's fields; where nothing could be
    read from it, the answer to ``retry_col``, asked once."""
    first = cut(generate(prompts, id_col, prompt_col, make).withColumn("j", judge_fields("answer")))
    unread = first["j.reasoning"].startswith("PARSE_ERROR")
    again = prompts.join(first.where(unread).select(F.col("id").alias(id_col)), id_col, "left_semi")
    second = generate(again, id_col, retry_col, make).withColumn("j", judge_fields("answer"))
    return first.where(~unread).unionByName(second)

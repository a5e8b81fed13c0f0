from __future__ import annotations

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normloom.operators import judging
from normloom.sources import csv_records, csv_sources, stores
from normloom.streaming import events

FULL = '{"label_score": 5, "justification_score": 4, "evidence_score": 3, "completeness_score": 2, "reasoning": "ok"}'


def test_judge_answers(spark):
    raw = {
        FULL: (1, 5, 3.5, "ok"), "```json\n" + FULL + "\n```": (1, 5, 3.5, "ok"), "<think>x {1}</think>Here: " + FULL + " done": (2, 5, 3.5, "ok"), '{"label_score": 4, "reaso': (3, 4, 1.75, judging.PARTIAL_REASONING),
        '{"label_score": 4, "reasoning": "cut"': (3, 4, 1.75, "cut"), "nothing": (4, 1, 1.0, judging.NO_REASONING), "[1, 2]": (4, 1, 1.0, judging.NO_REASONING), "<think>open": (4, 1, 1.0, judging.NO_REASONING),
        '{"label_score": null, "evidence_score": 3}': (3, 1, 1.5, judging.PARTIAL_REASONING), '{"label_score": 9}': (1, 9, 3.0, ""), '{"other": 1}': (1, 1, 1.0, ""),
    }
    df = spark.createDataFrame([(x,) for x in raw] + [(None,)], "raw string").select("raw", judging.judge_fields("raw").alias("f")).select("raw", "f.*")
    got = {r.raw: (r.strategy, r.label_score, r.overall_score, r.reasoning) for r in df.collect()}
    assert {k: got[k] for k in raw} == raw and got[None][0] == 4


def test_classifier_answers(spark):
    good = '{"label": "Aligned ", "justification": " why", "cited_chunk_ids": ["a", " ", 3]}'
    raw = [good, "x " + good + " y", '{"label": "A", "justification": {"n": 1}, "cited_chunk_ids": []}', '{"label": "", "justification": "w", "cited_chunk_ids": []}', "no", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").select("i", judging.classifier_fields("raw").alias("f"))
    got = [r.f for r in df.orderBy("i").collect()]
    assert [tuple(g) for g in got[:2]] == [("Aligned", "why", ["a", "3"])] * 2
    assert [g.label for g in got[2:]] == ["PARSE_ERROR"] * 4 and got[4].justification == "no"


def test_labels_and_reasoning(spark):
    df = spark.createDataFrame([("not aligned",), ("conflict",), ("beyond compliance!",), ("zzz",)], "c string")
    assert [r.x for r in df.select(judging.best_label("c").alias("x")).collect()] == ["Aligned", "Conflicting", "Beyond compliance", "zzz"]
    assert spark.range(1).select(judging.english_reasoning(F.lit("磁体"))).first()[0] == judging.CJK_REASONING
    bands = spark.createDataFrame([(x,) for x in (0.0, 2.0, 2.25, 3.0, 4.0, 4.5, 6.0)], "s double").select(judging.score_band("s").alias("b")).collect()
    assert [r.b for r in bands] == ["0-2", "0-2", "2-3", "2-3", "3-4", "4-5", None]


def test_messages_keep_braces(spark):
    m = judging.messages("retry", {"label": F.lit("{justification}"), "justification": F.lit("b{0}")})
    assert spark.range(1).select(m.alias("m")).first().m[1].content == "Label: {justification}\nJustification: b{0}\n"


def test_exports_and_back(spark):
    rows = [(1, 2, "c2", "WEEE", "Article 2", "text two"), (1, 1, "c1", "ESPR", None, "x" * 500), (1, 3, "c3", "CEAP", "", None)]
    runs = spark.createDataFrame(rows, "q int, rank int, id string, document string, article string, text string")
    e = stores.prompt_export(runs, ["q"])
    r = e.first()
    assert r.retrieved_documents == "CEAP; ESPR; WEEE" and r.retrieved_articles == "Article 2" and r.top_chunk_ids == "c1; c2; c3"
    assert r.retrieved_evidence_groups == "binding_law; policy_or_recommendation_docs"
    back = [tuple(x) for x in judging.rebuild_chunks(e, "q").orderBy("rank").select("rank", "chunk_id", "document", "article").collect()]
    assert back == [(1, "c1", "ESPR", ""), (2, "c2", "WEEE", "Article 2"), (3, "c3", "CEAP", "")]


def test_model_steps(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k bigint, t string")
    v = {r.id: r.vector for r in judging.embed(df, "k", "t", judging.hashing_embedder).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1, rel=1e-5) and not any(v[2])

    def small_memory():
        def model(texts):
            if len(texts) > 1:
                raise MemoryError
            return judging.hashing_embedder()(texts)

        return model

    assert {r.id: r.vector for r in judging.embed(df, "k", "t", small_memory).collect()} == v
    c = spark.createDataFrame([(1, 5, "old pump", "a pump"), (1, 6, "old pump", "an old pump"), (1, 7, "old pump", None)], "q int, c int, qt string, t string")
    assert [r.c for r in judging.rerank(c, ["q"], "c", "qt", "t", 2).orderBy("rank").collect()] == [6, 5]
    p = spark.createDataFrame([(1, "bad", "{}"), (2, "{}", "bad"), (3, 'thinking "label_score": 4 and no more', "{}"), (4, "bad", "worse")], "k bigint, p string, again string")
    got = {r.id: (r.answer, r.j.strategy) for r in judging.judged(p, "k", "p", "again", lambda: (lambda xs: list(xs))).collect()}
    assert got == {1: ("{}", 1), 2: ("{}", 1), 3: ('thinking "label_score": 4 and no more', 3), 4: ("worse", 4)}


# --- delivered CSV ----------------------------------------------------------------------------

GOOD = ["Paper 1", "12", "", "Keep registers.", "as said", "Statement", "REACH", "Regulation", "", "", "", "explicit_mention", "", "", "Aligned"]
HEADER = ",".join(csv_records.COLUMNS)


def _raw(fields, delimiter=","):
    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="").writerow(fields)
    return out.getvalue()


def _with(**kw):
    return [kw.get(c, v) for c, v in zip(csv_records.COLUMNS, GOOD)]


CASES = {
    _raw(GOOD): None, _raw(_with(recommendation_text='He said "no",\nthen left')): None, _raw(_with(source_page=" 7 ")): None, _raw(_with(needs_review="YES ")): None,
    _raw(GOOD[:-1]): "column_count", _raw([*GOOD, "x"]): "column_count", "": "column_count", "TOTAL,36": "column_count",
    'a,"b" c,d': "quoting", 'a,b"c,d': "quoting", 'a,"open': "quoting", "a,b\nc": "quoting", 'a, "b"': "quoting", 'a,"b\\"c"': "quoting",
    _raw(_with(source_page="p. 4")): "invalid_value", _raw(_with(source_line="1e3")): "invalid_value", _raw(_with(source_line="٣")): "invalid_value", _raw(_with(recommendation_text="-")): "invalid_value",
    _raw(_with(doc_short_name="bad �")): "invalid_value", _raw(_with(reference_basis="")): "invalid_value", _raw(_with(alignment_label="maybe")): "invalid_value", _raw(_with(doc_short_name="")): "invalid_value",
}


def test_records_with_reasons(spark):
    rows = [(0, "f", 1, "﻿" + HEADER)] + [(i, "f", i + 1, raw) for i, raw in enumerate(CASES, 1)]
    rows += [(900, "semi", 1, HEADER.replace(",", ";")), (901, "semi", 2, _raw(GOOD, ";")), (902, "semi", 3, _raw(GOOD)), (903, "no header", 2, _raw(GOOD, "\t")), (904, None, 3, _raw(GOOD)), (905, "f", None, None), (None, "f", 9, _raw(GOOD))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id bigint, file_name string, record_no int, raw string, reason string").repartition(4)
    out = csv_records.parse_records(df).collect()
    got = {r.record_id: r.reason for r in out}
    assert {raw: got[i] for i, raw in enumerate(CASES, 1)} == CASES
    assert (got[901], got[902], got[903], got[904], got[905], got[None]) == (None, "column_count", None, None, "column_count", None)
    assert 0 not in got and 900 not in got
    row = next(r for r in out if r.record_id == 1)
    assert (row.source_page, row.source_line, row.recommendation_or_statement, row.doc_short_name) == (12, None, "statement", "REACH")
    assert csv_records.parse_records(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab,;"\n\r ', max_size=6), min_size=1, max_size=5), st.sampled_from([",", ";"]))
def test_well_formed_records_come_back(fields, delimiter):
    def enc(v):
        return '"' + v.replace('"', '""') + '"' if any(c in v for c in '"\n\r' + delimiter) or (v and random.Random(v).random() < 0.3) else v

    assert csv_records.parse_record(delimiter.join(map(enc, fields)), delimiter) == fields


def test_delivered_files(spark, tmp_path):
    text = "﻿Paper;recommendation;document;alignment_label\nP1;\"two\nlines\";WEEE;\nP2;x \"\"y;REACH;Aligned\n"
    (tmp_path / "gold.csv").write_text(text, encoding="utf-8")
    assert csv_sources.sniff(text) == ";" and csv_sources.decode("é".encode("cp1252")) == "é"
    rows = csv_sources.load_gold(csv_sources.read_csv(spark, str(tmp_path / "gold.csv"))).collect()
    assert [(r.paper, r.recommendation_text, r.doc_short_name, r.alignment_label) for r in rows][0] == ("P1", "two\nlines", "WEEE", None)
    cut = csv_sources.read_records(spark, str(tmp_path)).orderBy("record_no").collect()
    assert [r.record_no for r in cut] == [1, 2, 3] and "\n" in cut[1].raw
    with pytest.raises(FileNotFoundError):
        csv_sources.read_files(spark, str(tmp_path), "*.html")


def test_each_file_has_its_own_encoding_and_separator(spark, tmp_path):
    long = "x" * 30_000  # what decides stands far behind any head
    (tmp_path / "a.csv").write_bytes(f"section;title;recommendation\n1;a;{long}, one, two\n2;b;Stück\n".encode("cp1252"))
    (tmp_path / "b.csv").write_text("title,recommendation,extra\nc,\"déjà; vu\",\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("", encoding="utf-8")
    df = csv_sources.read_csv(spark, str(tmp_path), places=True)
    assert set(df.columns) == {"section", "title", "recommendation", "extra", "_file", "_row"}
    got = {r.title: (r.section, r.recommendation, r.extra, r._row) for r in df.collect()}
    assert got == {"a": ("1", long + ", one, two", None, 1), "b": ("2", "Stück", None, 2), "c": (None, "déjà; vu", None, 1)}
    with pytest.raises(FileNotFoundError):
        csv_sources.read_csv(spark, str(tmp_path / "c.csv"))
    (tmp_path / "w.csv").write_text("section;recommendation\n1,1;a, b\n", encoding="utf-8")
    assert csv_sources.read_whitepaper(spark, str(tmp_path / "w.csv")).first().text == "a, b"


def test_poison_records(spark):
    """Numbers that no bigint holds, one of more digits than int() takes."""
    big = ["9" * 5_000, str(2**63), str(2**63 - 1), "0" * 5_000 + "7"]
    rows = [(0, "f", 1, HEADER)] + [(i, "f", i + 1, _raw(_with(source_page=x))) for i, x in enumerate(big, 1)]
    out = {r.record_id: (r.reason, r.source_page, r.beyond) for r in csv_records.parse_records(spark.createDataFrame(rows, "record_id bigint, file_name string, record_no int, raw string")).collect()}
    assert out == {1: (None, None, "source_page"), 2: (None, None, "source_page"), 3: (None, 2**63 - 1, None), 4: (None, 7, None)}


def test_chunk_and_recommendation_loading(spark):
    c = csv_sources.load_chunks(spark.createDataFrame([("", "t", None), ("i", None, "7"), ("j", "u", "x")], "id string, text string, char_offset string")).orderBy("id").collect()
    assert [r.char_offset for r in c] == [0, 7, 0] and c[0].id.startswith("i") is False or c[0].article_text == ""
    first = csv_sources.merge_chunks([spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), spark.createDataFrame([("a", 0), ("c", 3)], "id string, n int")], "n")
    assert {(r.id, r.n) for r in first.collect()} == {("a", 1), ("b", 2), ("c", 3)}
    r = csv_sources.load_recommendations(spark.createDataFrame([("S", "T", None), ("S", None, "x")], "section string, title string, text string")).collect()
    assert [x.text for x in r] == ["S  T", "x"] or [x.text for x in r] == ["S T", "x"]
    q = spark.createDataFrame([(1, "a"), (2, " ")], "query int, text string")
    rel = spark.createDataFrame([(1, 5, 1), (1, 6, 0), (2, 5, 1)], "query int, doc int, score int")
    kept, qrels = csv_sources.queries_and_qrels(q, rel)
    assert kept.count() == 1 and [tuple(x) for x in qrels.collect()] == [(1, 5)]
    with pytest.raises(ValueError):
        csv_sources.queries_and_qrels(q.unionAll(q), rel)
    corpus = csv_sources.corpus_chunks(spark.createDataFrame([(2, "T", "b"), (1, "", " "), (3, None, "c")], "n int, title string, text string"), "n", 2).collect()
    assert [(x.doc, x.text) for x in corpus] == [(2, "T\nb")]


def test_index_and_steps(spark, tmp_path):
    docs = spark.createDataFrame([(1, "steel pump"), (2, "steel")], "k bigint, t string")
    path = str(tmp_path / "index")
    assert not stores.index_exists(spark, path)
    stores.save_index(docs, "k", "t", path)
    index = stores.load_index(spark, path)
    assert index["postings"].count() == 3 and index["term_idf"].count() == 2
    stores.mark_done(spark, str(tmp_path), "step", {"n": 1})
    assert stores.is_done(spark, str(tmp_path), "step") and not stores.is_done(spark, str(tmp_path), "other")
    assert not stores.write_csv(docs.limit(0), str(tmp_path / "none"), skip_empty=True) and stores.write_csv(docs, str(tmp_path / "some"))
    split = tmp_path / "data" / "en"
    docs.write.parquet(str(split / "corpus"))
    assert csv_sources.load_split(spark, str(tmp_path / "data"), "en", "corpus").count() == 2


def test_streams_are_like_batches(spark, small, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{small}/events.parquet").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for f in (events.event_counts, events.sessions):
        batch = sorted(map(str, f(spark.read.parquet(src)).collect()))
        name = f"mem_{f.__name__}"
        q = f(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName(name).outputMode("complete" if f is events.event_counts else "append").trigger(availableNow=True).start()
        q.awaitTermination()
        streamed = sorted(map(str, spark.table(name).collect()))
        assert streamed == batch if f is events.event_counts else set(streamed) <= set(batch)

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from normloom.functions import text as T


def _one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.orderBy("i").select(column.alias("x")).collect()]


def test_clean_text_handles_every_kind_of_space(spark):
    got = _one(spark, T.clean_text("c"), "▼B a b c\t\n d ", "►M12text", "► M1 x", "▼B6", None, "", "x▲A1.")
    assert got == ["a b c d", "►M12text", "► M1 x", "", None, "", "x."]


def test_tokens(spark):
    got = _one(spark, T.tokens("c"), '"The (old) registers," it\'s [x] a. ab', "a bc", None, "..")
    assert got == [["the", "old", "registers", "it's", "ab"], ["bc"], [], []]


def test_sentences(spark):
    assert _one(spark, T.sentences("c"), "One. two? Three!  four", "no end") == [["One.", "two?", "Three!", "four"], ["no end"]]
    assert _one(spark, T.capital_sentences("c"), "One. two? Three") == [["One. two?", "Three"]]


@pytest.mark.parametrize("value", ["it's eu-law", "NET zero x", "", "a", "été d'hiver 3x", "ABC"])
def test_title_case_is_pythons(spark, value):
    assert _one(spark, T.title_case("c"), value) == [value.title()]


def test_document_names(spark):
    names = ["net", " WEE ", "a breach of law", "BETWEEN", "com(2020)98", "European Green Deal", "it's own", "Net-Zero Industry Act", "wee-", "Packaging and packaging waste"]
    assert _one(spark, T.document_name("c"), *names) == ["Net-Zero", "WEEE", "REACH", "Between", "CEAP", "Green Deal", "It'S Own", "Net-Zero", "WEEE", "PPWR"]
    assert _one(spark, T.evidence_group("c"), "reach", "CEAP") == ["binding_law", "policy_or_recommendation_docs"]


def test_file_names(spark):
    paths = ["/a/ROHS-01.01.2025.html", "WEE- 08.04.2024.html", "Net-Zero x.html", "plain.html"]
    assert _one(spark, T.file_short_name("c"), *paths) == ["RoHS", "WEEE", "NET", "PLAIN"]
    assert _one(spark, T.file_version("c"), *paths) == ["01.01.2025", " 08.04.2024", "Zero x", ""]


def test_fingerprint_keeps_double_blanks(spark):
    assert _one(spark, T.fingerprint("c"), "A - b,  c" + "d" * 300)[0] == ("a  b c" + "d" * 300)[:220]


def test_other_functions(spark):
    assert _one(spark, T.semicolon_values("c"), "a; b;;c ", None) == [["a", "b", "c"], []]
    assert _one(spark, T.first_filled("c", F.lit("z")), " ", None, "x") == ["z", "z", "x"]
    assert _one(spark, T.safe_file_name("c"), "a b/c?.csv") == ["a_b_c_.csv"]
    assert _one(spark, T.with_prefix("c", "e5-small", True), "t") == ["passage: t"]
    assert _one(spark, T.with_prefix("c", "other", False), "t") == ["t"]
    (key,) = _one(spark, T.chunk_id(F.lit("D"), F.lit(None).cast("string"), F.lit("1"), "c"), "text")
    assert re.fullmatch(r"D\|\|1\|[0-9a-f]{8}", key)

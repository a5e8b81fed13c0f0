from __future__ import annotations

import pytest

from normloom.functions import stem


@pytest.mark.parametrize(
    ("word", "want"),
    [  # examples of the paper
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("hopefulness", "hope"), ("triplicate", "triplic"),
        ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"),
        ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("recycling", "recycl"), ("recycled", "recycl"), ("recyclable", "recycl"), ("is", "is"),
    ],
)
def test_stems(word, want):
    assert stem.stem(word) == want


def test_stemmed_tokens(spark):
    df = spark.createDataFrame([("The operators shall not be recycling.",), (None,)], "t string")
    assert [r.x for r in df.select(stem.stemmed_tokens("t").alias("x")).collect()] == [["oper", "shall", "recycl"], []]

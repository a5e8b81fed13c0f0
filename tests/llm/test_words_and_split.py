from __future__ import annotations

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from normloom.llm import split_tree
from normloom.llm.words import flat_words, window_hashes

WORD = re.compile(r"[^\W_]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    words = [WORD.findall((t or "").lower()) for t in texts]
    found = flat_words(texts, slice_chars=25)
    assert list(np.diff(found.offsets)) == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    seen = {}
    for w, h in zip(flat, found.hashes):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside_texts():
    found = flat_words(["a b c", "", None, "d e", "f g h i"])
    hashes, owner, start = window_hashes(found, (0, 2))
    assert list(owner) == [0, 4, 4]
    assert list(start) == [0, 5, 6]
    assert len(set(hashes)) == 3


def _pieces(text, limit=100, overlap=20):
    return split_tree.split(text, limit, overlap)


def _check(text, limit=100, overlap=20):
    whole = split_tree.clean(text)
    pieces = _pieces(text, limit, overlap)
    if len(whole) <= limit:
        assert pieces == []
        return
    at = 0
    for k, (start, shared, _, piece) in enumerate(pieces):
        assert 0 < len(piece) <= limit
        assert 0 <= shared <= overlap and (k or not shared)
        assert whole[start : start + len(piece)] == piece
        assert start + shared == at or whole[at : start + shared].strip() == ""
        at = start + len(piece)
        while at < len(whole) and whole[at] == " ":
            at += 1
    assert at == len(whole)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .;,\n(1)▼B  \t-", max_size=700))
def test_pieces_give_the_clean_text_back(text):
    _check(text)


def test_pieces_of_structured_text_end_at_boundaries():
    lines = [f"Article {i}\nThe operator shall keep the register number {i} for ten years. It may be kept in electronic form.\n" for i in range(1, 40)]
    pieces = split_tree.split("\n".join(lines), 600, 80)
    assert len(pieces) > 5
    assert all(p.endswith("form.") for *_, p in pieces)
    assert all(0 <= s <= 80 for _, s, *_ in pieces)


def test_headings_and_their_depths():
    depth = {"GENERAL PROVISIONS": 2, "Chapter II": 1, "CHAPTER IV Penalties": 1, "Article 5": 3, "Artikel 12 Meldungen": 3, "TITLE I": 0, "Annex III Forms": 0, "### Scope": 2, "1.2. Aims": 4}
    assert {x: split_tree._depth(x) for x in depth} == depth
    text = ["Article 5 shall apply to all operators.", "2020/1234 - 55", "chapter 4 of the act", "The operator", "section", "Part of the register", "A B", "1. An item", "x" * 200]
    assert [split_tree._depth(x) for x in text] == [None] * len(text)


def test_parts_nest_and_cuts_fall_at_the_strongest_boundary():
    """A chapter that fits stays whole; one that does not is cut at its articles."""
    article = lambda i: f"Article {i}\nThe operator shall keep the register {i} for ten years. It may be kept in electronic form.\n"
    text = "Chapter I\n" + "".join(map(article, range(1, 5))) + "Chapter II\n" + "".join(map(article, range(5, 17))) + "Chapter III\n" + "".join(map(article, range(17, 20)))
    pieces = split_tree.split(text, 500, 0)
    assert {p.boundary for p in pieces} <= {"start", "chapter", "article"}
    assert sum(p.boundary == "chapter" for p in pieces) == 2 and pieces[0].text.endswith("form.") and pieces[-1].text.startswith("Chapter III")
    assert all(p.text.startswith(("Chapter", "Article")) for p in pieces)


def test_weak_boundaries_are_merged_first():
    text = "First paragraph, a sentence. Another one.\n\nSecond paragraph, a sentence. Another one here."
    assert [p.text for p in split_tree.split(text, 50, 0)] == ["First paragraph, a sentence. Another one.", "Second paragraph, a sentence. Another one here."]
    long = " ".join(f"Sentence {i} of many in this paragraph." for i in range(60)) + "\n\n" + " ".join(f"Sentence {i} of the next." for i in range(60))
    assert {p.boundary for p in split_tree.split(long, 400, 50)} <= {"start", "sentence", "paragraph"}


def test_words_over_the_limit_are_cut():
    _check("x" * 1000)
    _check("x" * 50 + " " + "y" * 450 + ". end")


def test_empty_and_null():
    assert split_tree.split(None) == [] and split_tree.split("") == [] and split_tree.split(" \n ") == []
    assert split_tree.split("short", keep_small=True) == [(0, 0, "start", "short")]


def test_split_oversized_rows(spark):
    long = "Sentence number one is here. " * 30
    rows = [(1, long, None, "x"), (2, "short", long, "x"), (None, long, long, "x"), (3, None, "", "x"), (4, "▼B1 " * 300, "", "x")]
    df = spark.createDataFrame(rows, "k bigint, text string, article_text string, field string")
    out = split_tree.split_oversized(df, "k", ["text", "article_text"], 200, 40).collect()
    assert {(r.id, r.field) for r in out} == {(1, "text"), (2, "article_text")}
    assert all(len(r.text) <= 200 and r.piece_no <= r.n_pieces for r in out)
    empty = split_tree.split_oversized(df.limit(0), "k", ["text"], 200, 40)
    assert empty.count() == 0


def test_random_texts_at_production_size():
    rng = random.Random(4)
    for _ in range(10):
        text = "".join(rng.choice(["word ", "longer-word ", "end. ", "\n", "\n\n", "(a) item; ", "1. ", "clause, "]) for _ in range(1500))
        _check(text, 2400, 320)

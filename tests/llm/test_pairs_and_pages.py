from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from normloom.llm import page_body, pair_defects

ENGLISH = ["The producers shall keep the registers of the goods that they place on the market.", "It remains open whether the fees for the repair of old machines can be lowered.", "Member States may ask for a report on the goods that were sold in the last year.", "This label is plausible because the article obliges importers to test each device.", "The evidence is thin, although the authorities publish it without delay in the register."]
GERMAN = ["Die Hersteller müssen die Register der Waren führen, die sie auf den Markt bringen.", "Es ist offen, ob die Gebühren für die Reparatur alter Maschinen gesenkt werden können.", "Die Mitgliedstaaten können einen Bericht über die im letzten Jahr verkauften Waren verlangen.", "Diese Einstufung ist nachvollziehbar, weil der Artikel die Einführer zur Prüfung verpflichtet.", "Die Belege sind dünn, obwohl die Behörden sie unverzüglich im Register veröffentlichen."]
PROMPT = "Recommendation: Importers should test each device before they sell it.\nLabel: Aligned\nJustification: The article obliges importers to test each device within ten days of receipt.\nIs the label right? Answer with scores."


@pytest.fixture(scope="module")
def languages(spark):
    rows = [(i, t, x) for x, texts in (("en", ENGLISH), ("DE", GERMAN)) for i, t in enumerate(texts * 4)] + [(99, ENGLISH[0], "und"), (98, None, "en"), (97, GERMAN[0], None)]
    return pair_defects.fit_languages(spark.createDataFrame(rows, "k bigint, text string, lang string"), "k", "text", "lang")


def _json(reasoning):
    return '{"label_score": 4, "justification_score": 2, "evidence_score": 3, "completeness_score": 5, "reasoning": "%s"}' % reasoning


CASES = {
    "": "empty", "null": "empty", "{}": "empty", "<think>\nfine\n</think>": "empty", "```json\n```": "empty", _json("n/a"): "empty", "​": "empty", "{\"label_score\": 3}": "empty",
    _json(ENGLISH[3])[:-30]: "truncated", '{"label_score": 4, "justif': "truncated", "<think>The label": "truncated", ENGLISH[3] + " The evidence is thin on the": "truncated",
    "I'm sorry, but I can't provide an evaluation of legal texts.": "refusal", _json("Leider kann ich dazu keine Bewertung abgeben."): "refusal",
    _json("Importers should test each device before they sell them."): "copied_prompt", "The question was: Importers should test each device before they sell it.": "copied_prompt",
    _json(GERMAN[3] + " " + GERMAN[4]): "other_language", "如果磁体部件超过电池库存的百分之七十九，主管机关可以单独限制。": "other_language",
    _json(ENGLISH[3]): None, "Label: 4/5, justification: 3/5.\n" + ENGLISH[4]: None, "The label fits.": None, "```json\n" + _json(ENGLISH[4]) + "\n```": None,
    _json("I cannot see how the second passage helps; sorry to say, it is off topic."): None, _json("The German text reads “" + GERMAN[0] + "”, which supports this view of the authorities."): None,
}


def test_defects(spark, languages):
    assert languages.names == ["de", "en"]
    sound = [(1000 + i, PROMPT, _json(t)) for i, t in enumerate(ENGLISH * 20)]
    cases = [(i, PROMPT, raw) for i, raw in enumerate(CASES)]
    rows = [*sound, *cases, (500, None, _json(ENGLISH[0])), (501, PROMPT, None), (None, PROMPT, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, prompt string, raw string, defect string").repartition(3)
    got = {r.id: r.defect for r in pair_defects.pair_defects(df, "id", "prompt", "raw", languages).collect()}
    assert {raw: got[i] for i, raw in enumerate(CASES)} == CASES
    assert all(got[i] is None for i, *_ in sound)
    assert got[500] is None and got[501] == "empty" and None not in got
    assert pair_defects.pair_defects(df.limit(0), "id", "prompt", "raw", languages).count() == 0


def test_an_end_found_nowhere_else_does_not_speak_for_itself(spark, languages):
    cut = _json(ENGLISH[3] + " As was said by Ms Wojciechowska-Przybysz")
    rows = [(i, PROMPT, _json(t)) for i, t in enumerate(ENGLISH * 20)] + [(1000, PROMPT, cut)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, raw string")
    got = {r.id: r.defect for r in pair_defects.pair_defects(df, "id", "prompt", "raw", languages).collect()}
    assert got.pop(1000) == "truncated" and set(got.values()) == {None}


def test_own_end_is_taken_off_the_counts(spark):
    alone = pair_defects.fit_ends(spark.createDataFrame([(_json("Seen by Ms Wojcie"),)], "raw string"))
    assert 0 < pair_defects.end_likelihood(alone, "Seen by Ms Wojcie") <= 0.01  # the base, less what the short contexts say


def test_closed_wrappings_with_remarks():
    broken = '{"label_score": 3, "reasoning": "It is so.", "x": }'  # no JSON, but closed
    for remark in ("", " Done.", "\n\nThat is my answer, I hope it helps"):
        assert pair_defects.answer(broken + remark) == ("closed", "It is so.")
    assert pair_defects.answer('{"label_score": {"a": 1}, "reasoning": "It is') [0] == "open"


def test_short_texts_of_few_labels_and_long_ones_are_fitted(spark):
    rows = [(i, "en", "the register and the rules of this place " * 2_000) for i in range(5)] + [(i + 10, "de", "und die Regeln") for i in range(5)] + [(30, "xx", "x y z"), (31, "fr", "les règles")]
    found = pair_defects.fit_languages(spark.createDataFrame(rows, "i bigint, l string, t string"), "i", "t", "l")
    assert found.names == ["de", "en"]
    assert pair_defects.fit_languages(spark.createDataFrame(rows, "i bigint, l string, t string"), "i", "t", "l", least_texts=1).names == ["de", "en", "fr"]


def test_held_out_language_accuracy(languages):
    held = {"en": ["Operators may not sell the goods before the test has been done.", "He asked whether they would come back in the spring."], "de": ["Die Betreiber dürfen die Waren vor der Prüfung nicht verkaufen.", "Er fragte, ob sie im Frühjahr wiederkommen würden."]}
    assert all(languages.of(t)[0] == name for name, texts in held.items() for t in texts)


PAGE = """Home | News | Contact | Search
Home > Topics > Rules on old mach
Rules on old machines
Last updated 3 May 2024 · 4 min read
Producers shall keep the registers of the goods that they place on the market, and make them available.

Background
- old machines
- new machines
Article continues below
Article 5 does not apply to the storage of cookies on machines that the firm leases to others.
Subscribe models for machines need a separate contract, as importers explained to the authorities.
Related articles
> New rules on pumps (3 May)
Notes on steel – read more
We use cookies to measure visits. Accept all | Reject
© 2024 Some Site. All rights reserved."""
FRAME = {1, 2, 4, 10, 13, 14, 15, 16, 17}


def test_frame_lines(spark):
    rows = [(1, PAGE), (2, ""), (3, None), (4, "Only a body line that says what it has to say.\n \n"), (5, "Home\nSearch\nContact"), (None, PAGE), (6, PAGE)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k bigint, text string, line_no int")
    out = page_body.page_lines(df, "k", "text").collect()
    for k in (1, 6):
        assert {r.line_no for r in out if r.chunk_idx == k and r.is_frame} == FRAME
    assert [(r.line_no, r.is_frame) for r in out if r.chunk_idx == 4] == [(1, False)]
    assert {r.is_frame for r in out if r.chunk_idx == 5} == {True}
    assert not [r for r in out if r.chunk_idx in (2, 3, None)]
    bodies = {r.chunk_idx: r.body for r in page_body.page_bodies(df, "k", "text").collect()}
    assert bodies[1].split("\n")[0] == "Rules on old machines" and bodies[2] == bodies[3] == ""
    assert page_body.page_lines(df.limit(0), "k", "text").count() == 0


REST = " of the pages on machines, pumps, steel, tyres and glass that the firms in the towns of the north place on the market"


@pytest.mark.parametrize("line", [
    "Powered by the tools" + REST, "Run with the editorial system" + REST, "The firm" + REST + ", Postbox 81", "Join us for the talks" + REST, "Stay informed on the rules" + REST,
    "Article continues below the notes" + REST, "Advertisement: the shop" + REST, "Call our helpdesk for the list" + REST, "The notes" + REST + " (members only)", "See the how we work part" + REST,
])
def test_frame_lines_of_any_length(line):
    assert len(line) > 110 and page_body.classify(line) in page_body.FRAME


def test_long_sentences_are_prose():
    assert page_body.classify("The firms keep a register" + REST + ".") == "prose"


ITALIAN = ["Pagina iniziale", "Il ministero risponde alle domande dei cittadini", "Tutti i diritti sono riservati al ministero, anno {}"]


def _italian(i):
    w = chr(97 + i) * 6
    body = [f"Regola {w} sulle macchine", "", "Contesto", f"Il produttore {w} tiene il registro delle macchine per dieci anni dalla vendita.", f"- macchina usata {w}", f"- macchina nuova {w}"]
    return "\n".join([ITALIAN[0], ITALIAN[1], *body, "  " + ITALIAN[2].format(2000 + i).upper()])


def test_lines_that_a_site_repeats_are_its_frame_in_any_language(spark):
    """Other words than those known, digits and case aside; a repeated heading stays body."""
    rows = [(i, f"sito.example/{i}.html", _italian(i)) for i in range(12)] + [(100, None, _italian(3)), (101, "other.example/1", _italian(4))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k bigint, f string, text string, site string").repartition(3)
    out = page_body.page_lines(df, "k", "text", F.substring_index("f", "/", 1)).collect()
    frames = {k: {r.line_no for r in out if r.chunk_idx == k and r.is_frame} for k, *_ in rows}
    assert all(frames[i] == {1, 2, 9} for i in range(12))
    assert not frames[100] & set(range(3, 9)) and not frames[101] & set(range(3, 9)) and len([r for r in out if r.chunk_idx == 100]) == 8
    bodies = {r.chunk_idx: r.body for r in page_body.page_bodies(df, "k", "text", F.substring_index("f", "/", 1)).collect()}
    assert bodies[5].startswith("Regola ffffff") and bodies[5].endswith("nuova ffffff") and len(bodies) == len(rows)


def test_keys_of_repeated_lines_may_be_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(page_body, "BROADCAST_KEYS", 0)
    df = spark.createDataFrame([(i, "s", _italian(i)) for i in range(8)] + [(None, "s", "x"), (9, "", None)], "k bigint, site string, text string")
    out = page_body.page_lines(df, "k", "text", F.col("site")).where("is_frame").groupBy("chunk_idx").count().collect()
    assert {r.chunk_idx: r["count"] for r in out} == {i: 3 for i in range(8)}


def test_long_page():
    lines, frame = page_body.frame_of_page("\n".join([PAGE] + ["The firm shall keep its register for ten years after the sale."] * 20_000))
    assert len(lines) > 20_000 and len(frame) < 20

"""Broken prompt and response pairs, each with its defect.

The answer is cut out of its wrapping (thinking tags, code fences, JSON, score
line) and tested in this order; the first defect counts:

``truncated``       the wrapping is never closed;
``empty``           no answer, or nothing or a placeholder where the reasoning belongs;
``refusal``         a statement of being unable or unwilling to judge;
``copied_prompt``   nearly all words of the reasoning stand in the prompt in the same order
                    (a reasoning of under ``LEAST_WORDS`` words is no copy);
``other_language``  the language posteriors of reasoning and prompt (character n-gram
                    naive Bayes, quotations left out) point to different languages (a text
                    of under ``LEAST_LETTERS`` letters has none);
``truncated``       the reasoning's last characters are not how texts end here: an
                    end-of-text n-gram model gives the likelihood that a text stops after them.

Two models are made from data.  The language model is fitted on at most
``samples_per_language`` labelled texts a language (those with the smallest hash
of the id; whole texts; a parameter, the same at every size); a label with fewer than
``least_texts`` texts in all is taken for a slip.  The end-of-text model counts over all
rows: per context of up to ``ORDERS[-1]`` characters how often a text goes on and how
often it stops there; longer contexts rest on shorter ones.  Its tables have a fixed size.

Nulls count as empty texts: a null response is ``empty``; a null prompt is never
copied and has no language.  Rows with a null id are left out; repeated rows give
repeated results; extra columns are ignored.  Without labelled texts no row is
``other_language``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "id bigint, defect string"
LANGUAGE_BITS = 15
END_BITS = 19
#: Contexts of so many characters: the n-grams of these orders are bounded by the languages,
#: not by the rows, so that the tables do not fill up with the data.
ORDERS = (1, 2, 3, 5)
END_BLOCKS = 8
LEAST_WORDS, LEAST_LETTERS = 5, 20

# Codes of no one language (ISO 639 and common habit).
NO_LANGUAGE = ("und", "mul", "zxx", "mis", "unk", "xx", "xxx", "na")
# What stands for no reasoning, and phrases of declining.
PLACEHOLDERS = frozenset(
    "null none nil n a na nan tbd todo tba string text empty reasoning explanation placeholder your reasoning here parse error no reasoning not available insert reasoning here undefined unknown lorem ipsum".split()
) | {"n a", "your reasoning", "your reasoning here", "no reasoning", "not available", "insert reasoning here", "parse error", "lorem ipsum", "to be done", "to be determined"}
REFUSALS = (
    r"\bi(?: am|'m)? (?:can(?:not|'t| not)|could(?: not|n't)|won't|will not|must not|may not|shall not|am not able to|am unable to|unable to|not able to|do not wish to|don't wish to|prefer not to|would rather not) (?:\w+ ){0,2}?(?:assess|rate|judge|score|evaluate|provide|give|offer|comply|answer|take a position|take a stance|help with|assist|comment|make|perform|complete|do (?:this|that)|fulfil|continue|engage|respond)",
    r"\bi (?:must|have to|need to|will have to) (?:decline|refuse|pass)",
    r"\bi (?:decline|refuse) to\b",
    r"\b(?:i am|i'm) unable to comply",
    r"\bagainst my (?:guidelines|policy|policies|rules|instructions|principles)",
    r"\bnot possible for me to\b",
    r"\boutside (?:of )?(?:what i (?:may|can|am allowed to)|my (?:scope|remit|capabilities|competence))",
    r"\b(?:do not|don't) have (?:the )?(?:permission|authority|ability|right) to\b",
    r"\bnot (?:allowed|permitted) to (?:assess|rate|judge|score|evaluate|give|provide|answer)",
    r"\b(?:darf|kann|möchte|werde) ich (?:\w+ ){0,5}?(?:nicht|keine?n?)\b(?: \w+){0,3} (?:beurteilen|bewerten|abgeben|beantworten|einschätzen|geben|helfen|erteilen|einstufen|vornehmen|leisten)",
    r"\bich (?:darf|kann|möchte|werde)(?: \w+){0,6} (?:nicht|keine?n?)\b(?: \w+){0,3} (?:beurteilen|bewerten|abgeben|beantworten|einschätzen|geben|helfen|erteilen|einstufen|vornehmen|leisten)",
    r"\bmir (?:leider )?nicht (?:erlaubt|gestattet|möglich)",
    r"\bnicht in der lage\b.{0,40}(?:beurteilen|bewerten|beantworten)",
    r"\bich (?:muss|lehne)\b.{0,40}\b(?:ablehnen|ab)\b",
    r"\bje (?:ne peux|ne puis|ne suis|refuse|dois refuser|dois décliner|préfère ne|n'ai pas|ne souhaite|ne saurais)(?: pas)?\b.{0,60}(?:évaluer|juger|noter|répondre|donner|fournir|mesure|autorisée?|classer|apprécier|prononcer|droit)",
    r"\bje (?:refuse|dois refuser|dois décliner)\b",
    r"\bil (?:ne )?m(?:'est|e) (?:est )?(?:pas |im)possible",
    r"\bcontraire à mes (?:règles|consignes|directives)",
    r"\bno (?:puedo|podré|debo|estoy autorizad[oa]|me es posible|me está permitido)\b.{0,60}(?:evaluar|juzgar|valorar|responder|dar|calificar|ayudar|opinar)",
    r"\b(?:tut mir leid|désolée?|lo siento|i'm sorry|i am sorry|apologies|regrettably|unfortunately|leider)\b.{0,12}(?:,| –| -)? ?(?:but|aber|mais|pero)? ?(?:i (?:can|won|am (?:un|not)|must|do not)|ich|je|no puedo|this request)\b.{0,60}(?:assess|rate|judge|score|evaluat|provide|comply|beurteil|bewert|évaluer|juger|répondre|evaluar|guidelines)",
)
#: Every pattern needs one of these words.
_REFUSAL_WORDS = frozenset(
    "cannot t not won unable able wish prefer would must have need will decline refuse guidelines policy policies rules instructions principles possible outside permission authority ability right allowed permitted nicht kein keine keinen mir lage ablehnen ab peux puis suis dois préfère souhaite saurais n m impossible mes puedo podré debo no sorry apologies regrettably unfortunately leid désolé désolée siento leider".split()
)
_REFUSAL = re.compile("|".join(REFUSALS), re.S)
_THINK = re.compile(r"<think>.*?</think>", re.S)
_FENCE = re.compile(r"```[A-Za-z]*")
_SCORES = re.compile(r"^\s*(?:label|justification|evidence|completeness)[^\n]*\d\s*/\s*\d[^\n]*?(?:\n|$|\.\s)", re.I)
_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|»[^«]*«|\"[^\"]*\"")
_FIELD = re.compile(r'"reasoning"\s*:\s*"((?:[^"\\]|\\.)*)"', re.S)
_WORD = re.compile(r"[^\W_]+")
_LEAD_IN = re.compile(r"^\s*(?:[^\W_]+[ \t\u00a0\u202f\u2009]+){0,3}[^\W_]+\s*:\s+")
_INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))


def answer(raw: str | None) -> tuple[str, str]:
    """("closed", reasoning), ("open", what there is) or ("none", "")."""
    text = _THINK.sub(" ", (raw or "").translate(_INVISIBLE))
    if "<think>" in text:
        return "open", text.split("<think>", 1)[1]
    text = _FENCE.sub(" ", text).strip()
    start = text.find("{")
    if start >= 0 and (not text[:start].strip() or '"' in text[start : start + 12] or text[start:].strip() == "{}"):
        try:
            value, _ = json.JSONDecoder(strict=False).raw_decode(text, start)
            found = value.get("reasoning") if isinstance(value, dict) else None
            return ("closed", found) if isinstance(found, str) else ("none", "")
        except ValueError:
            pass
        field = _FIELD.search(text, start)
        closing = text.rfind("}")
        if closing > start and '"' not in text[closing:]:  # closed, and at most a remark after it
            return ("closed", field.group(1)) if field else ("none", "")
        return "open", field.group(1) if field else text[start:]
    return ("closed", _SCORES.sub("", text).strip()) if text else ("none", "")


def is_placeholder(reasoning: str) -> bool:
    words = _WORD.findall(reasoning.lower())
    return not words or " ".join(words) in PLACEHOLDERS or not any(c.isalpha() for c in reasoning)


def copied_share(prompt: str, reasoning: str, least: float = 0.5) -> float:
    """Share of the reasoning's words that stand in the prompt in the same order.

    A lead-in of up to four words and a colon is left out.
    The longest common subsequence is worked out only where word trigrams of the
    prompt cover ``least`` of the reasoning; below that their coverage is returned.
    """
    w, p = _WORD.findall(_LEAD_IN.sub("", reasoning).lower()), _WORD.findall(prompt.lower())
    if len(w) < LEAST_WORDS or len(p) < 3:
        return 0.0
    grams = set(zip(p, p[1:], p[2:]))
    covered = bytearray(len(w))
    for i, gram in enumerate(zip(w, w[1:], w[2:])):
        if gram in grams:
            covered[i : i + 3] = b"\x01\x01\x01"
    coverage = sum(covered) / len(w)
    return common_words(w, p) / len(w) if coverage >= least else min(coverage, least)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# --- language: character n-gram naive Bayes ----------------------------------


@cache
def _alphabetic() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(text: str) -> np.ndarray:
    """Hashes of the character one- to three-grams inside words, digits left out."""
    low = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    c = _codes(low).astype(np.uint64)
    if len(c) < 3:
        return np.empty(0, dtype=np.int64)
    two = c[:-1] * np.uint64(0x1F123BB5) + c[1:] * np.uint64(0x9E3779B1)
    three = two[:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)
    every = np.concatenate((c * np.uint64(0x27D4EB2F), two, three)) * np.uint64(0x9E3779B97F4A7C15)
    return (every >> np.uint64(64 - LANGUAGE_BITS)).astype(np.int64)


class Languages:
    """Naive Bayes over hashed n-grams; letters of no trained text are a language of their own."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        size = 1 << LANGUAGE_BITS
        counts = np.array([np.bincount(np.concatenate([_grams(t) for t in texts[n]] or [np.empty(0, np.int64)]), minlength=size) for n in self.names], dtype=np.float64).reshape(len(self.names), size)
        self.weights = np.log((counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * size)) if len(self.names) else counts
        self.known = np.zeros(0x110000, dtype=bool)
        for n in self.names:
            for t in texts[n]:
                self.known[_codes(t.lower())] = True

    def of(self, text: str) -> tuple[str | None, float]:
        """The likeliest language and by how many nats it leads; None if too short to tell."""
        codes = _codes(text.lower())
        codes = codes[_alphabetic()[codes]]
        strange = len(codes) - int(np.count_nonzero(self.known[codes]))
        if strange * 2 > len(codes):
            return "other script", float(strange)
        if len(codes) < LEAST_LETTERS or not len(self.names):
            return None, 0.0
        grams = _grams(text)
        total = self.weights[:, grams].sum(axis=1)
        order = np.argsort(total)
        return self.names[order[-1]], float(total[order[-1]] - total[order[-2]]) if len(order) > 1 else float("inf")


def fit_languages(df: DataFrame, id_col: str, text_col: str, label_col: str, samples_per_language: int = 300, least_texts: int = 5) -> Languages:
    """From at most ``samples_per_language`` texts of each label, "unknown" left out."""
    rows = df.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"), F.lower(F.trim(F.col(label_col))).alias("label"))
    rows = rows.where("text <> '' and label rlike '^[a-z]{2,3}$'").where(~F.col("label").isin(*NO_LANGUAGE))
    w = Window.partitionBy("label").orderBy("h", "text")
    picked = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= samples_per_language)
    texts: dict[str, list[str]] = {}
    for r in picked.select("label", "text").collect():
        texts.setdefault(r.label, []).append(r.text)
    return Languages({k: v for k, v in texts.items() if len(v) >= least_texts})


# --- end of text: n-gram likelihood -------------------------------------------


def _normal(text: str) -> str:
    """Digits count as one, white space as one blank; room for the longest context in front."""
    return " " * ORDERS[-1] + re.sub(r"\d", "0", " ".join(text.split()))


def _contexts(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order`` characters that end at each place from ``order`` - 1 on."""
    c = codes.astype(np.uint64)
    n = len(c) - order + 1
    total = np.full(n, order, dtype=np.uint64)
    for k in range(order):
        total = total * np.uint64(0x100000001B3) + c[k : k + n] * np.uint64(0x9E3779B97F4A7C15)
    return ((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - END_BITS)).astype(np.int64)


def _end_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the counts [order, seen or ended, context] of one partition."""
    counts = np.zeros((len(ORDERS), 2, 1 << END_BITS), dtype=np.uint32)
    for b in batches:
        texts = [_normal(t) for state, t in map(answer, b.column(0).to_pylist()) if state == "closed" and not is_placeholder(t)]
        if not texts:
            continue
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts]) - 1
        inside = np.ones(len(codes), dtype=bool)  # places whose context lies in one text
        starts = np.concatenate(([0], ends[:-1] + 1))
        inside[(starts[:, None] + np.arange(ORDERS[-1])).reshape(-1)] = False
        for k, order in enumerate(ORDERS):
            at = _contexts(codes, order)
            counts[k, 0] += np.bincount(at[inside[order - 1 :]], minlength=1 << END_BITS).astype(np.uint32)
            counts[k, 1] += np.bincount(at[ends - order + 1], minlength=1 << END_BITS).astype(np.uint32)
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts.reshape(-1), END_BLOCKS)]
        yield pa.record_batch([pa.array(np.arange(END_BLOCKS, dtype=np.int32)), pa.array(parts, pa.binary())], names=["block", "counts"])


def _sum_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one = np.frombuffer(zlib.decompress(packed), dtype=np.uint32).astype(np.uint64)
            total[block] = total[block] + one if block in total else one
    if total:
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["block", "counts"])


def fit_ends(responses: DataFrame) -> np.ndarray:
    """Counts [order, seen or ended, context] over all responses; a few MB at any size."""
    schema = "block int, counts binary"
    summed = responses.mapInArrow(_end_step, schema).repartition(END_BLOCKS, "block").mapInArrow(_sum_step, schema)
    parts = np.zeros((END_BLOCKS, len(ORDERS) * 2 * (1 << END_BITS) // END_BLOCKS), dtype=np.uint64)
    for r in summed.collect():
        parts[r.block] = np.frombuffer(zlib.decompress(bytes(r.counts)), dtype=np.uint64)
    return parts.reshape(len(ORDERS), 2, 1 << END_BITS)


def end_likelihood(counts: np.ndarray, text: str, base: float = 0.01, prior: float = 4.0) -> float:
    """P(text stops | its last characters), the longer context resting on the shorter one
    and the shortest on ``base``.

    The text is one of those counted: its own end is taken off, so that an end which
    nothing else has does not speak for itself.
    """
    tail = _codes(_normal(text[-4 * ORDERS[-1] :])[-ORDERS[-1] :])
    p = base
    for k, order in enumerate(ORDERS):
        at = _contexts(tail[len(tail) - order :], order)[0]
        seen, ended = (max(float(counts[k, i, at]) - 1, 0.0) for i in (0, 1))
        p = (ended + prior * p) / (seen + prior)
    return p


def _step(models, least_end: float, copied: float, lead: float):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, ends = models.value
        for b in batches:
            out = [_defect(p, r, languages, ends, least_end, copied, lead) for p, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], names=["id", "defect"])

    return step


def _defect(prompt: str | None, raw: str | None, languages: Languages, ends: np.ndarray, least_end: float, copied: float, lead: float) -> str | None:
    state, text = answer(raw)
    if state == "open":
        return "truncated"
    if state == "none" or is_placeholder(text):
        return "empty"
    low = re.sub(r"\s+", " ", text.lower().replace("’", "'"))
    if not _REFUSAL_WORDS.isdisjoint(_WORD.findall(low)) and _REFUSAL.search(_QUOTED.sub(" ", low)):
        return "refusal"
    prompt = prompt or ""
    if copied_share(prompt, text) >= copied:
        return "copied_prompt"
    own, lead_own = languages.of(_QUOTED.sub(" ", text))
    asked, lead_asked = languages.of(_QUOTED.sub(" ", prompt))
    if own and asked and own != asked and min(lead_own, lead_asked) >= lead:
        return "other_language"
    return "truncated" if end_likelihood(ends, text) < least_end else None


def pair_defects(
    df: DataFrame,
    id_col: str,
    prompt_col: str,
    response_col: str,
    languages: Languages,
    least_end: float = 0.15,
    copied: float = 0.84,
    lead: float = 5.0,
) -> DataFrame:
    """(id, defect) of every row with an id; defect is null for sound pairs."""
    ends = fit_ends(df.select(response_col))
    models = df.sparkSession.sparkContext.broadcast((languages, ends))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(prompt_col).alias("p"), F.col(response_col).alias("r")).where("id is not null")
    return rows.mapInArrow(_step(models, least_end, copied, lead), RESULT)

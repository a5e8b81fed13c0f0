"""Keyword-stuffed and link-list pages: repeated substrings and missing clauses.

Two measures of a page, a title and a leading sentence set aside:

* ``missing``: the share of its words that stand in no clause.  A clause is a
  piece between sentence ends, line breaks, bars, bullets or asterisks with at
  least four words, of which two, and one in ten, are function words (articles,
  prepositions, pronouns, conjunctions, auxiliaries) of one language.  Commas part
  pieces too where they part four entries or more of ``ENTRY`` words or less on
  average; those of an ordinary sentence do not.  In no clause are words inside runs
  of two words or more that occur again before the next sentence end or line break
  (pairs of function words do not count), and sentences that the page has ``SLOGAN``
  times or more.  A link counts as one word in no clause of its own, a hyphenated
  word as one.
* ``coverage``: the share of the page's characters that lie in maximal substrings
  of two words or more that occur at least twice, read off the suffix automaton
  of the page's words.  Stretches between pairs of words that the page has once
  only are put into it one after the other: no repeated substring spans such a pair.

A page is spam where ``missing + COVERAGE_WEIGHT * coverage`` reaches
``THRESHOLD`` and there is something it is stuffed with: ``PIECES`` pieces without
a clause, or repetition over half of its characters.  Both measures are taken on
every page, of any length; a bare title or a stub has nothing to be stuffed with.

Null and empty texts are no spam (score 0).  Whole pages are read, of any length.
One row comes out per row with an id; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE_WEIGHT = 0.35
THRESHOLD = 0.7
SLOGAN = 3
ENTRY = 4
PIECES = 3
RESULT = "doc_id bigint, words int, missing double, coverage double, score double, is_spam boolean"

# Closed-class words of the languages expected in a European crawl.
FUNCTION_WORDS = {
    "en": "the a an of to in for on with by from at as that which who whose this these those and or but if when where while whereas unless until because since although than not no is are was were be been being has have had do does did shall should may might can could must will would it its they them their we our you your he she his her there such any each all both other into under over between within without against about after before during per",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber wenn sofern damit dass weshalb solange während weil von zu zum zur im in an am auf für mit nach bei aus über unter durch ohne gegen um als wie nicht kein keine ist sind war waren wird werden wurde hat haben kann können darf dürfen muss müssen soll sollen sich sie er es wir ihr ihre dabei auch nur so",
    "fr": "le la les l un une des du de d et ou mais si lorsque quand que qui dont où ce cette ces il elle ils elles on ne pas est sont était être a ont peut peuvent doit doivent par pour sur sous dans avec sans entre vers au aux en afin tant ainsi aussi plus leur leurs se s",
    "es": "el los las una unos unas del y o pero cuando quien cuyo donde esta este estos estas no es son fue ser ha han puede pueden debe deben por para sobre bajo con sin entre hacia al como lo su sus además más",
    "it": "il gli i uno di ed ma quando che chi cui dove questo questa non è sono essere può possono deve devono per su sotto con senza tra fra al alla dei delle nel nella",
    "nl": "het een van en maar wanneer die dat niet wordt worden kan kunnen moet moeten door voor op onder met zonder tussen naar om ook",
    "pl": "w z na do od przez dla pod nad się nie jest są oraz lub ale jeśli gdy który która które że to być może mogą musi",
    "pt": "os um uma do da dos das quando não é são foi ser pode podem deve devem em com sem ao aos na nas no nos pelo pela",
}
_LANGUAGES = {w: tuple(k for k, words in enumerate(FUNCTION_WORDS.values()) if w in words.split()) for all_words in FUNCTION_WORDS.values() for w in all_words.split()}
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)+(?:/\S*)?")
_LINK_MARK = re.compile(r"\.[\w-]|://|www\.")
#: Sentence ends and line breaks; a full stop after one or two digits is an ordinal's or a list's.
_BREAK = re.compile(r"[.!?;\n](?:(?<=\n)|(?<!\b[0-9]\.)(?<!\b[0-9]{2}\.)\s)")
_SEPARATOR = re.compile(r"[|•▪◦‣]|(?<!\S)[*·](?!\S)")
_SEPARATOR_MARK = re.compile(r"[|•▪◦‣*·]")
#: What parts the entries of a line without a clause.
_ENTRIES = re.compile(r"[|•▪◦‣*·/,;:»›>#–—]|\s-\s")
_COMMA = re.compile(r",(?!\d)")
_WORD = re.compile(r"[^\W_]+")
_LINK_SIGN = "\x01"
_WHOLE = re.compile(rf"[^\W_]+(?:[-‐‑][^\W_]+)*|{_LINK_SIGN}")


def _is_clause(words: list[str]) -> bool:
    """Whether a piece has the function words of a clause, all of one language."""
    n = len(words) - words.count(_LINK_SIGN)
    if n < 4:
        return False
    found = [k for w in words if w in _LANGUAGES for k in _LANGUAGES[w]]
    most = max(map(found.count, set(found)), default=0)
    return most >= 2 and 10 * most >= n


def _repeats(words: list[str]) -> list[bool] | None:
    """For each word whether it lies in a run of two or more that the words have again.

    Such runs are unions of pairs that occur twice, so pairs are enough.
    """
    pairs = list(zip(words, words[1:]))
    if len(set(pairs)) == len(pairs):
        return None
    times = Counter(pairs)
    inside = [False] * len(words)
    for i, pair in enumerate(pairs):
        if times[pair] > 1 and not (pair[0] in _LANGUAGES and pair[1] in _LANGUAGES):
            inside[i] = inside[i + 1] = True
    return inside


def _parts(sentence: str, parted: bool) -> list[list[str]]:
    """The words of each piece of a sentence or line."""
    out = []
    for piece in _SEPARATOR.split(sentence) if parted else (sentence,):
        words = _WHOLE.findall(piece)
        if piece.count(",") >= 3 and len(words) <= ENTRY * len(entries := _COMMA.split(piece)) and len(entries) > 3:
            out += map(_WHOLE.findall, entries)
        else:
            out.append(words)
    return out


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(words, words in clauses, pieces in no clause) between sentence ends and line breaks."""
    low = text.lower()
    if _LINK_MARK.search(low):
        low = _LINK.sub(f" {_LINK_SIGN} ", low)
    parted = bool(_SEPARATOR_MARK.search(low))
    pieces = [s for s in _BREAK.split(low) if s and not s.isspace()]
    lists = [_parts(s, parted) for s in pieces]
    joined = [parts[0] if len(parts) == 1 else [w for part in parts for w in part] for parts in lists]
    times = Counter(map(tuple, joined))
    out = []
    for sentence, parts, words in zip(pieces, lists, joined):
        held = loose = 0
        if len(words) >= 4 and times[tuple(words)] < SLOGAN and any(clauses := list(map(_is_clause, parts))):
            inside = _repeats(words)
            at = 0
            for part, clause in zip(parts, clauses):
                if clause:
                    held += len(part) - (sum(inside[at : at + len(part)]) if inside else 0)
                elif part:
                    loose += 1
                at += len(part)
        else:
            loose = max(sum(1 for x in _ENTRIES.split(sentence) if _WHOLE.search(x)), words.count(_LINK_SIGN))
        out.append((len(words), held, loose))
    return out


def missing_clauses(text: str) -> tuple[int, float, int]:
    """Words after a title and a leading sentence, their share in no clause, and pieces in none."""
    found = sentences(text)
    rest = found
    if len(rest) > 1 and rest[0][0] <= 12 and not rest[0][1] and rest[0][2] == 1:
        rest = rest[1:]  # a title
    if len(rest) > 1 and 2 * rest[0][1] > rest[0][0]:
        rest = rest[1:]  # a leading sentence
    total = sum(n for n, _, _ in rest)
    return total, 1 - sum(held for _, held, _ in rest) / total if total else 0.0, sum(loose for _, _, loose in rest)


def repeat_coverage(text: str, least: int = 2) -> float:
    """Share of the text's word characters inside repeated runs of ``least`` words or more.

    Builds the suffix automaton of the word sequence.  The longest repeated run
    that ends at a word is the word's prefix state if that occurs twice, else its
    suffix link, whose end positions are more by definition.
    """
    words = _WORD.findall(text.lower())
    pairs = list(zip(words, words[1:]))
    times = Counter(pairs)
    if len(times) == len(pairs):
        return 0.0
    # stretches of repeated pairs, parted by signs that occur once each
    letters: list[str | int] = []
    places: list[int] = []
    for i, pair in enumerate(pairs):
        if times[pair] > 1:
            if not places or places[-1] != i:
                letters += (-i, words[i])
                places += (-1, i)
            letters.append(words[i + 1])
            places.append(i + 1)
    link, length, prefix = _automaton(letters)
    often = set(link)  # a state occurs twice or more if another one's link leads to it
    covered = 0
    reach = len(letters)  # letters from here on are covered already
    for i in range(len(letters) - 1, -1, -1):
        state = prefix[i]
        run = length[state] if state in often else length[link[state]]
        if run >= least and i - run + 1 < reach:
            reach = i - run + 1
        if reach <= i:
            covered += len(words[places[i]])
        else:
            reach = i
    return covered / sum(map(len, words))


def _automaton(letters: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix links and lengths of the states, and the state of each prefix."""
    moves: list[dict] = [{}]
    link, length = [-1], [0]
    prefix = []
    last = 0
    for letter in letters:
        new = len(moves)
        moves.append({})
        size = length[last] + 1
        length.append(size)
        p = last
        while p >= 0 and letter not in (move := moves[p]):
            move[letter] = new
            p = link[p]
        if p < 0:
            link.append(0)
        else:
            q = moves[p][letter]
            if length[p] + 1 == length[q]:
                link.append(q)
            else:
                copy = new + 1
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link += (copy, link[q])
                link[q] = copy
                while p >= 0 and moves[p].get(letter) == q:
                    moves[p][letter] = copy
                    p = link[p]
        last = new
        prefix.append(new)
    return link, length, prefix


def judge(text: str | None) -> tuple[int, float, float, float, bool]:
    """(words, missing, coverage, score, is_spam) of one page."""
    if not text:
        return 0, 0.0, 0.0, 0.0, False
    words, missing, loose = missing_clauses(text)
    coverage = repeat_coverage(text)
    score = missing + COVERAGE_WEIGHT * coverage
    return words, missing, coverage, score, score >= THRESHOLD and (loose >= PIECES or coverage >= 0.5)


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [judge(t) for t in b.column(1).to_pylist()]
        words, missing, coverage, score, spam = zip(*rows) if rows else ((),) * 5
        yield pa.record_batch(
            [b.column(0), pa.array(words, pa.int32()), pa.array(missing, pa.float64()), pa.array(coverage, pa.float64()), pa.array(score, pa.float64()), pa.array(spam, pa.bool_())],
            names=["doc_id", "words", "missing", "coverage", "score", "is_spam"],
        )


def keyword_spam(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, words, missing, coverage, score, is_spam) of every row; no shuffle."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(_step, RESULT)

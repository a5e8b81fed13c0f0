"""Oversized values cut into pieces within a limit, at natural boundaries.

Structure-tree packing.  A value's clean text is a tree of nested intervals: headed
parts in up to ``DEPTH`` depths (part, chapter, section, article, numbered; one to six
hash signs; lines in capitals), paragraphs (between blank lines), lines, list items,
sentences, clauses, words, characters.  Only nodes over the budget are descended into.
On the way back up neighbouring subtrees are merged, those parted by the weakest
boundary first and of these the smallest, while they fit; so a cut falls at the highest
boundary that keeps the limit, and inside a word only where a word alone is over it.
``boundary`` names what each piece begins with.

Each piece but the first begins with the end of the piece before, at most
``overlap`` characters, from the first sentence (else word) that starts within
them.  Budget is limit minus overlap, so that every piece with its overlap stays
within the limit.  Pieces without their overlaps, joined by the blanks between
them, give the clean text back.

Null counts as ""; values within the limit give no piece (or one, with
``keep_small``).  Rows with a null id are left out, repeated rows give repeated
pieces; very long values are cut whole, in one pass; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import MARKS

RESULT = "id bigint, field string, piece_no int, n_pieces int, start int, overlap int, boundary string, text string"

_LINE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
DEPTH = 6
#: What a cut falls before, from the strongest to the weakest.
BOUNDARIES = (*("part", "chapter", "section", "article", "numbered part", "subpart"), "paragraph", "line", "item", "sentence", "clause", "word", "character")
# Words that open a heading, by the depth of the part they head.
HEADS = (
    "part|title|annex|appendix|teil|titel|anhang|anlage|partie|titre|annexe|parte|título|anexo",
    "chapter|kapitel|chapitre|capítulo",
    "section|abschnitt|sección",
    "article|artikel|artículo|recital|erwägungsgrund|considérant",
)
_NUMBER = r"(?:\d+[a-z]?|[ivxlc]+|[a-z])\b"
_HEADED = tuple(re.compile(rf"(?:{words})\s+{_NUMBER}", re.I) for words in HEADS)
_HASHED = re.compile(r"(#{1,6})\s")
_NUMBERED = re.compile(r"\d+(?:\.\d+)+\.?\s+\S")
_LETTER = re.compile(r"[^\W\d_]")
_ITEM = re.compile(r"(?<= )(?=(?:\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})\)|\d{1,3}\.|[-–—•*·▪])\s+\S)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"”’»)]*\s+")
_CLAUSE = re.compile(r"(?<=[;:,])\s+")


def clean(text: str) -> str:
    """Amendment marks removed, white space collapsed, ends trimmed."""
    return " ".join(MARKS.sub("", text).split())


def _depth(line: str) -> int | None:
    """Depth of the part that a line heads, None for a line of text.

    A heading is short and does not end as a sentence does; a line in capitals heads a
    section.
    """
    if len(line) > 120 or line[-1] in ".;,:":
        return None
    hashes = _HASHED.match(line)
    if hashes:
        return len(hashes.group(1)) - 1
    for depth, pattern in enumerate(_HEADED):
        if not line[0].islower() and pattern.match(line):
            return depth
    if line == line.upper() and len(_LETTER.findall(line)) >= 4:
        return 2
    return 4 if _NUMBERED.match(line) else None


def _structure(text: str) -> tuple[str, list[list[int]]]:
    """The clean text and, for the depths of headed parts, paragraphs and lines, where nodes start in it."""
    starts: list[list[int]] = [[] for _ in range(DEPTH + 2)]
    parts: list[str] = []
    at = 0
    blank = False
    for raw in _LINE.split(text):
        line = clean(raw)
        if not line:
            blank = True
            continue
        depth = _depth(line)
        # a heading starts a node of its depth and of all below it
        for level in range(DEPTH + 1 if depth is None else depth, DEPTH + 2):
            if level != DEPTH or blank or depth is not None:
                starts[level].append(at)
        if depth is None and blank:
            starts[DEPTH].append(at)
        parts.append(line)
        at += len(line) + 1
        blank = False
    return " ".join(parts), starts


_INSIDE = (lambda t: _ITEM.finditer(t), lambda t: _SENTENCE.finditer(t), lambda t: _CLAUSE.finditer(t), lambda t: re.finditer(" ", t))


def _children(text: str, start: int, end: int, level: int, levels: list[list[int]]) -> list[int]:
    """Starts of the node's children at one level: a structural one, items, sentences, clauses, words."""
    if level < len(levels):
        inside = levels[level][bisect_right(levels[level], start) : bisect_left(levels[level], end)]
    else:
        inside = [start + m.end() for m in _INSIDE[level - len(levels)](text[start:end])]
    return [start, *(x for x in inside if start < x < end)]


Unit = tuple[int, int, int]  # start, end, level of the boundary it begins with


def _pack(text: str, start: int, end: int, level: int, levels: list[list[int]], budget: int) -> list[Unit]:
    """Units within the budget that make up [start, end), merged as far as they fit."""
    if len(text[start:end].rstrip()) <= budget:
        return [(start, end, level)]
    if level == len(BOUNDARIES) - 1:
        return [(i, min(end, i + budget), level) for i in range(start, end, budget)]
    starts = _children(text, start, end, level, levels)
    if len(starts) == 1:
        return _pack(text, start, end, level + 1, levels, budget)
    units: list[Unit] = []
    for a, b in zip(starts, [*starts[1:], end]):
        first, *rest = _pack(text, a, b, level + 1, levels, budget)
        units += [(first[0], first[1], level), *rest]
    return _merge(text, units, budget)


def _merge(text: str, units: list[Unit], budget: int) -> list[Unit]:
    """Neighbours joined while they fit: across the weakest boundaries first, then the smallest."""
    n = len(units)
    start, end, level = ([u[k] for u in units] for k in range(3))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    size = lambda i, j: len(text[start[i] : end[j]].rstrip())
    heap = [(-level[j], size(j - 1, j), j - 1, end[j - 1], end[j]) for j in range(1, n)]
    heapify(heap)
    gone = [False] * n
    while heap:
        _, length, i, own, until = heappop(heap)
        j = after[i]
        if length > budget or gone[i] or j >= n or end[i] != own or end[j] != until:
            continue  # too large, or one of the two has changed since
        end[i], after[i], gone[j] = end[j], after[j], True
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            heappush(heap, (-level[k], size(i, k), i, end[i], end[k]))
        if before[i] >= 0:
            h = before[i]
            heappush(heap, (-level[i], size(h, i), h, end[h], end[i]))
    return [(start[i], end[i], level[i]) for i in range(n) if not gone[i]]


def _overlap_start(text: str, start: int, previous: int, overlap: int) -> int:
    """Where the piece that begins at ``start`` takes up the one before."""
    low = max(previous, start - overlap)
    if low >= start:
        return start
    tail = text[low:start]
    first = _SENTENCE.search(tail)
    if low == previous:
        return low
    if first and first.end() < len(tail):
        return low + first.end()
    if text[low - 1] == " ":
        return low
    blank = tail.find(" ")
    return low + blank + 1 if 0 <= blank < len(tail) - 1 else start


class Piece(NamedTuple):
    start: int  # in the clean text
    overlap: int  # characters taken up from the piece before
    boundary: str
    text: str


def split(text: str | None, limit: int = 2400, overlap: int = 320, keep_small: bool = False) -> list[Piece]:
    """The pieces of a text over the limit."""
    whole, levels = _structure(text or "")
    if len(whole) <= limit:
        return [Piece(0, 0, "start", whole)] if keep_small and whole else []
    units = [u for u in _pack(whole, 0, len(whole), 0, levels, limit - overlap) if whole[u[0] : u[1]].strip()]
    out = []
    for k, (a, b, level) in enumerate(units):
        begin = _overlap_start(whole, a, units[k - 1][0], overlap) if k else a
        out.append(Piece(begin, a - begin, BOUNDARIES[level] if k else "start", whole[begin:b].rstrip()))
    return out


def _step(limit: int, overlap: int, keep_small: bool):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for key, field, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = split(value, limit, overlap, keep_small)
                rows.extend((key, field, i, len(found), *piece) for i, piece in enumerate(found, 1))
            columns = list(zip(*rows)) or [()] * 8
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "field", "piece_no", "n_pieces", "start", "overlap", "boundary", "text"])

    return step


def split_oversized(df: DataFrame, id_col: str, fields: Sequence[str], limit: int = 2400, overlap: int = 320, keep_small: bool = False) -> DataFrame:
    """(id, field, piece_no, n_pieces, start, overlap, boundary, text) of the pieces of the fields' values.

    One scan; the raw length filters in the JVM what can't be over the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    values = df.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields))).alias("v"),
    ).select("id", "v.field", "v.value")
    least = 0 if keep_small else limit
    values = values.where("id is not null and value is not null").where(F.length("value") > least)
    return values.mapInArrow(_step(limit, overlap, keep_small), RESULT)

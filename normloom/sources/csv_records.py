"""Delivered CSV records: those that can't be read, with the reason, and typed rows.

A transport has cut files into records (a quoted value may hold line breaks).  The
file's first record is its header; it fixes the delimiter.  Each record goes
through Python's strict csv reader; what that lets pass against the format (quotes
or line breaks in unquoted fields) is caught by laying the parsed fields back over
the raw text.  Then come the number of fields and the typed fields.  The first
reason that applies counts: ``quoting``, ``column_count``, ``invalid_value``.

Headers are one small row a file and are joined to the records by file name;
adaptive execution broadcasts them where their measured size allows it and splits
a file that holds much of the rows where it does not.  Records are parsed one at a
time, of any length.

A null or empty record is one empty field, so it fails by its column count; the
records of a file without a header are read with the candidate delimiter that
gives the right number of fields, else the comma.  Nulls in other columns pass.
A page or line of digits only is valid at any length; one over ``LARGEST`` has no
bigint, so its field is null and ``beyond`` names it.  Whatever else a record raises is
its own failure (``invalid_value``), never the job's.
Rows with a null id are kept (id null).  Repeated records give repeated results;
several headers of one file: the one with the smallest id.  Extra columns are
ignored.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The gold file's columns, its closed vocabularies and delimiters.
COLUMNS = (
    "paper", "source_page", "source_line", "recommendation_text", "source_snippet_original", "recommendation_or_statement", "doc_short_name", "doc_type",
    "doc_ref_num", "doc_reference_raw_excerpt", "evidence_span", "reference_basis", "needs_review", "context_excerpt", "alignment_label",
)
VALUES = {
    "recommendation_or_statement": frozenset(("recommendation", "statement")),
    "reference_basis": frozenset(("explicit_mention", "citation_mapping")),
    "needs_review": frozenset(("yes", "no", "")),
    "alignment_label": frozenset(("", "aligned", "conditional", "conflicting", "no explicit legal basis", "beyond compliance")),
}
DELIMITERS = (",", ";", "\t", "|")
NUMBERS = ("source_page", "source_line")
TEXTS = ("recommendation_text", "doc_short_name")

_DIGITS = re.compile(r"[0-9]*\Z")
#: What a page or line number may be at most as a bigint.
LARGEST = 2**63 - 1


class Unreadable(ValueError):
    """A record that can't be read; its argument is the reason."""


def delimiter_of(header: str | None, record: str = "", width: int = len(COLUMNS)) -> str:
    """The candidate that occurs most in the header; without one, what fits the record."""
    if header:
        counts = [header.count(d) for d in DELIMITERS]
        if max(counts):
            return DELIMITERS[counts.index(max(counts))]
    for d in DELIMITERS:
        if record.count(d) == width - 1:
            return d
    return ","


def parse_record(raw: str, delimiter: str) -> list[str]:
    """The fields of one record; raises ``Unreadable("quoting")``."""
    if '"' not in raw and "\n" not in raw and "\r" not in raw:
        return raw.split(delimiter)
    csv.field_size_limit(sys.maxsize)
    try:
        rows = list(csv.reader([raw], delimiter=delimiter, strict=True))
    except csv.Error as error:
        raise Unreadable("quoting") from error
    if len(rows) != 1:
        raise Unreadable("quoting")
    fields = rows[0] or [""]
    # lay the fields back over the record: quoted as the format says, or plain
    at = 0
    for k, value in enumerate(fields):
        if k:
            if raw[at : at + 1] != delimiter:
                raise Unreadable("quoting")
            at += 1
        if raw[at : at + 1] == '"':
            form = '"' + value.replace('"', '""') + '"'
        elif '"' in value or "\n" in value or "\r" in value:
            raise Unreadable("quoting")
        else:
            form = value
        if not raw.startswith(form, at):
            raise Unreadable("quoting")
        at += len(form)
    if at != len(raw):
        raise Unreadable("quoting")
    return fields


def check_fields(fields: Sequence[str]) -> None:
    """Raises ``Unreadable`` for a wrong number of fields or an invalid value."""
    if len(fields) != len(COLUMNS):
        raise Unreadable("column_count")
    row = dict(zip(COLUMNS, fields))
    for name in TEXTS:
        if "�" in row[name] or not any(c.isalpha() for c in row[name]):
            raise Unreadable("invalid_value")
    for name in NUMBERS:
        if not _DIGITS.match(row[name].strip()):
            raise Unreadable("invalid_value")
    for name, allowed in VALUES.items():
        if row[name].strip().lower() not in allowed:
            raise Unreadable("invalid_value")


TYPED = "record_id bigint, reason string, beyond string, " + ", ".join(f"{c} {'bigint' if c in NUMBERS else 'string'}" for c in COLUMNS)
_ARROW = [pa.int64(), pa.string(), pa.string(), *(pa.int64() if c in NUMBERS else pa.string() for c in COLUMNS)]


def _number(text: str) -> int | None:
    """The number of a row of digits, null if it is over ``LARGEST``; never converts more than 19."""
    digits = text.strip().lstrip("0") or "0"
    number = int(digits) if len(digits) <= 19 else LARGEST + 1
    return number if number <= LARGEST else None


def _typed(fields: Sequence[str]) -> list:
    """``beyond`` and the fields."""
    out: list = []
    beyond: list[str] = []
    for name, value in zip(COLUMNS, fields):
        text = value.strip()
        if name in NUMBERS:
            out.append(_number(text) if text else None)
            if text and out[-1] is None:
                beyond.append(name)
        else:
            out.append(text.lower() if name in ("recommendation_or_statement", "reference_basis", "needs_review") else value)
    return [" ".join(beyond) or None, *out]


def _parse_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = [None] * (len(COLUMNS) + 1)
    for b in batches:
        rows = []
        for key, raw, header in zip(*(b.column(k).to_pylist() for k in range(3))):
            raw = raw or ""
            try:
                fields = parse_record(raw, delimiter_of(header, raw))
                check_fields(fields)
                rows.append([key, None, *_typed(fields)])
            except Unreadable as error:
                rows.append([key, error.args[0], *nothing])
            except ValueError:
                rows.append([key, "invalid_value", *nothing])
        columns = list(zip(*rows)) or [()] * len(_ARROW)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW)], names=["record_id", "reason", "beyond", *COLUMNS])


def parse_records(df: DataFrame, id_col: str = "record_id", file_col: str = "file_name", number_col: str = "record_no", raw_col: str = "raw") -> DataFrame:
    """Every record but the headers: record_id, reason (null if it was read), beyond and the typed fields."""
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(file_col).alias("f"), F.col(number_col).alias("no"), F.col(raw_col).alias("raw"))
    headers = rows.where("no = 1").groupBy("f").agg(F.min_by("raw", "id").alias("header"))
    records = rows.where("no is null or no <> 1").join(headers, rows.f.eqNullSafe(headers.f), "left").select("id", "raw", "header")
    return records.mapInArrow(_parse_step, TYPED)

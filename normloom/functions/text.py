"""Text functions, as Spark columns and, where Python needs them, as patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from normloom.functions import vocab

# White space as Python and Unicode see it, amendment marks, token edges.
WS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
MARK = r"[▼►◄▲][\p{Lu}\p{Nd}]+(?![\p{L}\p{N}])"
MARKS = re.compile(r"[▼►◄▲][A-ZÀ-ÖØ-Þ0-9]+(?![^\W_])")
EDGE = r"""[.,;:"'()\[\]]"""


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c: Column | str) -> Column:
    """White space collapsed to single blanks, ends trimmed."""
    return F.trim(F.regexp_replace(as_column(c), f"{WS}+", " "))


def clean_text(c: Column | str) -> Column:
    """Amendment marks removed, white space collapsed, ends trimmed; null stays null."""
    return normalize_ws(F.regexp_replace(as_column(c), MARK, ""))


def tokens(c: Column | str) -> Column:
    """Tokens for lexical retrieval: lower case, cut at white space, punctuation stripped
    from both ends, two characters or more.  Null gives an empty array.

    Two passes of one pattern each over the whole text, none per token.
    """
    low = F.lower(F.coalesce(as_column(c), F.lit("")))
    inner = WS.replace("[", "[^", 1)
    bare = F.regexp_replace(low, f"(?<!{inner}){EDGE}+|{EDGE}+(?!{inner})", "")
    return F.regexp_extract_all(bare, F.lit(f"({inner}{{2,}})"), F.lit(1))


def sentences(c: Column | str) -> Column:
    """Cut after . ! ? followed by white space."""
    return F.split(as_column(c), r"(?<=[.!?])" + f"{WS}+")


def capital_sentences(c: Column | str) -> Column:
    """Cut like sentences, but only before an ASCII capital."""
    return F.split(as_column(c), r"(?<=[.!?])" + f"{WS}+(?=[A-Z])")


def title_case(c: Column | str) -> Column:
    """A capital after every non-letter, small letters elsewhere, as Python's str.title."""
    text = as_column(c)

    def one(i: Column) -> Column:
        here = F.substring(text, i, F.lit(1))
        start = (i == 1) | ~F.substring(text, i - 1, F.lit(1)).rlike(r"\p{L}")
        return F.when(start, F.upper(here)).otherwise(F.lower(here))

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), one), "")).otherwise(text)


def document_name(c: Column | str) -> Column:
    """Canonical document name: exact short name, else the first pattern contained, else
    the name trimmed and in title case."""
    raw = as_column(c)
    low = F.trim(F.lower(raw))
    rules = [(low == short, name) for short, name in vocab.DOCUMENT_EXACT.items()]
    rules += [(reduce(lambda a, b: a | b, [low.contains(p) for p in patterns]), name) for name, patterns in vocab.DOCUMENT_PATTERNS.items()]
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(title_case(F.trim(raw)))


def document_name_sql(c: str) -> str:
    """The same as SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = f"trim(lower({c}))"
    rules = [f"WHEN {low} = {quote(s)} THEN {quote(n)}" for s, n in vocab.DOCUMENT_EXACT.items()]
    rules += ["WHEN " + " OR ".join(f"contains({low}, {quote(p)})" for p in patterns) + f" THEN {quote(n)}" for n, patterns in vocab.DOCUMENT_PATTERNS.items()]
    t = f"trim({c})"
    title = f"CASE WHEN length({t}) > 0 THEN array_to_string(list_transform(range(1, length({t}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({t}, i - 1, 1), '\\p{{L}}') THEN upper(substr({t}, i, 1)) ELSE lower(substr({t}, i, 1)) END), '') ELSE {t} END"
    return f"CASE {' '.join(rules)} ELSE {title} END"


def evidence_group(c: Column | str) -> Column:
    """binding_law or policy_or_recommendation_docs, by the canonical name."""
    return F.when(document_name(c).isin(*vocab.BINDING_LAW), vocab.GROUPS[0]).otherwise(vocab.GROUPS[1])


def evidence_group_sql(c: str) -> str:
    names = ", ".join(f"'{n}'" for n in vocab.BINDING_LAW)
    return f"CASE WHEN {document_name_sql(c)} IN ({names}) THEN '{vocab.GROUPS[0]}' ELSE '{vocab.GROUPS[1]}' END"


def file_short_name(c: Column | str) -> Column:
    """Short document name from a file name: a known label inside its upper-case stem, else
    what stands before the first hyphen."""
    stem = F.upper(F.regexp_replace(F.element_at(F.split(as_column(c), "/"), -1), r"\.[^.]*$", ""))
    out = None
    for part, label in vocab.FILE_LABELS.items():
        out = F.when(stem.contains(part), label) if out is None else out.when(stem.contains(part), label)
    return out.otherwise(F.trim(F.split(stem, "-")[0]))


def file_version(c: Column | str) -> Column:
    """What follows the first hyphen of a file's stem, its leading blank kept; else ""."""
    stem = F.regexp_replace(F.element_at(F.split(as_column(c), "/"), -1), r"\.[^.]*$", "")
    return F.when(stem.contains("-"), F.regexp_extract(stem, r"^[^-]*-(?s)(.*)$", 1)).otherwise("")


def chunk_id(document: Column | str, article: Column | str, paragraph: Column | str, text: Column | str) -> Column:
    """document|article|paragraph|first eight digits of the text's SHA-256."""
    part = lambda c: F.coalesce(as_column(c), F.lit(""))
    return F.concat_ws("|", part(document), part(article), part(paragraph), F.substring(F.sha2(part(text), 256), 1, 8))


def fingerprint(c: Column | str) -> Column:
    """Near-duplicate key: lower case, white space collapsed, then all but a-z, 0-9 and
    blanks dropped, first 220 characters."""
    return F.substring(F.regexp_replace(normalize_ws(F.lower(as_column(c))), "[^a-z0-9 ]", ""), 1, 220)


def first_filled(*columns: Column | str) -> Column:
    """The first value that is neither null nor blank, else ""."""
    return F.coalesce(*(F.when(F.trim(as_column(c)) != "", as_column(c)) for c in columns), F.lit(""))


def with_prefix(c: Column | str, model_key: str, passage: bool) -> Column:
    """Prefix that e5 models expect; others take the text as it is."""
    text = as_column(c)
    return F.concat(F.lit("passage: " if passage else "query: "), text) if model_key.startswith("e5-") else text


def semicolon_values(c: Column | str) -> Column:
    """Values between semicolons, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(as_column(c), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def safe_file_name(c: Column | str) -> Column:
    """Everything but letters, digits, dot, hyphen and underscore becomes an underscore."""
    return F.regexp_replace(as_column(c), "[^A-Za-z0-9._-]+", "_")


def utc_text(c: Column | str | None = None) -> Column:
    """A UTC timestamp as ISO text with microseconds; the present one by default.  The
    session's time zone must be UTC."""
    return F.date_format(F.current_timestamp() if c is None else as_column(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def truncated(c: Column | str, limit: int, reserve: int = 8) -> Column:
    """The text's first ``limit`` - ``reserve`` words, where a model takes no more; else as it is."""
    text, words = as_column(c), f"(?:[^\\s]+\\s+){{{limit - reserve}}}"
    head = F.regexp_extract(text, f"^(\\s*{words})", 1)
    return F.when(head != "", F.regexp_replace(head, r"\s+$", "")).otherwise(text)

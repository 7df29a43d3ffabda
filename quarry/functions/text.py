"""Text as column expressions: lines, chunks' content, tokens, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer tokens are not indexed.
MAX_TOKEN = 40
#: Characters of a chunk that are embedded.
EMBED_CHARS = 8192
SNIPPET_LINES = 12


def lines(text: Column) -> Column:
    """The lines of a text: a final line end opens no further line, CR before LF is dropped, an empty text has none."""
    body = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "\n\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def normalize_content(text: Column) -> Column:
    """Line ends to LF, no blanks at line ends, no blank lines first or last."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    trimmed = F.regexp_replace(unified, "[ \t]+(?=\n|\\z)", "")
    return F.regexp_replace(F.regexp_replace(trimmed, "\\A\n+", ""), "\n+\\z", "")


def split_identifiers(text: Column, limit: int = EMBED_CHARS) -> Column:
    """Words of identifiers apart: a blank before a capital after a letter, underscores and white space as one blank."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r"(?<=[\p{Ll}\p{Lu}])(?=\p{Lu})", " ")
    return F.trim(F.regexp_replace(cut, r"[\s_]+", " "))


def normalize_token(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, none longer than ``MAX_TOKEN``, in order."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    return F.filter(parts, lambda t: (t != "") & (F.length(t) <= MAX_TOKEN))


def first_token(text: Column) -> Column:
    """The first of ``tokens``, null if there is none; found without splitting the text."""
    found = F.regexp_extract(F.lower(text), r"(?<![\p{L}\p{N}])[\p{L}\p{N}]{1,%d}(?![\p{L}\p{N}])" % MAX_TOKEN, 0)
    return F.when(found != "", found)


def token_estimate(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4).cast("long")


def line_count(start: Column, end: Column) -> Column:
    return F.greatest(end - start, F.lit(0)) + 1


def display_name(parent: Column, symbol: Column, kind: Column, start: Column, end: Column) -> Column:
    """``parent.symbol``, ``symbol``, or ``kind:start-end`` of a chunk without a name."""
    named = F.when(parent.isNotNull(), F.concat_ws(".", parent, symbol)).otherwise(symbol)
    return F.when(symbol.isNotNull(), named).otherwise(F.format_string("%s:%d-%d", kind, start, end))


def head_lines(text: Column, n: int = SNIPPET_LINES) -> Column:
    """The first ``n`` lines, and ``...`` on a line of its own if there are more."""
    every = lines(text)
    head = F.array_join(F.slice(every, 1, n), "\n")
    return F.when(F.size(every) > n, F.concat(head, F.lit("\n..."))).otherwise(head)


def leading_identifier(text: Column) -> Column:
    """The identifier that a text starts with, or null."""
    found = F.regexp_extract(F.trim(text), r"^([A-Za-z_$][A-Za-z0-9_$]*)", 1)
    return F.when(found != "", found)

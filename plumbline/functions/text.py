"""Text expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token, identifier, heading, citation and sentence-boundary patterns.
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
IDENTIFIER = r"(?i)\b(?:\d+(?:\.\d+)+|[A-Z0-9]+(?:-[A-Z0-9]+)+)\b"
HEADING = r"^(?:#{1,6}\s+)?(\d+(?:\.\d+)*)\s+([A-Za-z].*)$"
CITATION = r"\[(\d+)\]"
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(as_col(text)), F.lit(TOKEN), F.lit(0))


def identifiers(text: str | Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(as_col(text), F.lit(IDENTIFIER), F.lit(0)))


def squeeze(text: str | Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(as_col(text), r"\s+", " "))


def sentences(text: str | Column) -> Column:
    return F.filter(F.split(as_col(text), SENTENCE_END), lambda s: F.length(F.trim(s)) > 0)


def edit_fraction(draft: str | Column, final: str | Column) -> Column:
    """Edit distance over the longer length, on squeezed text; two empty texts give 0."""
    a, b = squeeze(draft), squeeze(final)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / F.nullif(longer, F.lit(0)))


def token_bucket(token: Column, size: int = 1024) -> Column:
    """First four bytes of the token's SHA-256, modulo ``size``."""
    return (F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % size).cast("int")


def identifiers_survive(question: str | Column, rewrite: str | Column) -> Column:
    """A rewrite counts only if it is not blank, differs, and keeps every identifier of the question."""
    q, r = as_col(question), as_col(rewrite)
    lost = F.size(F.array_except(identifiers(q), identifiers(r)))
    return (F.length(F.trim(r)) > 0) & (q != r) & (lost == 0)

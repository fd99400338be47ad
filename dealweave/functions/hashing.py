"""Content and request hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealweave.functions.order import as_col
from dealweave.functions.text import question_key

UNNAMED = "(unnamed)"


def content_hash(title: str | Column, body: str | Column) -> Column:
    """Digest that changes whenever the title or the body of a document changes."""
    shown = F.coalesce(F.nullif(as_col(title), F.lit("")), F.lit(UNNAMED))
    return F.md5(F.concat_ws("\n", shown, F.coalesce(as_col(body), F.lit(""))))


def request_key(question: str | Column, *context: str | Column) -> Column:
    """Cache key of a question in its context (history, data date, rules version)."""
    parts = [question_key(question)] + [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in context]
    return F.sha2(F.concat_ws("\n", *parts), 256)


def short_digest(text: str | Column) -> Column:
    """The first 128 bits of a text's SHA-256 as bytes: a quarter of its hexadecimal form, which no shuffle compresses."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)

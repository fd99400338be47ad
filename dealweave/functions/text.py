"""Text normalisation and pattern helpers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealweave.functions.order import as_col

# Endings a company name loses when it is turned into a matching key.
WEB_SUFFIXES = ("ai", "io", "com", "in", "co", "app", "xyz", "so", "tech", "one", "club", "dev", "org", "net", "me")
LEGAL_SUFFIXES = (
    "privatelimited", "pvtltd", "limited", "ltd", "inc", "llp", "technologies", "technology", "labs", "hq", "india",
)
# Honorifics ignored when two spellings of one person are grouped.
HONORIFICS = ("dr", "mr", "ms")

LIST_SEPARATOR = r"\s*[,;\n]\s*"


@dataclass(frozen=True)
class WordAnalyzer:
    """From a text to its terms in order, word by word: ``words`` of a text, and ``terms`` of an array of words, as many,
    with a null for a word that is no term. Frequent words can so be analysed once."""

    words: Callable[[Column], Column]
    terms: Callable[[Column], Column]

    def __call__(self, text: Column) -> Column:
        return self.terms(self.words(text))


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def name_key(c: str | Column) -> Column:
    """Matching key of a company name; NULL when the name has no usable characters.

    Each ending is removed once, so the key of a key can be shorter: apply it to raw names only. Java's ``$`` also
    matches before a trailing line break, hence ``\\z``.
    """
    key = F.lower(F.trim(F.coalesce(as_col(c), F.lit(""))))
    key = F.replace(key, F.lit("&"), F.lit("and"))
    key = F.regexp_replace(key, rf"\.({'|'.join(WEB_SUFFIXES)})\z", "")
    key = F.regexp_replace(key, "[^a-z0-9]", "")
    key = F.regexp_replace(key, rf"({'|'.join(LEGAL_SUFFIXES)})\z", "")
    return F.nullif(key, F.lit(""))


def profile_slug(link: str | Column, host: str = "linkedin.com/in/") -> Column:
    """Handle in a profile link in lower case, NULL when the link is of another kind."""
    handle = F.regexp_extract(as_col(link), rf"(?i){re.escape(host)}([^/?#]+)", 1)
    return F.lower(F.nullif(handle, F.lit("")))


def title_part(entry: str | Column) -> Column:
    """Text before the last ' - ' of a "Title - Company" entry; NULL without a separator."""
    e = F.trim(as_col(entry))
    return F.when(F.contains(e, F.lit(" - ")), F.trim(F.regexp_extract(e, r"(?s)^(.*) - .*\z", 1)))


def company_part(entry: str | Column) -> Column:
    """Text after the last ' - ' of a "Title - Company" entry; the whole entry without a separator."""
    e = F.trim(as_col(entry))
    return F.when(
        F.contains(e, F.lit(" - ")), F.trim(F.regexp_extract(e, r"(?s)^.* - (.*)\z", 1))
    ).otherwise(e)


def question_key(c: str | Column) -> Column:
    """Question in lower case with single spaces and without closing punctuation."""
    squeezed = F.regexp_replace(F.lower(F.coalesce(as_col(c), F.lit(""))), r"\s+", " ")
    return F.trim(F.regexp_replace(squeezed, r"[\s?.!]+\z", ""))


def query_text_key(c: str | Column) -> Column:
    """Key of a search text: lower case, single spaces, punctuation kept."""
    return F.lower(F.trim(F.regexp_replace(as_col(c), r"\s+", " ")))


def first_name_token(c: str | Column) -> Column:
    """First word of a person's name in lower case, without an honorific."""
    bare = F.regexp_replace(as_col(c), rf"(?i)^({'|'.join(HONORIFICS)})\.?\s+", "")
    return F.lower(F.split_part(bare, F.lit(" "), F.lit(1)))


def split_parts(c: str | Column, separator: str = LIST_SEPARATOR) -> Column:
    """Trimmed, non-blank parts of a delimited text; an empty array for NULL."""
    parts = F.split(F.coalesce(as_col(c), F.lit("")), separator)
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def joined(c: str | Column, separator: str = ", ") -> Column:
    """Array as text; NULL for NULL and for an array without text."""
    return F.nullif(F.array_join(as_col(c), separator), F.lit(""))


def labelled_lines(*lines: tuple[str, Column]) -> Column:
    """"Label: value" lines, one per present value."""
    return F.concat_ws("\n", *[F.concat(F.lit(label), value) for label, value in lines])


def squeeze(c: str | Column, length: int) -> Column:
    """First ``length`` characters with every run of white space turned into one space."""
    return F.regexp_replace(F.substring(as_col(c), 1, length), r"\s+", " ")


def any_word(words: Iterable[str]) -> str:
    """Pattern matching any of the given alternatives as whole words, ignoring case."""
    return rf"(?i)\b({'|'.join(words)})\b"


def matches(c: str | Column, pattern: str) -> Column:
    """Case-insensitive regular expression match."""
    return as_col(c).rlike(f"(?i){pattern}")


def has_text(c: str | Column) -> Column:
    """True for present, non-empty text."""
    return F.nullif(as_col(c), F.lit("")).isNotNull()


def holds_any(array: str | Column, *values: str) -> Column:
    """True when the array shares a value with ``values``; NULL arrays count as false."""
    return F.coalesce(F.arrays_overlap(as_col(array), F.array(*[F.lit(v) for v in values])), F.lit(False))


def holds(array: str | Column, value: str) -> Column:
    """True when the array holds the value; NULL arrays count as empty."""
    return F.coalesce(F.array_contains(as_col(array), value), F.lit(False))

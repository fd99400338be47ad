"""SQL texts without what stands inside literals, quoted names and comments, in one pass."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What opens at a place decides how it ends; an end that is missing is the end of the text.
_OPENING = re.compile(r"""
    (?P<escaped>(?<![\w$])[eE]'(?:[^'\\]|\\.|'')*(?:'|\Z))
  | (?P<string>'(?:[^']|'')*(?:'|\Z))
  | (?P<name>"(?:[^"]|"")*(?:"|\Z))
  | (?<![\w$])\$(?P<tag>(?:[^\W\d]\w*)?)\$(?:.*?\$(?P=tag)\$|.*\Z)
  | (?P<line>--[^\n]*)
  | (?P<block>/\*)""", re.DOTALL | re.VERBOSE)
_BLOCK_EDGE = re.compile(r"/\*|\*/")


def _block_end(sql: str, at: int) -> int:
    """Where a block comment ends whose text starts at a place; comments inside it end first."""
    depth = 1
    while depth:
        edge = _BLOCK_EDGE.search(sql, at)
        if edge is None:
            return len(sql)
        depth += 1 if edge.group() == "/*" else -1
        at = edge.end()
    return at


def without_literals(sql: str | None) -> str | None:
    """The text with strings as '', quoted names as "" and comments as blanks; null stays null."""
    if sql is None:
        return None
    kept, at = [], 0
    while (found := _OPENING.search(sql, at)) is not None:
        kept.append(sql[at:found.start()])
        kind = found.lastgroup
        kept.append(" " if kind in ("line", "block") else '""' if kind == "name" else "''")
        at = _block_end(sql, found.end()) if kind == "block" else found.end()
    return "".join([*kept, sql[at:]])


def bare_sql(sql: Column) -> Column:
    """``without_literals`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(without_literals)

    return run(sql)

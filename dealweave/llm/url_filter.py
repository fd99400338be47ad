"""URL filters: rules by host and path, then a blocked Bloom filter in front of an exact join with listed URLs.

The filter is an ordinary table: a row per block of eight 64-bit words, built by one aggregation of the listed URLs.
Each URL sets one bit in every word of the one block its hash names, so a lookup reads a single row. A page's URL is
looked up in its block; only possible hits go on to the exact hash join, which removes the false ones. The filter is
broadcast only when its size, known from the number of blocks, is below a limit, and joined by block number otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.llm.common import by_position, column_at, stored, without

#: Words of a block, listed URLs meant for one block (32 bits a URL), and the largest filter that is broadcast.
WORDS = 8
PER_BLOCK = 16
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Rule:
    """Verdict for a host with all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_host(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (from there to
    ``?``, ``#`` or the end). Both are empty for null and for text without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(lower_host(host), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling for addresses of the same page: no scheme, query or fragment, no ``www.``, ``m.``, ``blog.``
    prefix, no ``.html`` ending or slash at the end. Empty without a host."""
    bare = F.regexp_replace(host, r"^(?:www|m|blog)\.", "")
    return F.when(host == "", "").otherwise(F.concat(bare, F.regexp_replace(path, r"(?:\.html)?/*$", "")))


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule (null without one). Of equally long rules the first in order of
    name wins."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _address(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and one bit for each of its words."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    bits = F.xxhash64(F.lit("bits"), key)
    return block, [F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        for i in range(WORDS)]


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """Filter rows ``block, w0 .. w7`` of a table of distinct keys (column ``key``)."""
    block, masks = _address(F.col("key"), blocks)
    return listed.groupBy(block.alias("block")).agg(*[F.bit_or(m).alias(f"w{i}") for i, m in enumerate(masks)])


def in_list(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Add ``listed`` (boolean) to rows with a column ``key``: is the key in the list?

    ``listed`` has a column ``key``; repeated, null and empty keys count once, never and never.
    """
    keys = stored(listed.where("key <> ''").select("key").distinct())
    blocks = max(1, -(-keys.count() // PER_BLOCK))
    bloom = bloom_table(keys, blocks)
    if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    block, masks = _address(F.col("key"), blocks)
    at = urls.withColumns({"__block": block} | {f"__m{i}": m for i, m in enumerate(masks)})
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(f"__m{i}")) != 0)
    looked = at.join(bloom, (F.col("__block") == F.col("block")) & hit, "left")
    # rows that are no hits take part with a value of their own, or all of them would meet in the partition of NULL
    possible = F.col("block").isNotNull()
    apart = F.concat(F.lit("\0"), F.xxhash64("key").cast("string"))
    looked = looked.withColumns({"__possible": possible, "__probe": F.when(possible, F.col("key")).otherwise(apart)})
    exact = looked.join(keys.select(F.col("key").alias("__listed")),
                        (F.col("__probe") == F.col("__listed")) & F.col("__possible"), "left")
    return exact.select(*urls.columns, F.col("__listed").isNotNull().alias("listed"))


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row; other columns stay.

    The longest fitting rule decides; without one a URL whose canonical form is in ``listed`` (a column ``key`` of
    canonical forms) is blocked and any other allowed. A null URL, or one without ``://``, has an empty host and path,
    fits no rule, is never listed and is allowed. Input columns with the new names are replaced.
    """
    host, path = url_parts(F.col(f"c{column_at(pages, url)}"))
    names = without(pages.columns, ["host", "path", "rule", "verdict"])
    kept = [f"c{column_at(pages, c)}" for c in names]
    rows = by_position(pages).select(*kept, host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict, "key": canonical(F.col("host"), F.col("path"))})
    rows = in_list(rows, listed)
    return rows.select(
        *kept, "host", "path", "rule",
        F.coalesce("given", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
    ).toDF(*names, "host", "path", "rule", "verdict")

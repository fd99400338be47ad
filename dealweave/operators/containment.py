"""Rows whose cells lie in a row of another table of the same group.

A cell is held by a row that has an equal cell or, from ``min_part`` characters on, a longer cell it is part of. A row
is covered by a table if one of the table's rows holds the wanted share of its cells. All covered rows are found. A group
of few cells (``SMALL_CELLS``, ``SMALL_CHARS``) is brought together, and its rows are compared with each other. In larger
ones:

* ``cell_holders`` finds which cells are part of others through a look-up of character windows, so afterwards every row
  is a plain set of the cells it holds and only equal values meet;
* a row meets the rows that hold one of its rarest cells, as many of them as a covering row cannot all miss;
* where even these are frequent, rows that are equal as sets are found by their digest, and the others meet on pairs
  of cells instead of single ones.

Nulls and empty cells have to be left out before; a group or table without rows has no results; equal rows are one kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.functions.hashing import short_digest
from dealweave.operators.rows import first_per_group
from dealweave.session import materialised

#: A cell in more rows of a table than this is frequent: its rows meet by digest and by pairs.
CROWDED = 64
#: Long cells are cut into blocks before their windows are taken, since a place in a text is found by counting to it.
BLOCK = 1000
#: Groups of at most so many cells, with so many characters, are compared row by row: the work for each is bounded.
SMALL_CELLS, SMALL_CHARS = 512, 16_384


def window_hashes(text: Column, width: Column) -> Column:
    """Hashes of all pieces of ``width`` characters, in order; none where the text is shorter."""
    last = F.length(text) - width + 1

    def pieces(start: Column) -> Column:
        block = F.substring(text, start, F.lit(BLOCK) + width - 1)
        return F.transform(F.sequence(F.lit(1), F.length(block) - width + 1),
                           lambda i: F.xxhash64(F.substring(block, i, width)))

    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(BLOCK))
    return F.when(last >= 1, F.flatten(F.transform(starts, pieces))).otherwise(F.array().cast("array<bigint>"))


def cell_holders(cells: DataFrame, keys: Sequence[str], min_part: int = 4) -> DataFrame:
    """(*keys, part, whole): which cells of a group occur inside longer ones of it.

    ``cells``: the keys and ``cell``, without repeats. A part is looked up by its rarest window of the greatest width
    that fits (``min_part`` times 1, 2, 4 or 8 characters); longer cells with that window are compared in full.
    """
    if min_part < 1:
        raise ValueError("a part has at least one character")
    widths = [min_part << i for i in range(4)]
    cell, size = F.col("cell"), F.length("cell")
    windows = [window_hashes(cell, F.lit(w)) for w in widths]
    posts = cells.filter(size >= min_part).select(
        *keys, cell.alias("whole"), F.explode(F.array_distinct(F.concat(*windows))).alias("_window"))
    counts = posts.groupBy(*keys, "_window").agg(F.count(F.lit(1)).alias("_n"))
    width = reduce(lambda older, w: F.when(size >= w, F.lit(w)).otherwise(older), widths[1:], F.lit(min_part))
    parts = cells.filter(size >= min_part).select(
        *keys, cell.alias("part"), F.explode(F.array_distinct(window_hashes(cell, width))).alias("_window"))
    rarest = first_per_group(
        parts.join(counts, [*keys, "_window"]), [*keys, "part"], [F.col("_n"), F.col("_window")]).filter("_n > 1")
    met = rarest.drop("_n").join(posts, [*keys, "_window"])
    return met.filter((F.length("whole") > F.length("part")) & F.contains("whole", F.col("part"))).select(
        *keys, "part", "whole")


def held_cells(kinds: DataFrame, min_part: int = 4) -> DataFrame:
    """(group, table, row_key, held): the cells of the group that each row holds, as a set.

    ``kinds``: group, table, row_key, cells (a list without empty cells).
    """
    own = kinds.select("group", "table", "row_key", F.explode(F.array_distinct("cells")).alias("cell"))
    holders = cell_holders(own.select("group", "cell").distinct(), ["group"], min_part)
    parts = own.join(holders.withColumnRenamed("whole", "cell"), ["group", "cell"]).select(
        "group", "table", "row_key", F.col("part").alias("cell"))
    return own.unionByName(parts).groupBy("group", "table", "row_key").agg(F.collect_set("cell").alias("held"))


_ROW = ["group", "covered", "row_key", "by"]


def _pairs_of(cells: Column) -> Column:
    """All pairs of a sorted list, the smaller first."""
    return F.flatten(F.transform(cells, lambda x: F.transform(
        F.filter(cells, lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))


def _digest(cells: Column) -> Column:
    return short_digest(F.array_join(F.sort_array(F.array_distinct(cells)), "\n"))


class Containment:
    """Covered rows of ``kinds`` (group, table, row_key, cells); the steps for large groups are kept for tests and plans."""

    def __init__(self, kinds: DataFrame, share: float = 0.9, min_part: int = 4, crowded: int = CROWDED,
                 small_cells: int = SMALL_CELLS):
        self.share, self.min_part, self.crowded = share, min_part, crowded
        self.kinds = materialised(kinds.filter(F.size("cells") > 0).select("group", "table", "row_key", "cells"))
        chars = F.aggregate("cells", F.lit(0).cast("bigint"), lambda n, c: n + F.coalesce(F.length(c), F.lit(0)))
        sizes = self.kinds.groupBy("group").agg(F.sum(F.size("cells")).alias("n"), F.sum(chars).alias("chars"))
        large = materialised(sizes.filter((F.col("n") > small_cells) | (F.col("chars") > SMALL_CHARS)).select("group"))
        self.any_large = not large.isEmpty()
        self.small = self.kinds.join(large, "group", "left_anti") if self.any_large else self.kinds
        self.large = self.kinds.join(large, "group", "left_semi")

    @cached_property
    def held(self) -> DataFrame:
        return materialised(held_cells(self.large, self.min_part))

    @cached_property
    def rows(self) -> DataFrame:
        return self.large.select(
            "group", F.col("table").alias("covered"), "row_key", "cells", self._need(F.col("cells")).alias("need"))

    @cached_property
    def entries(self) -> DataFrame:
        return self.held.select(
            "group", F.col("table").alias("by"), F.col("row_key").alias("by_key"), F.explode("held").alias("cell"))

    @cached_property
    def met(self) -> DataFrame:
        return materialised(self._met())

    def _need(self, cells: Column) -> Column:
        return F.ceil(F.round(F.size(cells) * F.lit(self.share), 6)).cast("int")

    def in_small_groups(self) -> DataFrame:
        """Covered rows of small groups: every row is compared with the rows of the group's other tables where they lie."""
        kinds = self.small.groupBy("group").agg(F.collect_list(F.struct("table", "row_key", "cells")).alias("rows"))
        each = kinds.filter(F.col("group").isNotNull()).select("group", "rows", F.explode("rows").alias("row"))

        def covers(other: Column) -> Column:
            held = F.filter("row.cells", lambda c: F.exists(other["cells"], lambda x: (x == c) | (
                (F.length(c) >= self.min_part) & F.contains(x, c))))
            return (other["table"] != F.col("row.table")) & (
                F.size(held) >= F.greatest(self._need(F.col("row.cells")), F.lit(1)))

        tables = F.array_distinct(F.transform(F.filter("rows", covers), lambda other: other["table"]))
        return each.select("group", F.col("row.table").alias("covered"), F.col("row.row_key").alias("row_key"),
                           F.explode(tables).alias("by"))

    def _met(self) -> DataFrame:
        """Cells of each row that a table holds anywhere, rarest first, where these are enough.

        ``before``: how many cells of the row are rarer, ``most``: the greatest repetition among these, ``spare``: one
        more than a covering row may miss, ``least``: rows that hold the rarest cell.
        """
        frequency = self.entries.groupBy("group", "by", "cell").agg(F.count(F.lit(1)).alias("n"))
        cells = self.rows.select("group", "covered", "row_key", "need", F.explode("cells").alias("cell")).groupBy(
            "group", "covered", "row_key", "need", "cell").agg(F.count(F.lit(1)).alias("times"))
        joined = cells.join(frequency, ["group", "cell"]).filter(F.col("covered") != F.col("by"))
        whole = Window.partitionBy(*_ROW)
        earlier = whole.orderBy("n", "cell").rowsBetween(Window.unboundedPreceding, -1)
        out = joined.withColumns({
            "found": F.sum("times").over(whole), "most_times": F.max("times").over(whole), "least": F.min("n").over(whole),
            "before": F.coalesce(F.sum("times").over(earlier), F.lit(0)),
            "most": F.coalesce(F.max("times").over(earlier), F.lit(0))})
        return out.filter("found >= need").withColumn("spare", F.expr("found - need + 1"))

    def at_once(self) -> DataFrame:
        """Rows of which one cell, with its repeats, is enough: any row that holds it covers them."""
        return self.met.filter("times >= need").select(*_ROW).distinct()

    def _open(self) -> DataFrame:
        return self.met.filter("most_times < need")

    def equal_sets(self) -> DataFrame:
        """Rows with frequent cells only that some row of the other table equals, among the cells of their own table."""
        rows = self._open().filter(F.col("least") > self.crowded).select(*_ROW).distinct()
        tables = rows.select("group", "covered", "by").distinct()
        words = self.rows.select("group", "covered", F.explode("cells").alias("cell")).distinct()
        seen = self.entries.join(tables, ["group", "by"]).join(words, ["group", "covered", "cell"]).groupBy(
            "group", "covered", "by", "by_key").agg(F.collect_set("cell").alias("cells"))
        seen = seen.select("group", "covered", "by", _digest(F.col("cells")).alias("digest")).distinct()
        own = rows.join(self.rows, ["group", "covered", "row_key"]).select(*_ROW, _digest(F.col("cells")).alias("digest"))
        return own.join(seen, ["group", "covered", "by", "digest"]).select(*_ROW)

    def candidates(self, done: DataFrame) -> DataFrame:
        """(row, by, by_key): rows to be compared, through a rare cell or through two frequent ones."""
        single = self._open().filter((F.col("least") <= self.crowded) & (F.col("before") < F.col("spare")))
        rare = single.select(*_ROW, "cell").join(self.entries, ["group", "by", "cell"]).drop("cell")
        left = self._open().filter(F.col("least") > self.crowded).join(done, _ROW, "left_anti")
        firsts = left.filter(F.col("before") - F.col("most") < F.col("spare"))
        wanted = firsts.groupBy(*_ROW).agg(F.sort_array(F.collect_set("cell")).alias("cells"))
        wanted = wanted.select(*_ROW, F.explode(_pairs_of(F.col("cells"))).alias("pair"))
        needed = firsts.select("group", "by", "cell").distinct()
        offered = self.entries.join(needed, ["group", "by", "cell"]).groupBy("group", "by", "by_key").agg(
            F.sort_array(F.collect_set("cell")).alias("cells"))
        offered = offered.select("group", "by", "by_key", F.explode(_pairs_of(F.col("cells"))).alias("pair"))
        paired = wanted.join(offered, ["group", "by", "pair"]).drop("pair")
        return rare.unionByName(paired).distinct()

    def covered(self) -> DataFrame:
        """(group, covered, row_key, by): every row and the tables that cover it."""
        found = self.in_small_groups().select(*_ROW)
        return found.unionByName(self._in_large_groups()).distinct() if self.any_large else found.distinct()

    def _in_large_groups(self) -> DataFrame:
        equal = materialised(self.equal_sets())
        pairs = self.candidates(equal).join(self.rows, ["group", "covered", "row_key"]).join(
            self.held.select("group", F.col("table").alias("by"), F.col("row_key").alias("by_key"), "held"),
            ["group", "by", "by_key"])
        enough = F.size(F.filter("cells", lambda c: F.array_contains("held", c))) >= F.col("need")
        return self.at_once().unionByName(equal).unionByName(pairs.filter(enough).select(*_ROW))

"""Texts and arrays made of the values of a group.

Values are always reduced to distinct (group, value) pairs first: that step aggregates inside the map tasks and
spreads a hot group over all reducers, and only the values the result cell has to show are brought together.
Lists that can outgrow a cell are written by ``list_parts`` in numbered parts of a stated size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.session import materialised

#: Values of one part of a list.
PART_ITEMS = 10_000


def distinct_join(value: str | Column, separator: str = ", ", where: Column | None = None) -> Column:
    """Aggregate: distinct values as sorted text, NULL when there is none."""
    return F.nullif(F.array_join(distinct_array(value, where), separator), F.lit(""))


def distinct_array(value: str | Column, where: Column | None = None) -> Column:
    """Aggregate: distinct non-NULL values as a sorted array."""
    column = F.col(value) if isinstance(value, str) else value
    return F.sort_array(F.collect_set(column if where is None else F.when(where, column)))


def ordered_join(value: str, order: Sequence[str], separator: str = ", ") -> Column:
    """Aggregate: values as text in ascending order of ``order``, rows with a NULL value left out.

    Meant for groups of bounded size, such as the slots of one deal.
    """
    item = F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("_v")))
    sorted_items = F.sort_array(F.collect_list(item))
    return F.nullif(F.array_join(F.transform(sorted_items, lambda x: x["_v"]), separator), F.lit(""))


def latest_by(value: str, order: str, tie: str) -> Column:
    """Aggregate: value of the row with the greatest ``order`` (NULL orders last); the value itself may be NULL.

    ``tie`` decides between equal orders: the smallest wins nothing here, the greatest does, like the order itself.
    """
    return F.max(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("o"), F.col(tie).alias("t"),
                          F.col(value).alias("v")))["v"]


def shortest(value: str) -> Column:
    """Aggregate: the shortest text of a group, the first in order among equals."""
    return F.min(F.struct(F.length(value).alias("n"), F.col(value).alias("v")))["v"]


def list_parts(df: DataFrame, keys: Sequence[str], value: str, out: str, separator: str = ", ",
               part_items: int = PART_ITEMS) -> DataFrame:
    """(keys, part, out): distinct values per group as sorted text, ``part_items`` values to a part.

    Part p holds the values ranked p * part_items + 1 and on, in the order of their md5, whatever the size of the group;
    a small group has part 0 alone, and is brought together at once. Of the others the rank is counted in 4,096 ranges of
    md5 with the sizes of the ranges before, so no task sorts or gathers a whole group.
    """
    # Written once: the sizes, the small groups and the ranks all read the pairs.
    pairs = materialised(df.filter(F.col(value).isNotNull()).select(*keys, value).distinct())
    large = materialised(pairs.groupBy(*[F.col(k).alias(f"_l_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") > part_items).drop("_n"))
    text = F.array_join(F.sort_array(F.collect_list(value)), separator).alias(out)
    if large.isEmpty():
        return pairs.groupBy(*keys).agg(text).select(*keys, F.lit(0).cast("bigint").alias("part"), out)
    among = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
    small = pairs.join(large, among, "left_anti").groupBy(*keys).agg(text).select(
        *keys, F.lit(0).cast("bigint").alias("part"), out)
    pairs = pairs.join(large, among, "left_semi").withColumn("_range", F.substring(F.md5(value), 1, 3))
    before = Window.partitionBy(*[f"_w_{k}" for k in keys]).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sizes = pairs.groupBy(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("_range").alias("_r")).agg(
        F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys] + [F.col("_range") == F.col("_r")]
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy("_h"))
    # Dealt first and hashed again there, so that no shuffle carries the digests, which do not compress.
    ranked = pairs.repartition(*keys, "_range").withColumn("_h", F.md5(value)).withColumn("_in", inside).drop("_h")
    ranked = ranked.join(sizes, same)
    part = F.floor((F.col("_before") + F.col("_in") - 1) / part_items)
    return small.unionByName(ranked.groupBy(*keys, part.alias("part")).agg(text))


def breakdown(df: DataFrame, keys: Sequence[str], part: str, item: str, out: str) -> DataFrame:
    """Per group a text of "part count" entries, most frequent first, counting distinct items.

    ``part`` is a category with few values; counts are taken per (group, part) before anything is brought together.
    """
    counts = df.select(*keys, part, item).distinct().groupBy(*keys, part).agg(F.count(item).alias("_n"))
    return breakdown_text(counts, keys, part, "_n", out)


def breakdown_text(counts: DataFrame, keys: Sequence[str], part: str, n: str, out: str,
                   shape: str = "%s %d") -> DataFrame:
    """Counted categories per group as one text, largest count first, then by name."""
    entry = F.struct((-F.col(n)).alias("o"), F.col(part).alias("p"))
    texts = F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.format_string(shape, e["p"], -e["o"]))
    return counts.groupBy(*keys).agg(F.array_join(texts, ", ").alias(out))


def pivot_slots(df: DataFrame, keys: Sequence[str], slot: str, fields: dict[str, str], slots: int = 4) -> DataFrame:
    """One row per key with each slot's fields in columns ``<field>_<slot>`` (fixed slots, so no extra pivot job)."""
    cells = [
        F.max(F.when(F.col(slot) == i, F.col(source))).alias(f"{prefix}_{i}")
        for i in range(1, slots + 1) for prefix, source in fields.items()
    ]
    return df.groupBy(*keys).agg(*cells)

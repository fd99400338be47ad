"""First-per-group, top-k and bounded results.

A filter on ``row_number() <= k`` lets Spark drop all but k rows per group inside every map task, before the shuffle,
so a group holding a large share of the input never travels to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_rank"


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The k first rows of every group; ``rank`` names a column that keeps the position."""
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank or _RANK, F.row_number().over(window)).filter(F.col(rank or _RANK) <= k)
    return kept if rank else kept.drop(_RANK)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group, the first by a total order."""
    return top_k_per(df, keys, order, 1)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest row per key, e.g. the last run of every source."""
    return first_per_group(df, keys, order)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows of the whole input (each task keeps k, the rest never moves)."""
    return df.orderBy(*order).limit(k)


def rank_list(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows with their position. The numbering runs over the k kept rows only."""
    best = df.orderBy(*order).limit(k).withColumn("_all", F.lit(0))
    return best.withColumn(rank, F.row_number().over(Window.partitionBy("_all").orderBy(*order))).drop("_all")


def bounded(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """At most n rows plus a flag telling whether there were more; nothing beyond row n + 1 is fetched."""
    fetched = rank_list(df, order, n + 1, "_position")
    cut = fetched.withColumn("_seen", F.max("_position").over(Window.partitionBy(F.lit(0))))
    return cut.filter(F.col("_position") <= n).withColumn("truncated", F.col("_seen") > n).drop("_position", "_seen")


def with_group_value(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group aggregates next to the detail rows.

    Aggregated first and joined back: partial sums shrink a hot group before the shuffle, and the join can be split
    by adaptive execution, while a window would sort the whole group in one task.
    """
    totals = df.groupBy(*keys).agg(*[value.alias(name) for name, value in aggregates.items()])
    marked = [f"_group_{k}" for k in keys]
    totals = totals.select(*[F.col(k).alias(m) for k, m in zip(keys, marked)], *aggregates)
    condition = [F.col(k).eqNullSafe(F.col(m)) for k, m in zip(keys, marked)]
    return df.join(totals, condition, "left").drop(*marked)


def spread(df: DataFrame) -> DataFrame:
    """Plain scan spread over the cluster when its files split into fewer tasks than there are cores.

    For work that costs far more than reading, such as taking texts apart. Large inputs have tasks enough and are
    returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

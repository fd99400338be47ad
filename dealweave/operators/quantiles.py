"""Exact quantiles without sorting or gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DIGIT_BITS = 16


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, scale: int = 2) -> DataFrame:
    """Median per group of a decimal column, the mean of the two middle values for an even count.

    Values are read as 64-bit integers (``scale`` decimal places) and the two middle ranks are followed through four
    16-bit digits. Each step counts rows per group and digit (at most 65,536 counts per group, partially summed in
    the map tasks) and keeps the rows of the digit the rank falls into. NULLs are ignored.
    """
    scaled = (F.col(value).cast(f"decimal(18,{scale})") * (10 ** scale)).cast("bigint")
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, scaled.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = rows.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    middles = F.array_distinct(F.array(F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1))
    ranks = sizes.select(*keys, F.explode(middles).alias("_target"))
    active = ranks.withColumn("_left", F.col("_target")).withColumn("_prefix", F.lit(None).cast("bigint"))
    for step in range(3, -1, -1):
        shift = step * _DIGIT_BITS
        counts = rows.groupBy(*keys, F.shiftright("_v", shift).alias("_digit")).agg(F.sum("_n").alias("_n"))
        counts = counts.withColumn("_parent", F.shiftright("_digit", _DIGIT_BITS))
        on = [F.col(f"_a_{k}").eqNullSafe(F.col(k)) for k in keys]
        targets = active.select(*[F.col(k).alias(f"_a_{k}") for k in keys], "_target", "_left", "_prefix")
        if step < 3:
            on.append(F.col("_parent") == F.col("_prefix"))
        found = targets.join(counts, on)
        window = Window.partitionBy(*[f"_a_{k}" for k in keys], "_target").orderBy("_digit")
        found = found.withColumn("_upto", F.sum("_n").over(window))
        found = found.filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
        active = found.select(
            *[F.col(f"_a_{k}").alias(k) for k in keys], "_target",
            (F.col("_left") - (F.col("_upto") - F.col("_n"))).alias("_left"), F.col("_digit").alias("_prefix"),
        )
    middle = active.groupBy(*keys).agg(F.avg(F.col("_prefix").cast("double")).alias("_m"))
    return middle.select(*keys, (F.col("_m") / float(10 ** scale)).alias(out))

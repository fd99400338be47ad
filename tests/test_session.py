"""Written tables and what is left on disk after them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from dealweave.session import SHUFFLES_REMOVED, materialised


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    frame = spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    kept = materialised(frame)
    assert not shuffle_files(spark) - before
    assert sum(r.n for r in kept.collect()) == 1000 and frame.count() == 7
    assert spark.conf.get(SHUFFLES_REMOVED) == "false"

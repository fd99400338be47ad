"""Pivot search against the full scan, and what it leaves unread."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealweave.operators import pivots
from dealweave.operators.pivots import pivot_index, pivot_top_k
from dealweave.operators.vectors import vector_top_k


def clustered(spark, seed=1, groups=12, each=40, width=8):
    """Vectors around a few directions, a third of them copies of one, and rows no search may find."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    vectors = [(centres[i % groups] + rng.normal(0, 0.05, width)).tolist() for i in range(groups * each)]
    vectors += [centres[0].tolist()] * (groups * each // 2)
    rows = list(enumerate(vectors))
    rows += [(9000, None), (9001, [None] * width), (9002, [0.0] * width), (None, centres[1].tolist()), (9003, []),
             (9004, [1.0, 2.0]), (9005, [2.0, -1.0]), (7, vectors[7])]
    return spark.createDataFrame(rows, "id int, embedding array<double>").repartition(5)


def asked(df):
    return df.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def found(hits):
    return sorted((r.query_id, r["rank"], r.id, r.similarity) for r in hits.collect())


@pytest.mark.parametrize("k, exclude_self, share, count", [(3, False, 4096, None), (5, True, 50, 20), (700, False, 64, 3), (1, True, 7, 40)])
def test_equals_the_full_scan(spark, monkeypatch, k, exclude_self, share, count):
    monkeypatch.setattr(pivots, "SHARE", share)
    df = clustered(spark)
    queries = asked(df.filter("(id % 24 = 0 and id < 480) or id between 500 and 503 or id > 8999")).unionByName(
        spark.createDataFrame([(-1, [1.0, 2.0, 3.0]), (-2, [-1.0] * 8)], "query_id int, vector array<double>"))
    hits, reads = pivot_top_k(queries, pivot_index(df, pivots=count), k, exclude_self=exclude_self)
    assert found(hits) == found(vector_top_k(queries, df, k, exclude_self=exclude_self))
    read = {r.query_id: (r.compared, r.stored) for r in reads.collect()}
    assert read[-1] == (0, 0) and read[9004][1] == 2 and 9001 not in read and 9002 not in read
    assert all(c <= n for c, n in read.values())


def test_random_directions_and_tied_places(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(150, 5))
    df = spark.createDataFrame([(f"v{i}", data[i % 75].tolist()) for i in range(150)], "id string, embedding array<float>")
    hits, _ = pivot_top_k(asked(df), pivot_index(df), 4)
    assert found(hits) == found(vector_top_k(asked(df), df, 4))


def test_most_vectors_stay_unread(spark):
    df = clustered(spark, seed=2, groups=30, each=60)
    queries = asked(df.filter("id < 1800 and id % 100 = 1"))
    _, reads = pivot_top_k(queries, pivot_index(df), 5)
    total = reads.agg(F.sum("compared").alias("compared"), F.sum("stored").alias("stored")).first()
    assert total.compared < total.stored / 4


def test_files_of_other_pivots_are_not_opened(spark):
    df = clustered(spark, seed=3)
    index = pivot_index(df, pivots=20)
    cell = index.cells.filter("cell >= 0").first().cell
    visits = asked(df.filter("id = 25")).select(F.lit(cell).alias("cell"), "query_id", F.col("vector").alias("v"))
    read = pivots._read(visits, index, 2, False)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"PartitionFilters: \[[^\]]*pivot#\d+ = {cell // pivots.SHELLS}\)", plan)
    assert read.count() > 0


def test_empty_sides(spark):
    df = clustered(spark)
    hits, reads = pivot_top_k(asked(df.limit(0)), pivot_index(df), 3)
    assert hits.count() == 0 and reads.count() == 0
    hits, reads = pivot_top_k(asked(df.filter("id < 3")), pivot_index(df.limit(0)), 3)
    assert hits.count() == 0 and {(r.compared, r.stored) for r in reads.collect()} == {(0, 0)}

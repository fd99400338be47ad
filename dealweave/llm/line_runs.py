"""Line de-duplication over levelled sorted runs of line hashes.

A store keeps, for each line key seen so far, in how many documents it was found, as sorted runs in levels. A batch of
documents is reduced to its own key counts, merge-anti-joined with the keys that the runs have settled already (found
in enough documents, so more counts change nothing), and the rest is added as a run of level 0. When a level holds
``fanout`` runs they are merged into one of the next level, so a key is rewritten a logarithmic number of times.

Everything is DataFrame work; texts are read twice and shuffled once, and only for the documents' own rows. A line
key is known by two 64-bit hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm.common import by_position, column_at, lower_ascii, shared_folder, stored, without

BLANKS = " \t\n\x0b\x0c\r"


class LineRuns:
    """Counts of documents by line key (columns ``a``, ``b``) in levels of sorted runs below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, min_docs: int, fanout: int = 4):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder, min_docs, fanout
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.folder}/level-{level}/run-{uuid.uuid4().hex}"
        counts.sortWithinPartitions("a", "b").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("a bigint, b bigint, n bigint").parquet(*paths)

    def _summed(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("a", "b").agg(F.sum("n").alias("n"))

    def frequent(self) -> DataFrame | None:
        """Keys found in at least ``min_docs`` documents; None while there is no run."""
        paths = [p for level in self.levels for p in level]
        return self._summed(paths).where(F.col("n") >= self.min_docs).select("a", "b") if paths else None

    def add(self, keys: DataFrame) -> None:
        """Add a batch with a row (``a``, ``b``) for each document and key in it, and compact full levels."""
        counts = keys.groupBy("a", "b").agg(F.count("*").alias("n"))
        settled = self.frequent()
        if settled is not None:
            counts = counts.join(settled.hint("merge"), ["a", "b"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._summed(full), level + 1)
            level += 1


def _pair(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def _line_keys(text: Column) -> Column:
    """Array of (a, b) by line; null for lines of white space alone."""

    def key(line: Column) -> Column:
        stripped = F.btrim(line, F.lit(BLANKS))
        a, b = _pair(stripped)
        return F.when(stripped != "", F.struct(a.alias("a"), b.alias("b")))

    return F.transform(F.split(lower_ascii(text), "\n", -1), key)


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4,
                      fanout: int = 4) -> DataFrame:
    """Add ``n_lines``, ``n_dropped`` and ``kept_text``; all rows and other columns stay.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. All lines whose key is found in
    at least ``min_docs`` documents go, in every document; lines of white space alone have no key and stay. The others
    are joined by line feeds. A row is a document: repeated rows count each. Null and empty texts are one empty line.
    Input columns with the new names are replaced.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    names = without(docs.columns, ["n_lines", "n_dropped", "kept_text"])
    kept = [F.col(f"c{column_at(docs, c)}") for c in names]
    whole = F.coalesce(F.col(f"c{column_at(docs, text)}").cast("string"), F.lit(""))
    docs = by_position(docs)
    t1, t2 = _pair(whole)
    keyed = docs.select(t1.alias("t1"), t2.alias("t2"), _line_keys(whole).alias("keys")).withColumn(
        "batch", F.pmod("t1", F.lit(batches)).cast("int"))
    keyed.write.partitionBy("batch").parquet(f"{folder}/keys")
    keyed = spark.read.schema(keyed.schema).parquet(f"{folder}/keys")
    runs = LineRuns(spark, folder, min_docs, fanout)
    for batch in range(batches):
        found = keyed.where(F.col("batch") == batch).select(F.explode(F.array_compact(F.array_distinct("keys"))).alias("k"))
        runs.add(found.select("k.a", "k.b"))
    common = stored(runs.frequent(), folder)
    texts = keyed.select("t1", "t2", F.posexplode("keys").alias("pos", "k")).select("t1", "t2", "pos", "k.a", "k.b").join(
        common, ["a", "b"], "left_semi")
    # written, so that the join below has a shuffle of its own on both sides and a much repeated text can be split
    texts = stored(texts.groupBy("t1", "t2").agg(F.collect_set("pos").alias("drop")), folder)
    rows = docs.select(*kept, whole.alias("whole")).withColumns(dict(zip(["w1", "w2"], _pair(F.col("whole")), strict=True)))
    met = rows.join(texts, (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")), "left")
    lines = F.split("whole", "\n", -1)
    # the difference of two arrays of numbers is taken by hashing, in time linear in the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    left = F.transform(stay, lambda i: F.get("lines", i))
    met = met.withColumn("lines", lines).withColumn("stay", F.when(F.col("drop").isNotNull(), left))
    n_lines = F.size("lines").cast("bigint")
    return met.select(
        *kept, n_lines.alias("n_lines"),
        F.when(F.col("stay").isNull(), 0).otherwise(n_lines - F.size("stay")).cast("bigint").alias("n_dropped"),
        F.when(F.col("stay").isNull(), F.col("whole")).otherwise(F.array_join("stay", "\n")).alias("kept_text"),
    ).toDF(*names, "n_lines", "n_dropped", "kept_text")

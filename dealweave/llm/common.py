"""Helpers shared by the training-data operators: Arrow row mapping in bounded slices, shared storage, group labels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes handled at once inside a Python task; a longer single text forms a slice of its own.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor of a cluster can reach.

    Only a local session without that setting gets the folder ``checkpoints`` of its own warehouse instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it back, so lost executors never cost more than one stage."""
    path = f"{folder or shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters as they are. Pure ASCII texts take the fast JVM path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def text_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts sum up to at most ``limit`` bytes (or one longer text)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def column_at(df: DataFrame, name: str) -> int:
    """Position of a column: the one of exactly this name, else the only one that differs in case alone."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [
        i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns named {name}")
    return found[0]


def by_position(df: DataFrame) -> DataFrame:
    """The same rows with columns named ``c0``, ``c1`` and so on, which clash with no other name."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def without(names: list[str], new: list[str]) -> list[str]:
    """Names that are none of the new ones, upper or lower case alike."""
    taken = {n.lower() for n in new}
    return [n for n in names if n.lower() not in taken]


def map_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list[bytes]], dict[str, object]]],
    fields: str,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from the UTF-8 bytes of one text column, slice by slice in Arrow batches.

    ``make`` runs once per task and returns the function from a list of byte strings to named columns (lists, numpy or
    Arrow arrays). ``keep`` lists the input columns that stay (all by default); one that has the name of a new column,
    in upper or lower case, is replaced by it. A text that stays travels once.
    """
    added = T.StructType.fromDDL(fields)
    kept = without(df.columns if keep is None else keep, added.names)
    at = column_at(df, text)
    places = [column_at(df, c) for c in kept]
    plain = by_position(df)
    if at in places and isinstance(plain.schema[at].dataType, T.StringType):
        source, read = plain.select(*[f"c{i}" for i in places]), places.index(at)
    else:
        source = plain.select(*[f"c{i}" for i in places], F.col(f"c{at}").cast("string").alias("text"))
        read = len(places)
    new = [T.StructField(f"n{i}", f.dataType) for i, f in enumerate(added)]
    schema = T.StructType(source.schema.fields[:len(places)] + new)
    arrow = to_arrow_schema(added)

    def run(batches):
        work = make()
        for batch in batches:
            for part in text_slices(batch, batch.schema.names[read]):
                made = work(text_bytes(part.column(read)))
                columns = [part.column(i) for i in range(len(places))]
                for f in arrow:
                    x = made[f.name]
                    columns.append(x if isinstance(x, pa.Array) else pa.array(x, type=f.type))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema).toDF(*kept, *added.names)


def group_labels(edges: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an edge table (a, b): columns node, label.

    Alternates between joining every node to the smallest member of its neighbourhood and pulling larger neighbours
    down to it (the large-star / small-star scheme), which needs a logarithmic number of rounds. Neighbourhood minima
    are aggregates with map-side combine, so a node with very many edges is never gathered. Each round is written to
    the shared folder. Raises if it has not settled after ``rounds``.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a <> b").distinct(), folder)
    known = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (both.where("b > a").select("a", F.col("b").alias("x")).join(low, "a")
                 .select(F.col("x").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        edges = stored(small, folder)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h")).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError("group labels did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))

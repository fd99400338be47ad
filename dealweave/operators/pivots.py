"""Exact cosine nearest neighbours that leave out what cannot be near, by pivots and the triangle inequality of angles.

``pivot_index`` files every vector under its nearest pivot and a shell of its angle to it, a *cell*, and knows of each
cell how many vectors it has and how near and far they are. For a query the angle to a pivot bounds its angle to all
vectors of that pivot's cells. ``pivot_top_k`` looks into the cells that surely hold k vectors first; the k-th best of
those then rules out most of the others, and only the rest is read: vectors are stored by pivot, so the files of pivots that
no query needs are not opened.

Pivots and cell bounds are of fixed greatest size and travel to the tasks; queries and vectors stay tables that meet by
cell. Both sides of a large cell are dealt into numbered shares, so a task holds at most about ``SHARE`` of each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dealweave.operators.rows import top_k_per
from dealweave.operators.vectors import _DIGITS, PRODUCT_BYTES, _best_of, _matrices
from dealweave.session import materialised, shared_folder

#: Greatest number of pivots, shells of each, and rows of either side that one task takes of a cell.
MAX_PIVOTS = 1024
SHELLS = 16
SHARE = 4096
#: Queries planned in one Arrow batch.
PLANNED_TOGETHER = 64
#: Angles and similarities are trusted to this much; what is nearer than that to a bound is read.
ANGLE_SLACK, SIMILARITY_SLACK = 1e-6, 4e-9


@dataclass(frozen=True)
class PivotIndex:
    """Stored vectors by cell, the bounds of the cells, and the unit pivots by width with their numbers."""

    items: DataFrame
    cells: DataFrame
    pivots: dict[int, tuple[np.ndarray, np.ndarray]]


def pivot_index(vectors: DataFrame, item_id: str = "id", item_vector: str = "embedding",
                pivots: int | None = None) -> PivotIndex:
    """The vectors by nearest pivot, written to the shared folder.

    ``pivots`` is by default the root of the number of vectors, at most ``MAX_PIVOTS``; they are the vectors whose ids
    hash lowest. Vectors that are NULL, have no id or no length, or hold a NULL are left out, as no search finds them.
    Vectors of a width that no pivot has form a cell of their own, read by every query of that width.
    """
    items = vectors.filter(F.col(item_vector).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("id"), F.col(item_vector).cast("array<double>").alias("v"))
    if pivots is None:
        pivots = int(np.ceil(np.sqrt(items.count())))
    chosen = items.orderBy(F.xxhash64("id"), "id").limit(min(pivots, MAX_PIVOTS)).select("v").collect()
    drawn = _matrices(pa.array([r.v for r in chosen], pa.list_(pa.float64())))
    packed = items.sparkSession.sparkContext.broadcast(drawn)
    schema = T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("turn", T.LongType()), *items.schema.fields,
        T.StructField("angle", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def file(batches):
        turn = 0
        for batch in batches:
            for width, (rows, matrix) in _matrices(batch.column("v")).items():
                cell, angle = _nearest(matrix, *packed.value.get(width, (None, None)))
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(np.arange(turn, turn + len(rows))), batch.column("id").take(pa.array(rows)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1))).cast(arrow.field("v").type),
                     pa.array(angle)], schema=arrow)
                turn += len(rows)

    folder = shared_folder(items.sparkSession)
    path = f"{folder}/items"
    placed = items.mapInArrow(file, schema).withColumn("pivot", _pivot())
    placed.hint("rebalance", "pivot").write.partitionBy("pivot").parquet(path)  # a hot pivot is split over files
    filed = items.sparkSession.read.schema(placed.schema).parquet(path)
    cells = filed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"), F.max(F.size("v")).alias("width"))
    return PivotIndex(filed, materialised(cells, folder), drawn)


def _pivot() -> Column:
    """The part of the stored vectors that a cell lies in."""
    return F.when(F.col("cell") >= 0, F.floor(F.col("cell") / SHELLS)).otherwise(F.col("cell")).cast("int")


def _angles(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(matrix @ pivots.T, -1, 1))


def _nearest(matrix: np.ndarray, numbers: np.ndarray | None, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each unit vector, and its angle to the cell's pivot."""
    if numbers is None or not len(numbers):
        return np.full(len(matrix), -matrix.shape[1], np.int32), np.zeros(len(matrix))
    cell, angle = np.empty(len(matrix), np.int32), np.empty(len(matrix))
    step = max(1, PRODUCT_BYTES // (8 * len(pivots)))
    for start in range(0, len(matrix), step):
        part = slice(start, start + step)
        angles = _angles(matrix[part], pivots)
        best = angles.argmin(axis=1)
        angle[part] = angles[np.arange(len(best)), best]
        cell[part] = numbers[best] * SHELLS + np.minimum(angle[part] / np.pi * SHELLS, SHELLS - 1).astype(np.int32)
    return cell, angle


class _Bounds:
    """What the cells of one width say about a query: how near their vectors can be, and must be."""

    def __init__(self, width: int, pivots: dict, cells: dict[str, np.ndarray]):
        numbers, self.pivots = pivots.get(width, (np.empty(0, np.int64), np.empty((0, width))))
        column = {int(n): i for i, n in enumerate(numbers)}
        of = cells["cell"]
        own = np.array([c // SHELLS in column if c >= 0 else c == -width for c in of.tolist()], bool)
        self.cell, self.n = of[own], cells["n"][own]
        self.near, self.far = cells["near"][own], cells["far"][own]
        self.column = np.array([column.get(c // SHELLS, -1) if c >= 0 else -1 for c in self.cell.tolist()], np.int64)

    def read(self, vector: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the cells that can hold one of the ``wanted`` nearest, the highest similarity in each, and which
        of them to read first."""
        angles = _angles(vector[None], self.pivots)[0]
        to = np.append(angles, 0)[self.column]
        free = self.column < 0
        # A vector is nearer to its own pivot than to the query's, so it lies beyond half of the difference.
        low = np.maximum(np.maximum(to - self.far, self.near - to), (to - angles.min(initial=np.pi)) / 2)
        low = np.where(free, 0, np.maximum(low - ANGLE_SLACK, 0))
        high = np.where(free, np.pi, np.minimum(to + self.far + ANGLE_SLACK, np.pi))
        by_high = np.argsort(high, kind="stable")
        enough = np.searchsorted(np.cumsum(self.n[by_high]), wanted)
        floor = np.cos(high[by_high[enough]]) if enough < len(high) else -1.0
        best = np.cos(np.minimum(low, np.pi))
        places = np.flatnonzero(best >= floor - SIMILARITY_SLACK)
        places = places[np.lexsort((to[places], low[places]))]
        before = np.cumsum(self.n[places]) - self.n[places]
        return places, best[places], before < wanted


def _entries(found: list) -> pa.ListArray:
    """Per query the list of its cells to read."""
    sizes = [len(places) for places, *_ in found]
    columns = {
        "cell": np.concatenate([of.cell[places] for places, _, _, of in found]).astype(np.int32),
        "n": np.concatenate([of.n[places] for places, _, _, of in found]),
        "best": np.concatenate([best for _, best, _, _ in found]),
        "first": np.concatenate([first for _, _, first, _ in found])}
    entries = pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), entries)


def _plan(queries: DataFrame, index: PivotIndex, wanted: int) -> DataFrame:
    """Per query its unit vector and the cells to read: number, size, highest similarity, whether to read it first."""
    known = index.cells.collect()  # at most MAX_PIVOTS * SHELLS, and one for each width without a pivot
    cells = {n: np.array([r[n] for r in known], t) for n, t in
             (("cell", np.int64), ("n", np.int64), ("near", np.float64), ("far", np.float64))}
    packed = queries.sparkSession.sparkContext.broadcast((index.pivots, cells))
    entry = T.StructType.fromDDL("cell int, n bigint, best double, first boolean")
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(entry))])
    arrow = to_arrow_schema(schema)

    def plan(batches):
        pivots, known = packed.value
        bounds: dict[int, _Bounds] = {}
        for batch in batches:
            for width, (rows, matrix) in _matrices(batch.column("v")).items():
                if width not in bounds:
                    bounds[width] = _Bounds(width, pivots, known)
                of = bounds[width]
                for start in range(0, len(rows), PLANNED_TOGETHER):
                    part = slice(start, start + PLANNED_TOGETHER)
                    found = [(*of.read(vector, wanted), of) for vector in matrix[part]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("query_id").take(pa.array(rows[part])),
                         pa.array(list(matrix[part]), arrow.field("v").type),
                         _entries(found).cast(arrow.field("cells").type)], schema=arrow)

    return queries.mapInArrow(plan, schema)


def _read(visits: DataFrame, index: PivotIndex, k: int, exclude_self: bool) -> DataFrame:
    """The k most similar vectors of each query in each share of a cell that it visits."""
    asked = visits.groupBy("cell").agg(F.count("*").alias("asked"))
    shares = index.cells.join(asked, "cell").select(
        "cell", F.ceil(F.col("n") / SHARE).alias("shares"), F.ceil(F.col("asked") / SHARE).alias("asked"))

    def dealt(df: DataFrame, key: Column, own: str, other: str) -> DataFrame:
        """Every row in one share of its own side, met by all shares of the other."""
        return df.join(shares, "cell").withColumn(own, F.pmod(key, own)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))

    parts = [r.pivot for r in visits.select(_pivot().alias("pivot")).distinct().collect()]  # as few as there are pivots
    stored = index.items.filter(F.col("pivot").isin(parts))
    items = dealt(stored.select("cell", "id", "v", "turn"), F.xxhash64("id", "turn"), "shares", "asked")
    asking = dealt(visits.select("cell", "query_id", "v"), F.xxhash64("query_id"), "asked", "shares")
    schema = T.StructType([visits.schema["query_id"], index.items.schema["id"], T.StructField("similarity", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def compare(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return arrow.empty_table()
        ids = held.column("id").to_pylist()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        ids, matrix = [ids[i] for i in order], _rows(held.column("v"))[order]
        names, vectors = asked.column("query_id"), _rows(asked.column("v"))
        found: tuple[list, list, list] = ([], [], [])
        step = max(1, PRODUCT_BYTES // (8 * len(ids)))
        for start in range(0, len(vectors), step):
            similarity = np.round(vectors[start:start + step] @ matrix.T, _DIGITS)
            for name, row in zip(names.slice(start, step).to_pylist(), similarity, strict=True):
                for score, item in _best_of(row, ids, k, name if exclude_self else None):
                    for column, value in zip(found, (name, item, score), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    key = ("cell", "shares", "asked")
    return asking.groupBy(*key).cogroup(items.groupBy(*key)).applyInArrow(compare, schema)


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def pivot_top_k(queries: DataFrame, index: PivotIndex, k: int, query_id: str = "query_id", query_vector: str = "vector",
                exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, similarity, rank) as ``vector_top_k`` finds them, and (query_id, compared, stored).

    The second result says how many vectors each query was compared with, and how many there are of its width.
    Queries need an id of their own; those without one, or with a vector that has no length or holds a NULL, have no
    rows in either result. A query of a width that no vector has is compared with none.
    """
    folder = shared_folder(queries.sparkSession)
    usable = queries.filter(F.col(query_id).isNotNull() & F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v"))
    planned = materialised(_plan(usable, index, k + int(exclude_self)), folder)
    visits = planned.select("query_id", "v", F.inline("cells"))
    order = [F.col("similarity").desc(), F.col("id")]
    near = materialised(top_k_per(_read(visits.filter("first"), index, k, exclude_self), ["query_id"], order, k, rank="rank"), folder)
    floor = near.filter(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
    later = visits.filter("not first").join(floor, "query_id", "left").filter(
        F.col("best") >= F.coalesce("floor", F.lit(-2.0)) - SIMILARITY_SLACK)
    later = materialised(later.drop("floor"), folder)
    both = near.drop("rank").unionByName(_read(later, index, k, exclude_self))
    read = visits.filter("first").select("query_id", "n").unionByName(later.select("query_id", "n"))
    width = index.cells.groupBy("width").agg(F.sum("n").alias("stored"))
    sums = read.groupBy("query_id").agg(F.sum("n").alias("compared"))
    reads = planned.select("query_id", F.size("v").alias("width")).join(sums, "query_id", "left").join(
        width, "width", "left").select("query_id", F.coalesce("compared", F.lit(0).cast("bigint")).alias("compared"),
                                       F.coalesce("stored", F.lit(0).cast("bigint")).alias("stored"))
    return top_k_per(both, ["query_id"], order, k, rank="rank"), reads

"""Exact cosine nearest neighbours for a batch of queries.

The queries are the stated query set: they travel in broadcast blocks of bounded size, and the stored vectors are read
once where they lie. Each task multiplies block by block and carries one list of the k best per query through all its
batches, so tasks x queries x k rows are shuffled, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from dealweave.operators.rows import top_k_per

#: Bytes of query vectors in one broadcast block, and of similarities computed at once.
BLOCK_BYTES = 4 << 20
PRODUCT_BYTES = 16 << 20
_DIGITS = 9


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector",
                 item_id: str = "id", item_vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar items of every query, ties by id.

    Vectors that are NULL, have no id or no length, hold a NULL or are of another width than the query have no similarity to
    it and never appear. ``exclude_self`` leaves out the item whose id equals the query's id.
    """
    q_type, i_type = queries.schema[query_id].dataType, vectors.schema[item_id].dataType
    schema = T.StructType([
        T.StructField("query_id", q_type), T.StructField("id", i_type), T.StructField("similarity", T.DoubleType())])
    q = queries.filter(F.col(query_vector).isNotNull()).select(
        F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v"))
    items = vectors.filter(F.col(item_vector).isNotNull() & F.col(item_id).isNotNull()).select(
        F.col(item_id).alias("id"), F.col(item_vector).cast("array<double>").alias("v"))
    types = to_arrow_type(q_type), to_arrow_type(i_type)
    best = items.mapInArrow(_search(_query_blocks(q), k, exclude_self, types), schema)
    return top_k_per(best, ["query_id"], [F.col("similarity").desc(), F.col("id")], k, rank="rank")


def _query_blocks(q: DataFrame) -> list:
    """Broadcast blocks (ids, unit vectors), each of queries of one width."""
    context, blocks = q.sparkSession.sparkContext, []
    held: dict[int, tuple[list, list]] = {}

    def ship(width: int) -> None:
        ids, rows = held.pop(width)
        matrix, usable = _unit(np.array(rows, np.float64))
        blocks.append(context.broadcast(([i for i, u in zip(ids, usable) if u], matrix[usable])))

    for row in q.toLocalIterator():
        if not row.v or any(x is None for x in row.v):
            continue
        ids, rows = held.setdefault(len(row.v), ([], []))
        ids.append(row.query_id)
        rows.append(row.v)
        if 8 * len(rows) * len(row.v) >= BLOCK_BYTES:
            ship(len(row.v))
    for width in list(held):
        ship(width)
    return blocks


def _unit(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one, and which rows have a finite length."""
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(norms) & (norms > 0)
    return matrix / np.where(usable, norms, 1)[:, None], usable


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per width: row numbers and unit vectors of the usable rows."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    found = {}
    for width in np.unique(widths[widths > 0]).astype(int).tolist():
        rows = np.flatnonzero(widths == width)
        flat = column.take(pa.array(rows)).flatten()
        matrix, usable = _unit(np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), width))
        found[width] = rows[usable], matrix[usable]
    return found


def _search(blocks: list, k: int, exclude_self: bool, types: tuple):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for width, (rows, matrix) in _matrices(batch.column("v")).items():
                item_ids = [ids[r] for r in rows]
                order = np.array(sorted(range(len(item_ids)), key=item_ids.__getitem__), np.int64)
                item_ids = [item_ids[i] for i in order]
                step = max(1, PRODUCT_BYTES // (8 * max(1, len(item_ids))))
                for b, block in enumerate(blocks):
                    q_ids, q_matrix = block.value
                    if q_matrix.shape[1] != width or not item_ids:
                        continue
                    for start in range(0, len(q_ids), step):
                        similarity = np.round(q_matrix[start:start + step] @ matrix[order].T, _DIGITS)
                        for i, row in enumerate(similarity):
                            own = _best_of(row, item_ids, k, q_ids[start + i] if exclude_self else None)
                            key = (b, start + i)
                            best[key] = sorted(best.get(key, []) + own, key=lambda x: (-x[0], x[1]))[:k]
        out = [(blocks[b].value[0][i], item, score) for (b, i), found in best.items() for score, item in found]
        for start in range(0, len(out), 10_000):
            q, i, s = zip(*out[start:start + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, type=types[0]), pa.array(i, type=types[1]), pa.array(s, type=pa.float64())],
                names=["query_id", "id", "similarity"])

    return search


def _best_of(similarity: np.ndarray, ids: list, k: int, without) -> list[tuple[float, object]]:
    """The k best (similarity, id) of one query, ids in ascending order; all ties of the last place are looked at."""
    wanted = k + (without is not None)
    if wanted < len(similarity):
        least = np.partition(similarity, len(similarity) - wanted)[len(similarity) - wanted]
        at = np.flatnonzero(similarity >= least)
    else:
        at = np.arange(len(similarity))
    at = at[np.argsort(-similarity[at], kind="stable")]
    return [(float(similarity[i]), ids[i]) for i in at.tolist() if without is None or ids[i] != without][:k]

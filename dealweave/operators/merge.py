"""Upserts, guarded pruning and document merges over written tables.

Parquet tables have no in-place update: each function returns the complete new state, to be written as a new
directory and swapped in by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.hashing import UNNAMED, content_hash
from dealweave.operators.rows import first_per_group
from dealweave.session import materialised

DOCUMENT_COLUMNS = ("id", "kind", "title", "body", "metadata", "content_hash", "embedding", "updated_at", "embedded_at")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Target with the batch's rows replacing those of the same key; the first by ``order`` wins within the batch, and
    among equals the first by a hash of the row, so the winner does not depend on partitioning."""
    last = first_per_group(batch, [key], [*order, F.xxhash64(*batch.columns)])
    return target.join(last, key, "left_anti").unionByName(last)


def prune_stale(df: DataFrame, stamp_column: str, stamp, min_ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Drop the rows this run did not see, but only if the run looks whole.

    Whole means: it saw at least one row and at least ``min_ratio`` of the rows now held (old and new together).
    Returns the remaining rows and a one-row report. The guard is a scalar subquery, so the rows are not shuffled.
    """
    fresh = F.col(stamp_column) == F.lit(stamp)
    counts = df.agg(
        F.count(F.lit(1)).alias("held"), F.count_if(fresh).alias("seen"),
        F.count_if(F.col(stamp_column) != F.lit(stamp)).alias("unseen"),
    ).withColumn("pruned", (F.col("seen") > 0) & (F.col("seen") >= F.lit(min_ratio) * F.col("held")))
    allowed = counts.select("pruned").scalar()
    kept = df.filter(fresh | ~allowed | F.col(stamp_column).isNull())
    report = counts.withColumn("removed", F.when(F.col("pruned"), F.col("unseen")).otherwise(F.lit(0))).drop("unseen")
    return kept, report


def apply_patches(df: DataFrame, patches: DataFrame, key: str, fields: Sequence[str], order: str | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """Partial updates: each patch row has ``key`` and a map ``changes`` of field to new text.

    Only fields present in the map change, a blank value clears the field. Several patches of one key are merged field
    by field: the one with the greatest ``order`` that names the field wins (without ``order`` or between equals, the
    greatest text). Returns the new rows and the patches that fit no row.
    """
    at = F.col(order) if order else F.lit(0)
    named = {f: F.coalesce(F.map_contains_key("changes", f), F.lit(False)) for f in fields}
    edits = patches.groupBy(F.col(key).alias("_key")).agg(*[
        F.max(F.when(named[f], F.struct(at.alias("o"), F.element_at("changes", F.lit(f)).alias("v")))).alias(f"_to_{f}")
        for f in fields])
    joined = df.join(edits, F.col(key) == F.col("_key"), "left").withColumns({
        f: F.when(F.col(f"_to_{f}").isNotNull(), F.nullif(F.trim(F.col(f"_to_{f}.v")), F.lit(""))).otherwise(F.col(f))
        for f in fields})
    return joined.select(*df.columns), patches.join(df, key, "left_anti")


def finish_documents(docs: DataFrame) -> DataFrame:
    """Fill the blanks of built documents and add the content hash."""
    return docs.select(
        "id", "kind",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(UNNAMED)).alias("title"),
        F.coalesce("body", F.lit("")).alias("body"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        content_hash("title", "body").alias("content_hash"),
    )


def classify_documents(old: DataFrame, new: DataFrame, protected_kinds: Sequence[str] = ()) -> DataFrame:
    """Old and new documents side by side with ``change``: insert, update, unchanged, delete or protected."""
    o = old.select(F.col("id"), F.struct(*[c for c in old.columns]).alias("o"))
    n = new.select(F.col("id"), F.struct(*[c for c in new.columns]).alias("n"))
    return o.join(n, "id", "full").withColumn("change", _change(protected_kinds))


def _change(protected_kinds: Sequence[str]) -> Column:
    same = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash")) \
        & F.col("o.metadata").eqNullSafe(F.col("n.metadata"))
    return (
        F.when(F.col("o").isNull(), "insert")
        .when(F.col("n").isNull(), F.when(F.col("o.kind").isin(*protected_kinds), "protected").otherwise("delete")
              if protected_kinds else F.lit("delete"))
        .when(same, "unchanged")
        .otherwise("update")
    )


def _alone(df: DataFrame, side: str, others: DataFrame, other_side: str, protected_kinds: Sequence[str]) -> DataFrame:
    """Documents of one side that the other does not have, in the shape of ``classify_documents``."""
    none = F.lit(None).cast(others.select(F.struct(*others.columns).alias("x")).schema["x"].dataType)
    rows = df.select("id", F.struct(*df.columns).alias(side), none.alias(other_side))
    return rows.select("id", "o", "n").withColumn("change", _change(protected_kinds))


def merge_documents(old: DataFrame, new: DataFrame, as_of: Column, protected_kinds: Sequence[str] = (),
                    folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """New document state and change counts.

    An unchanged text keeps its embedding, a changed one loses it; stored documents of a protected kind are never
    deleted. One full outer join decides everything.

    With ``folder`` (and ``new`` a written table) the ids that are on both sides are written there first, and only their
    documents meet; what comes of them and of the old documents is written there, too, and the inserted ones are read
    from ``new``. So where Spark can broadcast the ids, no text of another document is shuffled or written again.
    """
    if folder:
        held = materialised(old.select("id").distinct(), folder)
        both = materialised(new.select("id").join(held, "id", "left_semi").distinct(), folder)
        inserted = _alone(new.join(both, "id", "left_anti"), "n", old, "o", protected_kinds)
        others = classify_documents(old.join(both, "id", "left_semi"), new.join(both, "id", "left_semi"), protected_kinds) \
            .unionByName(_alone(old.join(both, "id", "left_anti"), "o", new, "n", protected_kinds))
        state = _merged(inserted, as_of).unionByName(materialised(_merged(others, as_of), folder))
        return state, _changes(inserted.unionByName(others))
    sides = classify_documents(old, new, protected_kinds)
    return _merged(sides, as_of), _changes(sides)


def _changes(sides: DataFrame) -> DataFrame:
    return sides.groupBy("change").agg(F.count(F.lit(1)).alias("documents"))


def _merged(sides: DataFrame, as_of: Column) -> DataFrame:
    """The documents that classified ones become."""
    same_text = F.col("o.content_hash").eqNullSafe(F.col("n.content_hash"))
    keep_old = F.col("change").isin("unchanged", "protected")

    def pick(column: str) -> Column:
        return F.when(keep_old, F.col(f"o.{column}")).otherwise(F.col(f"n.{column}")).alias(column)

    def carried(column: str) -> Column:
        return F.when(keep_old | same_text, F.col(f"o.{column}")).alias(column)

    return sides.filter(F.col("change") != "delete").select(
        "id", pick("kind"), pick("title"), pick("body"), pick("metadata"), pick("content_hash"), carried("embedding"),
        F.when(keep_old, F.col("o.updated_at")).otherwise(as_of).alias("updated_at"), carried("embedded_at"),
    )


def vector_table(docs: DataFrame) -> DataFrame:
    """The documents that can be searched by vector: id, kind, metadata and embedding."""
    return docs.filter(F.col("embedding").isNotNull()).select("id", "kind", "metadata", "embedding")

"""Entity labels of companies: loading and manual corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.text import blank_to_null
from dealweave.operators.rows import latest_per_key

# Positions of a label row in the loaded JSON, and the statuses a manual edit may set.
LABEL_FIELDS = (
    "name", "entity", "parent_group", "entity_type", "domain", "status", "confidence", "evidence_url", "note", "cluster",
)
EDIT_STATUSES = ("verified", "probable", "not_found", "unresolved")
EDIT_FIELDS = ("entity", "parent_group", "entity_type", "domain", "note")


def load_entities(batches: DataFrame, rows: str = "rows") -> DataFrame:
    """Label rows from a text column holding a JSON list of positional lists."""
    label = F.explode(F.from_json(F.col(rows), "array<array<string>>"))
    cells = [F.get(F.col("_r"), F.lit(i)).alias(field) for i, field in enumerate(LABEL_FIELDS)]
    return batches.select(label.alias("_r")).select(*cells).withColumn("cluster", F.col("cluster").try_cast("int"))


def apply_overrides(entities: DataFrame, edits: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Entities with the last manual edit per name applied, and the rejected edits.

    An edit replaces all label fields and marks the row as manual; a delete removes it. Edits without a name or with
    an unknown status are rejected.
    """
    named = edits.withColumn("name", blank_to_null("name"))
    valid = F.col("name").isNotNull() & (
        (F.col("action") == "delete") | F.coalesce(F.col("status").isin(*EDIT_STATUSES), F.lit(False)))
    last = latest_per_key(named.filter(valid), ["name"], order)
    new = last.select("name", F.struct(
        F.col("action").alias("action"), F.col("status").alias("status"),
        *[blank_to_null(f).alias(f) for f in EDIT_FIELDS]).alias("_e"))
    joined = entities.join(new, "name", "full").filter(
        F.col("_e").isNull() | (F.col("_e.action") != "delete"))
    edited = F.col("_e").isNotNull()
    out = [F.col("name")]
    for column in entities.columns:
        if column in EDIT_FIELDS or column == "status":
            out.append(F.when(edited, F.col(f"_e.{column}")).otherwise(F.col(column)).alias(column))
        elif column in ("confidence", "source"):
            out.append(F.when(edited, F.lit("manual")).otherwise(F.col(column)).alias(column))
        elif column != "name":
            out.append(F.col(column))
    return joined.select(*out), named.filter(~F.coalesce(valid, F.lit(False)))

"""Views over the deal table and its page content."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.order import as_col, newest_known, oldest
from dealweave.functions.text import has_text, holds

# Statuses of a decided deal.
DECIDED = ("Pass", "To be Passed")

# Column lists of the plain projections offered over the source tables.
PROJECTIONS = {
    "sector_master": (
        "deal", "f3_sector_classification", "investor", "status", "created_on", "founder_name", "founder_linkedin",
        "founder_previous_company", "id", "url"),
    "founder_employers": (
        "deal_id", "deal", "status", "meeting_date", "f3_classification", "sectors", "founder_key", "founder",
        "linkedin_url", "company", "title", "via", "has_linkedin", "source", "created_date", "in_raw_data", "entity",
        "parent_group", "entity_status", "entity_domain", "entity_type"),
    "investor_missing": ("investor", "missing_deals", "company_names", "sectors", "id", "url"),
    "out_of_coverage": (
        "name", "meeting_date", "creation_date", "status", "type", "sectors", "f2_classification",
        "f3_classification", "location", "source", "investor_type", "risk_evaluation", "notes", "similar_companies",
        "founder_name", "founder_linkedin", "previous_companies_worked_at", "people", "investors", "own_funds", "id",
        "url"),
    "rounds": (
        "company", "sector", "round_date", "founded_year", "location", "round_name", "round_amount_usd",
        "lead_investor", "round_investors", "pipeline_state", "id", "url"),
}


def raw_data(pipeline: DataFrame, as_of: Column, excluded_creator: str, excluded_source: str,
             statuses: Sequence[str] = DECIDED) -> DataFrame:
    """Decided deals, without those of one creator or one source, plus the days since the first meeting.

    A NULL creator differs from the excluded one, a NULL source list holds nothing: such deals stay.
    """
    kept = (
        F.col("status").isin(*statuses)
        & ~F.col("created_by").eqNullSafe(F.lit(excluded_creator))
        & ~holds("source", excluded_source)
    )
    return pipeline.filter(kept).withColumn("days_since_first_meeting", F.datediff(as_of, "meeting_date"))


def projection(df: DataFrame, view: str) -> DataFrame:
    """Named projection, limited to the columns the table has."""
    return df.select(*[c for c in PROJECTIONS[view] if c in df.columns])


def slim_sorted(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Narrow projection in ascending order, NULLs last."""
    return df.select(*columns).orderBy(*[oldest(c) for c in order])


def row_sum(columns: Sequence[str], kind: str = "decimal(18,2)") -> Column:
    """Sum across columns, NULL counted as zero."""
    return reduce(add, [F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) for c in columns])


def investor_mix_total(mix: DataFrame, buckets: Sequence[str]) -> DataFrame:
    """Investor table with the total over its buckets."""
    return mix.withColumn("total", row_sum(buckets)).orderBy(oldest("company_name"))


def deal_content(content: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Page content with the deal's attributes; the page's own name is used where the deal is gone."""
    deals = pipeline.select(
        F.col("id").alias("page_id"), F.col("deal").alias("_deal"), "status", "sectors", "f3_classification",
        "meeting_date", "url")
    return (
        content.join(deals, "page_id", "left")
        .withColumn("deal", F.coalesce("_deal", "deal"))
        .withColumn("transcript_chars", F.length("transcript"))
        .drop("_deal")
    )


def content_level(transcript: str | Column = "transcript", summary: str | Column = "summary",
                  page_notes: str | Column = "page_notes", meeting_notes: str | Column = "meeting_notes") -> Column:
    """How much of a deal's page is filled; empty text counts as missing."""
    return (
        F.when(has_text(as_col(transcript)), "transcript")
        .when(has_text(as_col(summary)), "summary only")
        .when(has_text(as_col(page_notes)) | has_text(as_col(meeting_notes)), "notes only")
        .otherwise("blank page")
    )


def raw_data_content(raw: DataFrame, content: DataFrame) -> DataFrame:
    """Decided deals with their page content and its level."""
    pages = content.withColumnRenamed("page_id", "id").withColumnRenamed("deal", "content_deal")
    return raw.join(pages, "id", "left").withColumn("transcript_chars", F.length("transcript")) \
        .withColumn("content_level", content_level())


def work_queue(items: DataFrame, fetched: DataFrame, as_of: Column, days: int = 45, n: int = 50,
               stale_hours: int = 20) -> DataFrame:
    """What to fetch next: items never fetched, and recent ones whose copy is old. Newest first, n of each kind."""
    order = [newest_known("created_time"), oldest("id")]
    pages = fetched.select(F.col("page_id").alias("id"), "fetched_at").filter(F.col("id").isNotNull())
    new = items.join(pages, "id", "left_anti").orderBy(*order).limit(n)
    touched = F.greatest(F.col("created_time"), F.col("meeting_date").cast("timestamp"))
    recent = touched > as_of - F.make_dt_interval(F.lit(days))
    stale = F.col("fetched_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(stale_hours))
    refresh = items.join(pages, "id").filter(recent & stale).orderBy(*order).limit(n)
    columns = ["id", "deal", "url"]
    return new.select(*columns, F.lit("new").alias("reason")).unionByName(
        refresh.select(*columns, F.lit("refresh").alias("reason")))

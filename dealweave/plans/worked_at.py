"""Founders who worked at a given employer, from every place that may say so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.order import newest_known, oldest
from dealweave.functions.text import first_name_token
from dealweave.operators.joins import join_first
from dealweave.operators.lists import distinct_join


@dataclass(frozen=True)
class EmployerPatterns:
    """Patterns for one or more employers given as a regular expression alternative, e.g. ``acme|acme labs``."""

    employers: str

    @property
    def name(self) -> str:
        """The employer as a word, also with "pay" appended."""
        return rf"(?i)\b({self.employers})(\b|pay\b)"

    @property
    def title(self) -> str:
        """The employer as a title mentions it: "ex-Acme", "(Acme" or "Acme alum"."""
        e = self.employers
        return rf"(?i)(\bex[- ]?({e})\b|\(\s*(ex[- ]?)?({e})\b|\b({e})\b\s*(alum|alumni)\b)"


# Profile lines of a lead's page that may name an employer.
PROFILE_HEADINGS = ("Headline", "Role", "Background", "Person")

_HIT = ("deal_id", "deal", "status", "meeting_date", "founder", "employer", "role", "linkedin_url", "recorded_in")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def profile_lines(body: str | Column) -> Column:
    """Contents of the headed profile lines of a page, joined by spaces."""
    headed = rf"(?m)^\s*(?:{'|'.join(PROFILE_HEADINGS)})\s*:([^\n]*)"
    text = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    return F.nullif(F.array_join(F.regexp_extract_all(text, F.lit(headed), F.lit(1)), " "), F.lit(""))


def lead_deals(leads: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Leads with the pipeline deal they are linked to by page link, if any."""
    links = leads.select(F.col("id").alias("lead_id"), F.explode("deal_pipeline_mapping").alias("_url"))
    targets = pipeline.filter(F.col("url").isNotNull()).select(F.col("url").alias("_url"), F.col("id").alias("deal_id"))
    linked = links.join(targets, "_url").groupBy("lead_id").agg(F.min("deal_id").alias("deal_id"))
    return leads.withColumnRenamed("id", "lead_id").join(linked, "lead_id", "left")


def evidence(patterns: EmployerPatterns, facts: DataFrame, history: DataFrame, pipeline: DataFrame,
             leads: DataFrame) -> DataFrame:
    """All hits of the five kinds of evidence as equal rows."""
    name, title = patterns.name, patterns.title
    no_text = F.lit(None).cast("string")
    from_facts = facts.filter(
        F.col("company").rlike(name) | F.col("entity").rlike(name) | F.col("parent_group").rlike(name)
    ).select(
        "deal_id", "deal", "status", "meeting_date", "founder", F.coalesce("entity", "company").alias("employer"),
        F.col("title").alias("role"), "linkedin_url",
        F.when(F.col("via") == "linkedin", "Profile").otherwise("Deal fields").alias("recorded_in"))
    deals = pipeline.select(F.col("id").alias("deal_id"), "deal", "status", "meeting_date")
    notes = history.filter(F.col("company").rlike(name))
    from_notes = notes.join(deals, "deal_id").select(
        "deal_id", "deal", "status", "meeting_date", "founder", F.col("company").alias("employer"), "role",
        no_text.alias("linkedin_url"), F.lit("Call notes").alias("recorded_in"))
    before_mention = F.nullif(F.trim(F.regexp_replace("deal", r"(?is)\s*([(,]|\bex[- ]).*\z", "")), F.lit(""))
    from_titles = pipeline.filter(F.col("deal").rlike(title)).select(
        F.col("id").alias("deal_id"), "deal", "status", "meeting_date",
        F.coalesce(F.nullif("founder_name", F.lit("")), before_mention, "deal").alias("founder"),
        _found(F.col("deal"), name).alias("employer"), no_text.alias("role"),
        F.col("founder_linkedin").alias("linkedin_url"), F.lit("Deal title").alias("recorded_in"))
    tracked = lead_deals(leads, pipeline).withColumn("profile", profile_lines("body"))
    d = deals.select("deal_id", F.struct("deal", "status", "meeting_date").alias("d"))
    tracked = tracked.join(d, "deal_id", "left")
    lead_cells = [
        F.coalesce("deal_id", "lead_id").alias("deal_id"), F.coalesce("d.deal", "company_name").alias("deal"),
        F.coalesce(F.col("d.status"), F.concat(F.lit("Lead – "), F.coalesce("status", F.lit("no status")))).alias("status"),
        F.coalesce("d.meeting_date", "created_date").alias("meeting_date"),
    ]
    from_lead_notes = notes.select(F.col("deal_id").alias("lead_id"), "founder", F.col("company").alias("employer"),
                                   "role").join(tracked, "lead_id").select(
        *lead_cells, "founder", "employer", "role", "linkedin_url", F.lit("Lead tracker").alias("recorded_in"))
    bare = F.nullif(F.trim(F.regexp_replace("company_name", r"(?s)\s*\(.*\z", "")), F.lit(""))
    from_leads = tracked.filter(
        F.col("company_name").rlike(title) | F.col("description").rlike(name) | F.col("profile").rlike(name)
    ).select(
        *lead_cells, F.coalesce(bare, "company_name").alias("founder"),
        _found(F.concat_ws(" ", "company_name", "description", "profile"), name).alias("employer"),
        no_text.alias("role"), "linkedin_url", F.lit("Lead tracker").alias("recorded_in"))
    hits = from_facts
    for part in (from_notes, from_titles, from_lead_notes, from_leads):
        hits = hits.unionByName(part)
    return hits.select(*_HIT)


def evidence_groups(hits: DataFrame) -> DataFrame:
    """One row per deal and person; a person is told by the first name without honorific."""
    grouped = hits.groupBy("deal_id", first_name_token("founder").alias("person")).agg(
        F.max("founder").alias("founder"), distinct_join("deal").alias("startup"),
        distinct_join("employer").alias("employer"),
        F.coalesce(distinct_join("role", "; ", F.col("role") != ""), F.lit("Role not recorded")).alias("role"),
        distinct_join("status").alias("status"), F.max("meeting_date").alias("met_on"),
        F.max("linkedin_url").alias("linkedin_url"), distinct_join("recorded_in").alias("recorded_in"))
    return grouped.withColumn("we_met", F.date_format("met_on", "dd MMM yyyy"))


def worked_at(employers: str, facts: DataFrame, history: DataFrame, pipeline: DataFrame, leads: DataFrame,
              decided: DataFrame | None = None) -> DataFrame:
    """Founders who worked at ``employers``, newest meeting first; ``decided`` limits them to those deals."""
    hits = evidence(EmployerPatterns(employers), facts, history, pipeline, leads)
    if decided is not None:
        hits = hits.join(decided.select(F.col("id").alias("deal_id")), "deal_id", "left_semi")
    return evidence_groups(hits).orderBy(newest_known("met_on"), oldest("founder"))


def first_link(leads: DataFrame, pipeline: DataFrame, url: str) -> DataFrame:
    """Leads with the first pipeline deal behind one link column."""
    targets = pipeline.select(F.col("url").alias(url), F.col("id").alias("deal_id"))
    return join_first(leads, targets, url, [oldest("deal_id")])

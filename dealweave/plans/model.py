"""Person, company and investor model rebuilt from the flat snapshot table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealweave.functions.order import oldest
from dealweave.functions.text import company_part, profile_slug, split_parts, title_part
from dealweave.operators.joins import alias_cascade, unpivot_slots
from dealweave.operators.lists import ordered_join, pivot_slots
from dealweave.operators.rows import first_per_group
from dealweave.session import materialised, shared_folder

SLOTS = 4
PROFILE_PREFIX = "https://www.linkedin.com/in/"
SYNTHETIC_PREFIX = "nolink:"


class EmptySourceError(RuntimeError):
    """The snapshot holds no rows, so the model must not be replaced."""


@dataclass(frozen=True)
class Model:
    deals: DataFrame
    founders: DataFrame
    deal_founders: DataFrame
    roles: DataFrame
    companies: DataFrame
    investors: DataFrame
    deal_investors: DataFrame

    def stored(self, folder: str | None = None) -> Model:
        """The same model with its derived tables written once; every later plan then starts from plain scans."""
        derived = ("founders", "deal_founders", "roles", "companies")
        folder = folder or shared_folder(self.deals.sparkSession)
        return replace(self, **{name: materialised(getattr(self, name), folder) for name in derived})

    def counts(self) -> DataFrame:
        """One row per table with its size."""
        parts = [
            df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in vars(self).items()
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def founder_slots(snapshot: DataFrame) -> DataFrame:
    """One row per deal and filled founder slot, with the person's key.

    The key is the handle of the profile link; a person without one gets a key of their own in each deal.
    """
    groups = [
        {"name": f"founder_{i}_name", "link": f"founder_{i}_linkedin",
         "previous": f"founder_{i}_previous_company_worked_at", "designations": f"founder_{i}_designations"}
        for i in range(1, SLOTS + 1)
    ]
    used = [column for group in groups for column in group.values()]
    slots = unpivot_slots(snapshot.select("id", *used), groups, keep=("name", "link"))
    deal_id = F.replace("id", F.lit("-"), F.lit(""))
    own = F.concat(F.lit(SYNTHETIC_PREFIX), F.col("deal_id"), F.lit(":"), F.col("slot").cast("string"))
    return slots.withColumn("deal_id", deal_id).withColumn("founder_key", F.coalesce(profile_slug("link"), own)).drop("id")


def rebuild_model(snapshot: DataFrame, companies: DataFrame, founders: DataFrame | None = None,
                  investors: DataFrame | None = None, check: bool = True) -> Model:
    """All seven tables from the snapshot.

    ``companies`` (name, aliases) keeps its entries and gains the unknown employers; ``founders`` are the ones held
    before, whose names survive when the snapshot has none; ``investors`` already known stay in the list.
    """
    if check and snapshot.isEmpty():
        raise EmptySourceError("the snapshot table is empty")
    slots = founder_slots(snapshot)
    deals = snapshot.select(
        F.replace("id", F.lit("-"), F.lit("")).alias("id"), F.col("deal").alias("name"), "status",
        F.coalesce("sectors", F.array().cast("array<string>")).alias("sectors"), "f3_classification",
        F.coalesce("source", F.array().cast("array<string>")).alias("source"), "meeting_date",
        F.col("source_created_time").alias("source_created_at"), F.col("url").alias("source_link"))
    people = first_per_group(
        slots, ["founder_key"], [F.col("name").isNull(), oldest("deal_id"), oldest("slot")]
    ).select(
        F.col("founder_key").alias("key"), "name",
        F.when(~F.col("founder_key").startswith(SYNTHETIC_PREFIX), F.concat(F.lit(PROFILE_PREFIX), "founder_key"))
        .alias("linkedin_url"))
    if founders is not None:
        held = founders.select("key", F.col("name").alias("_held"))
        people = people.join(held, "key", "left").withColumn("name", F.coalesce("name", "_held")).drop("_held")
    deal_founders = slots.select("deal_id", "slot", "founder_key", F.col("previous").alias("previous_company_raw"))
    roles, new_companies = career_roles(slots, companies)
    all_companies = companies.select("name", "aliases").unionByName(
        new_companies.select("name", F.array().cast("array<string>").alias("aliases")))
    backed = snapshot.select(
        F.replace("id", F.lit("-"), F.lit("")).alias("deal_id"),
        F.explode(split_parts("institutional_funding", r"\s*[,;]\s*")).alias("investor")).distinct()
    names = backed.select(F.col("investor").alias("name"))
    if investors is not None:
        names = names.unionByName(investors.select("name"))
    return Model(deals, people, deal_founders, roles, all_companies, names.distinct(), backed)


def career_roles(slots: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Career entries of the people with a profile link, and the employers not known before."""
    entries = (
        slots.filter(~F.col("founder_key").startswith(SYNTHETIC_PREFIX))
        .select("founder_key", F.explode(split_parts("designations", r";\s*")).alias("raw")).distinct()
        .withColumn("title", title_part("raw")).withColumn("employer", company_part("raw"))
    )
    resolved, new = alias_cascade(entries, "employer", companies)
    return resolved.select("founder_key", "company", "title", "raw"), new


def snapshot_view(model: Model) -> DataFrame:
    """One row per model deal with its founders in numbered columns and as ordered texts."""
    roles = model.roles.groupBy("founder_key").agg(ordered_join("raw", ["raw"], "; ").alias("designations"))
    people = (
        model.deal_founders.join(model.founders.withColumnRenamed("key", "founder_key"), "founder_key")
        .join(roles, "founder_key", "left")
    )
    fields = {"founder_name": "name", "founder_linkedin": "linkedin_url",
              "founder_previous": "previous_company_raw", "founder_designations": "designations"}
    wide = pivot_slots(people, ["deal_id"], "slot", fields)
    texts = people.groupBy("deal_id").agg(
        ordered_join("name", ["slot"]).alias("founder_names"),
        ordered_join("linkedin_url", ["slot"]).alias("founder_linkedins"))
    funding = model.deal_investors.groupBy("deal_id").agg(
        ordered_join("investor", ["investor"]).alias("institutional_funding"))
    joined = model.deals.withColumnRenamed("id", "deal_id").join(wide, "deal_id", "left") \
        .join(texts, "deal_id", "left").join(funding, "deal_id", "left")
    return joined.orderBy(oldest("source_created_at"), oldest("deal_id"))

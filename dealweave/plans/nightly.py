"""The nightly refresh: model, employer facts, documents, merge and report, in this order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.operators.merge import finish_documents, merge_documents, vector_table
from dealweave.plans.companies import sector_patterns
from dealweave.plans.documents import LEARNED_KINDS, DocumentTables, build_documents
from dealweave.plans.employers import employer_facts, founder_career
from dealweave.plans.model import Model, rebuild_model
from dealweave.plans.universe import startup_universe
from dealweave.session import materialised, shared_folder

SNAPSHOT_SOURCE = "snapshot"
RECENT_HOURS = 3


@dataclass(frozen=True)
class SourceTables:
    pipeline: DataFrame
    decided: DataFrame
    content: DataFrame
    snapshot: DataFrame
    companies: DataFrame
    entities: DataFrame
    rounds: DataFrame
    investor_missing: DataFrame
    out_of_coverage: DataFrame
    sector_master: DataFrame
    investor_mix: DataFrame
    leads: DataFrame
    history: DataFrame
    documents: DataFrame


@dataclass(frozen=True)
class Refreshed:
    ok: bool
    documents: DataFrame | None
    vectors: DataFrame | None
    changes: DataFrame | None
    note: str


def snapshot_is_fresh(runs: DataFrame, as_of: Column, hours: int = RECENT_HOURS) -> bool:
    """Did the snapshot source load successfully in the last hours?"""
    recent = F.col("started_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return not runs.filter((F.col("source") == SNAPSHOT_SOURCE) & F.col("ok") & recent).isEmpty()


def refresh(tables: SourceTables, model: Model | None, runs: DataFrame, as_of: Column,
            folder: str | None = None) -> Refreshed:
    """Rebuild everything derived. A failure is reported, not raised, so the old state stays in use.

    The model is rebuilt only after a fresh snapshot load; otherwise the given ``model`` is used. Tables read several
    times (pipeline, facts, universe) are written once and read back, which also bounds the plans.
    """
    spark = tables.pipeline.sparkSession
    folder = folder or shared_folder(spark)
    try:
        rebuilt = model is None or snapshot_is_fresh(runs, as_of)
        current = model
        if rebuilt:
            held = (model.founders, model.investors) if model else (None, None)
            current = rebuild_model(tables.snapshot, tables.companies, *held).stored(folder)
        pipeline = materialised(tables.pipeline, folder)
        facts = materialised(
            employer_facts(pipeline, current, tables.decided, tables.entities), folder)
        universe = materialised(
            startup_universe(pipeline, current.deals, tables.rounds, tables.out_of_coverage,
                             tables.sector_master, tables.investor_missing), folder)
        career = founder_career(current.founders, current.roles, facts)
        built = build_documents(DocumentTables(
            pipeline, tables.decided, tables.content, current, facts, career, universe, sector_patterns(facts),
            tables.rounds, tables.investor_missing, tables.out_of_coverage, tables.sector_master, tables.investor_mix,
            tables.leads, tables.history))
        new = materialised(finish_documents(built), folder)
        documents, changes = merge_documents(tables.documents, new, as_of, LEARNED_KINDS, folder)
        note = "documents rebuilt" + (" + snapshot model" if rebuilt else "")
        return Refreshed(True, documents, vector_table(documents), changes, note)
    except Exception as error:  # the run log keeps the reason; the caller keeps the old tables
        return Refreshed(False, None, None, None, str(error))

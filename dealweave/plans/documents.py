"""Every record as a searchable document: (id, kind, title, body, metadata).

A body is a list of "Label: value" lines; lines without a value are left out. Metadata is JSON without absent fields.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealweave.functions.json import compact_json
from dealweave.functions.order import newest, oldest
from dealweave.functions.text import joined, labelled_lines, name_key
from dealweave.operators.chunks import chunk_documents
from dealweave.operators.lists import PART_ITEMS, breakdown_text, distinct_array, list_parts, ordered_join
from dealweave.operators.rows import first_per_group
from dealweave.plans.employers import UNRESOLVED
from dealweave.session import materialised

COLUMNS = ("id", "kind", "title", "body", "metadata")

# Kinds of documents that people add and that a rebuild never deletes.
LEARNED_KINDS = ("insight", "answer_example")

# Part lengths of page texts, and lengths of the excerpts shown inside other documents.
SUMMARY_SIZE, NOTES_SIZE, TRANSCRIPT_SIZE = 1600, 1600, 1800


@dataclass(frozen=True)
class DocumentTables:
    """Inputs of the document build; ``facts`` and ``career`` are the employer tables, ``universe`` all companies."""

    pipeline: DataFrame
    decided: DataFrame
    content: DataFrame
    model: object
    facts: DataFrame
    career: DataFrame
    universe: DataFrame
    patterns: DataFrame
    rounds: DataFrame
    investor_missing: DataFrame
    out_of_coverage: DataFrame
    sector_master: DataFrame
    investor_mix: DataFrame
    leads: DataFrame
    history: DataFrame


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _document(df: DataFrame, prefix: str, key: str | Column, kind: str | Column, title: Column, body: Column,
              metadata: Column) -> DataFrame:
    return df.select(
        F.concat(F.lit(prefix), _text(key)).alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        title.alias("title"), body.alias("body"), metadata.alias("metadata"))


def _tail(label: str, value: Column) -> Column:
    """``label`` plus value, or nothing."""
    return F.coalesce(F.concat(F.lit(label), value), F.lit(""))


def _part_id(key: str | Column) -> Column:
    """Id of a record's document; the second and later parts of an oversized one are numbered."""
    part = F.coalesce("part", F.lit(0))
    return F.concat(_text(key), F.when(part > 0, F.concat(F.lit("#"), _text(part))).otherwise(""))


def founder_texts(model, career: DataFrame, compat_fanout: bool = False) -> DataFrame:
    """Per model deal the founders with their careers as text, and all their employers.

    ``compat_fanout`` repeats a founder once per employer, as the source system does.
    """
    people = (
        model.deal_founders.join(model.founders.select(F.col("key").alias("founder_key"), "name"), "founder_key")
        .join(career.select("founder_key", "career", "companies"), "founder_key", "left")
    )
    told = F.coalesce(
        F.concat(F.lit(" — career: "), "career"), F.concat(F.lit(" — previously: "), "previous_company_raw"), F.lit(""))
    lines = people.withColumn("_line", F.concat("name", told))
    if compat_fanout:
        lines = lines.withColumn("_copy", F.explode_outer("companies"))
    texts = lines.groupBy("deal_id").agg(ordered_join("_line", ["slot"], "\n  ").alias("founders_text"))
    alumni = people.select("deal_id", F.explode("companies").alias("_c")).distinct().groupBy(
        F.col("deal_id").alias("_d")).agg(distinct_array("_c").alias("alumni_of"))
    return texts.join(alumni, F.col("deal_id") == F.col("_d"), "left").drop("_d")


def model_records(model, career: DataFrame, compat_fanout: bool = False) -> DataFrame:
    texts = founder_texts(model, career, compat_fanout).withColumnRenamed("deal_id", "id")
    return model.deals.join(texts, "id", "left").withColumn("key", name_key("name"))


def _funding(universe: DataFrame) -> DataFrame:
    return universe.select(
        "key", F.struct("rounds", "last_round", "last_round_date", "total_raised_usd", "investors", "missed_by",
                        "pipeline_status", "decision_to_pass_stage").alias("u"))


def _later_funding(with_amount: bool, with_date: bool = True) -> Column:
    parts = [F.col("u.last_round")]
    if with_date:
        parts.append(_tail(" on ", _text("u.last_round_date")))
    if with_amount:
        parts.append(_tail(", total raised USD ", _text("u.total_raised_usd")))
    parts.append(_tail(", investors: ", F.array_join("u.investors", ", ")))
    return F.concat(*parts)


def deal_documents(t: DocumentTables, records: DataFrame) -> DataFrame:
    """One document per pipeline deal, with excerpts, careers, later funding and who missed it."""
    first = first_per_group(records.filter(F.col("key").isNotNull()), ["key"], [oldest("id")])
    m = first.select("key", F.struct("id", "f3_classification", "sectors", "founders_text", "alumni_of").alias("m"))
    content = t.content.select(
        F.col("page_id").alias("id"),
        F.struct("summary", "meeting_notes", "page_notes", "transcript", "meetings").alias("ct"))
    decided = t.decided.select("id").distinct().withColumn("_decided", F.lit(True))
    # By id first, where the deals may lie already, then by key once.
    p = (
        t.pipeline.filter(F.col("deal").isNotNull()).join(content, "id", "left").join(decided, "id", "left")
        .withColumn("key", name_key("deal")).join(m, "key", "left").join(_funding(t.universe), "key", "left")
    )
    sectors = F.coalesce("sectors", "m.sectors")
    f3 = F.coalesce("f3_classification", "m.f3_classification")
    notes = F.nullif(F.concat_ws("\n", "ct.meeting_notes", "ct.page_notes"), F.lit(""))
    body = labelled_lines(
        ("Startup: ", F.col("deal")), ("Status: ", F.col("status")),
        ("Pass stage: ", F.col("decision_to_pass_stage")), ("Pass type: ", joined("pass_type")),
        ("Founder pass vectors: ", joined("founder_pass_vectors")),
        ("F2 classification: ", F.col("f2_classification")), ("F3 classification: ", f3),
        ("Sectors: ", joined(sectors)), ("Type: ", F.col("type")), ("Location: ", F.col("location")),
        ("Source: ", joined("source")), ("Met on: ", _text("meeting_date")),
        ("Added: ", _text(F.to_date("created_time"))), ("What they do: ", F.col("description")),
        ("Call summary: ", F.col("ct.summary")),
        ("Partner notes: ", notes),
        ("Why passed / comments: ", F.col("comments")), ("What stood out: ", F.col("what_stood_out")),
        ("What to check: ", F.col("what_to_check")), ("Risk evaluation: ", F.col("risk_evaluation")),
        ("1-year view: ", F.col("view_1y")), ("3-year view: ", F.col("view_3y")),
        ("5-year view: ", F.col("view_5y")), ("10-year view: ", F.col("view_10y")),
        ("Similar companies: ", F.col("similar_companies")), ("Antiportfolio: ", F.col("antiportfolio")),
        ("Re-pipeline reason: ", F.col("re_pipeline_reason")), ("Founder: ", F.col("founder_name")),
        ("Founder previous companies: ",
         F.coalesce("previous_company_worked_at", "previous_company", "last_company_worked")),
        ("Founders and careers:\n  ", F.col("m.founders_text")),
        ("Later funding: ", _later_funding(with_amount=True)), ("Missed by investors: ", joined("u.missed_by")))
    metadata = compact_json(
        name=F.col("deal"), key=F.col("key"), status=F.col("status"), sectors=sectors, f3=f3,
        pass_stage=F.col("decision_to_pass_stage"), meeting_date=_text("meeting_date"),
        created=_text(F.to_date("created_time")), in_raw_data=F.coalesce("_decided", F.lit(False)),
        pipeline_id=F.col("id"), model_deal_id=F.col("m.id"), alumni_of=F.col("m.alumni_of"),
        raised_later=F.coalesce(F.col("u.rounds") > 0, F.lit(False)), url=F.col("url"),
        has_call_summary=F.col("ct.summary").isNotNull(), has_transcript=F.col("ct.transcript").isNotNull(),
        meetings=F.col("ct.meetings"))
    return _document(p, "deal:", "id", "deal", F.col("deal"), body, metadata)


def model_only_documents(t: DocumentTables, records: DataFrame) -> DataFrame:
    """Model deals no pipeline deal is named like."""
    named = t.pipeline.select(name_key("deal").alias("key")).filter(F.col("key").isNotNull()).distinct()
    m = records.join(named, "key", "left_anti").join(_funding(t.universe), "key", "left")
    body = labelled_lines(
        ("Startup: ", F.col("name")), ("Status: ", F.col("status")), ("F3 classification: ", F.col("f3_classification")),
        ("Sectors: ", joined("sectors")), ("Source: ", joined("source")), ("Met on: ", _text("meeting_date")),
        ("Added: ", _text(F.to_date("source_created_at"))), ("Founders and careers:\n  ", F.col("founders_text")),
        ("Later funding: ", _later_funding(with_amount=False)), ("Missed by investors: ", joined("u.missed_by")))
    metadata = compact_json(
        name=F.col("name"), key=F.col("key"), status=F.col("status"), sectors=F.col("sectors"),
        f3=F.col("f3_classification"), meeting_date=_text("meeting_date"),
        created=_text(F.to_date("source_created_at")), model_deal_id=F.col("id"), alumni_of=F.col("alumni_of"),
        raised_later=F.coalesce(F.col("u.rounds") > 0, F.lit(False)), url=F.col("source_link"))
    return _document(m, "deal:", "id", "deal", F.col("name"), body, metadata)


def content_documents(content: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Call summaries, partner notes and transcripts, cut into numbered parts."""
    deals = pipeline.select(
        F.col("id").alias("page_id"), F.col("deal").alias("_deal"), "status", "sectors", "f3_classification",
        "meeting_date", "url", name_key("deal").alias("key"))
    notes = F.nullif(F.concat_ws("\n", "meeting_notes", "page_notes"), F.lit(""))
    texts = F.array(*[
        F.struct(F.lit(prefix).alias("prefix"), F.lit(kind).alias("kind"), F.lit(label).alias("label"),
                 text.alias("text"), F.lit(size).alias("size"))
        for prefix, kind, label, text, size in (
            ("sum:", "call_summary", "Call summary", F.col("summary"), SUMMARY_SIZE),
            ("note:", "call_notes", "Partner notes", notes, NOTES_SIZE),
            ("tx:", "transcript", "Call transcript", F.col("transcript"), TRANSCRIPT_SIZE))])
    pages = content.select("page_id", "deal", F.explode(texts).alias("t")).filter(F.col("t.text").isNotNull())
    pages = pages.select("page_id", "deal", "t.*", F.struct("page_id", "deal", "t.prefix", "t.kind", "t.label").alias("page"))
    parts = chunk_documents(pages, "page", "text", "size").select("page.*", "part", "chunk", "parts")
    p = parts.join(deals, "page_id", "left").withColumn("_name", F.coalesce("_deal", "deal"))
    head = F.concat(
        F.lit("Startup: "), "_name", _tail(" | Status: ", F.col("status")), _tail(" | Sectors: ", joined("sectors")),
        _tail(" | Met on: ", _text("meeting_date")))
    many = F.when(F.col("parts") > 1, F.concat(
        F.lit(" (part "), _text("part"), F.lit(" of "), _text("parts"), F.lit(")"))).otherwise("")
    metadata = compact_json(
        name=F.col("_name"), key=F.col("key"), pipeline_id=F.col("page_id"), status=F.col("status"),
        sectors=F.col("sectors"), f3=F.col("f3_classification"), meeting_date=_text("meeting_date"),
        part=F.col("part"), parts=F.col("parts"), url=F.col("url"))
    return _document(
        p, "", F.concat("prefix", "page_id", F.lit(":"), _text("part")), F.col("kind"),
        F.concat("_name", F.lit(" — "), "label", many),
        F.concat_ws("\n", head, F.concat("label", F.lit(":")), "chunk"), metadata)


def founder_documents(model, career: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """One profile per founder: deals pitched, career, employers. A founder with an oversized deal list gets several
    documents, numbered from the second on."""
    d = model.deals.select(
        F.col("id").alias("deal_id"), F.col("name").alias("deal"), "status", "sectors", "f3_classification")
    pitched = model.deal_founders.select("founder_key", "deal_id").join(d, "deal_id").withColumn(
        "_entry", F.concat(
            "deal", F.lit(" ("), F.coalesce("status", F.lit("no status")), _tail(", ", joined("sectors")),
            _tail(", F3 ", F.col("f3_classification")), F.lit(")")))
    texts = list_parts(pitched, ["founder_key"], "_entry", "pitched", "; ", part_items)
    names = pitched.select("founder_key", "deal").distinct().groupBy("founder_key").agg(distinct_array("deal").alias("deals"))
    facets = pitched.select("founder_key", "status").distinct().groupBy("founder_key").agg(
        distinct_array("status").alias("statuses"))
    sectors = pitched.select(F.col("founder_key").alias("_f"), F.explode("sectors").alias("_s")).distinct().groupBy(
        "_f").agg(distinct_array("_s").alias("sectors"))
    f = (
        career.join(texts, "founder_key").join(names, "founder_key", "left").join(facets, "founder_key", "left")
        .join(sectors, F.col("founder_key") == F.col("_f"), "left")
    )
    body = labelled_lines(
        ("Founder: ", F.col("name")), ("LinkedIn: ", F.col("linkedin_url")), ("Startups pitched to us: ", F.col("pitched")),
        ("Career history: ", F.col("career")), ("Alumni of: ", joined("companies")))
    metadata = compact_json(
        name=F.col("name"), linkedin=F.col("linkedin_url"), companies=F.col("companies"),
        deals=F.col("deals"), sectors=F.col("sectors"), statuses=F.col("statuses"))
    return _document(f, "founder:", _part_id("founder_key"), "founder", F.col("name"), body, metadata)


def alumni_documents(patterns: DataFrame, facts: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """Employers with at least two founders: the sectors they build in, outcomes and startups."""
    known = facts.filter(F.col("entity_status") != UNRESOLVED).select(
        F.col("entity").alias("company"), "founder_key", "deal_id", "status")
    founders = known.select("company", "founder_key").distinct().groupBy("company").agg(
        F.count("founder_key").alias("founders"))
    deals = known.groupBy("company", "deal_id").agg(
        F.bool_or(F.col("status") == "Pass").alias("_p"), F.bool_or(F.col("status") == "To be Passed").alias("_t")
    ).groupBy("company").agg(
        F.count("deal_id").alias("startups"), F.count_if("_p").alias("passed"), F.count_if("_t").alias("waiting"))
    sectors = patterns.select("company", "sector", F.col("startups").alias("_n")).distinct()
    texts = breakdown_text(sectors, ["company"], "sector", "_n", "sector_text", "%s (%d)")
    shares = sectors.groupBy("company").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sector", "_n")))).alias("sector_map"))
    started = facts.filter(F.col("entity_status") != UNRESOLVED).select(F.col("entity").alias("company"), "deal")
    names = list_parts(started, ["company"], "deal", "names", part_items=part_items)
    a = founders.filter(F.col("founders") >= 2).join(deals, "company").join(texts, "company") \
        .join(shares, "company").join(names, "company", "left")
    body = F.concat(
        F.lit("Former employees of "), "company", F.lit(" who founded startups that pitched to us: "),
        _text("founders"), F.lit(" founders, "), _text("startups"), F.lit(" startups.\nSectors they build in: "),
        "sector_text", F.lit("\nOutcomes: "), _text("passed"), F.lit(" passed, "), _text("waiting"),
        F.lit(" to be passed.\nStartups: "), F.coalesce("names", F.lit("")))
    metadata = compact_json(
        company=F.col("company"), founders=F.col("founders"), startups=F.col("startups"), sectors=F.col("sector_map"))
    return _document(a, "alumni:", _part_id(F.md5("company")), "alumni_pattern", F.concat("company", F.lit(" alumni")), body, metadata)


def round_documents(rounds: DataFrame, records: DataFrame, missing_like: str = "missing%") -> DataFrame:
    """Funding rounds, with what our own records say about the company.

    ``records`` is the universe, or ``plans.universe.pipeline_records``: key, pipeline_status, decision_to_pass_stage.
    Each company is normalised and looked up once, however many rounds it had. What was found is written, so that Spark
    knows its size and the rounds need not be shuffled to a few companies.
    """
    companies = rounds.select("company").distinct().withColumn("key", name_key("company"))
    told = records.select("key", F.struct("pipeline_status", "decision_to_pass_stage").alias("u"))
    r = rounds.join(materialised(companies.join(told, "key", "left")), "company", "left")
    off_radar = F.coalesce(F.col("pipeline_state").ilike(missing_like), F.lit(False))
    radar = F.concat(
        F.coalesce("pipeline_state", F.lit("unknown")),
        F.when(off_radar, " — this company never came onto our radar (missed deal).")
        .otherwise(" — this company was on our radar."))
    body = labelled_lines(
        ("Company: ", F.concat(
            "company", F.lit(" raised a "), F.coalesce("round_name", F.lit("funding")), F.lit(" round"),
            _tail(" on ", _text("round_date")), _tail(" of USD ", _text("round_amount_usd")), F.lit("."))),
        ("Sector: ", joined("sector")), ("Location: ", joined("location")),
        ("Founded: ", _text(F.col("founded_year").cast("int"))), ("Lead investor: ", joined("lead_investor")),
        ("All investors (funds and angels): ", joined("round_investors")), ("Our radar: ", radar),
        ("Our pipeline record: ",
         F.concat("u.pipeline_status", _tail(" at ", F.col("u.decision_to_pass_stage")))))
    metadata = compact_json(
        company=F.col("company"), key=F.col("key"), round=F.col("round_name"), date=_text("round_date"),
        amount_usd=F.col("round_amount_usd"), sector=F.col("sector"), lead=F.col("lead_investor"),
        investors=F.col("round_investors"), pipeline_state=F.col("pipeline_state"), on_radar=~off_radar,
        url=F.col("url"))
    return _document(
        r, "round:", "id", "funding_round",
        F.concat("company", F.lit(" — "), F.coalesce("round_name", F.lit("round"))), body, metadata)


def missed_documents(investor_missing: DataFrame) -> DataFrame:
    """Investors with the companies of theirs that were missed."""
    m = investor_missing.filter(F.col("investor").isNotNull())
    count = F.coalesce(_text(F.col("missing_deals").cast("int")), F.lit("?"))
    body = labelled_lines(
        ("Investor: ", F.col("investor")),
        ("In the last year this investor backed ", F.concat(count, F.lit(" companies that we missed (never on our radar)."))),
        ("Missed companies: ", F.col("company_names")), ("Sectors: ", joined("sectors")))
    metadata = compact_json(
        investor=F.col("investor"), missing_deals=F.col("missing_deals"), sectors=F.col("sectors"), url=F.col("url"))
    return _document(m, "missed:", "id", "investor_missed", F.concat("investor", F.lit(" — deals we missed")), body, metadata)


def out_of_coverage_documents(out_of_coverage: DataFrame, universe: DataFrame) -> DataFrame:
    """Companies that were funded without ever being seen."""
    o = out_of_coverage.filter(F.col("name").isNotNull()).withColumn("key", name_key("name")) \
        .join(_funding(universe), "key", "left")
    body = labelled_lines(
        ("Startup: ", F.concat("name", F.lit(" — funded, but never came onto our radar (out of coverage)."))),
        ("Status: ", F.col("status")), ("Type: ", F.col("type")), ("Investor type: ", F.col("investor_type")),
        ("F2 classification: ", F.col("f2_classification")), ("F3 classification: ", F.col("f3_classification")),
        ("Sectors: ", joined("sectors")), ("Location: ", F.col("location")), ("Source: ", joined("source")),
        ("Notes: ", F.col("notes")), ("Risk evaluation: ", F.col("risk_evaluation")),
        ("Similar companies: ", F.col("similar_companies")), ("Founder: ", F.col("founder_name")),
        ("Founder previous companies: ", F.col("previous_companies_worked_at")),
        ("Later funding: ", _later_funding(with_amount=False, with_date=False)))
    metadata = compact_json(
        name=F.col("name"), key=F.col("key"), sectors=F.col("sectors"), f3=F.col("f3_classification"),
        created=_text(F.to_date("creation_date")), url=F.col("url"))
    return _document(o, "ooc:", "id", "out_of_coverage", F.col("name"), body, metadata)


def sector_master_documents(sector_master: DataFrame) -> DataFrame:
    s = sector_master.filter(F.col("deal").isNotNull())
    body = labelled_lines(
        ("Startup: ", F.col("deal")), ("Status: ", F.col("status")),
        ("F3 sector classification: ", F.col("f3_sector_classification")), ("Investors: ", joined("investor")),
        ("Founder: ", F.col("founder_name")), ("Founder previous company: ", F.col("founder_previous_company")),
        ("Added: ", _text("created_on")))
    metadata = compact_json(
        name=F.col("deal"), key=name_key("deal"), status=F.col("status"), f3=F.col("f3_sector_classification"),
        investors=F.col("investor"), created=_text("created_on"), url=F.col("url"))
    return _document(s, "f3:", "id", "f3_master", F.col("deal"), body, metadata)


# The eight classification buckets of the investor table, with their names in texts.
BUCKETS = {
    "ai_software_and_infra": "AI software & infra",
    "b2b_and_manufacturing": "B2B & manufacturing",
    "india_consumption_1": "India consumption 1",
    "india_consumption_2_3": "India consumption 2/3",
    "fintech_and_fs": "Fintech & FS",
    "deeptech": "Deeptech",
    "healthcare": "Healthcare",
    "other": "Other",
}


def investor_mix_documents(investor_mix: DataFrame) -> DataFrame:
    """Investors with their deal count per bucket, as a sentence."""
    b = investor_mix.filter(F.col("company_name").isNotNull())
    counts = F.concat_ws(", ", *[
        F.concat(F.lit(f"{label} "), F.coalesce(_text(column), F.lit("0"))) for column, label in BUCKETS.items()])
    body = F.concat(F.lit("Investor "), "company_name", F.lit(" deal count by F3 bucket: "), counts, F.lit("."))
    metadata = compact_json(investor=F.col("company_name"), url=F.col("url"))
    return _document(
        b, "f3inv:", "id", "investor_f3_breakup", F.concat("company_name", F.lit(" — F3 mix")), body, metadata)


def lead_documents(leads: DataFrame, history: DataFrame, part_items: int = PART_ITEMS) -> DataFrame:
    """Tracked leads with what the notes say about the founders; an oversized history goes into several documents."""
    entry = F.concat("founder", F.lit(" — "), "company", F.coalesce(F.concat(F.lit(" ("), "role", F.lit(")")), F.lit("")))
    told = list_parts(
        history.select(F.col("deal_id").alias("id"), entry.alias("_e")), ["id"], "_e", "_history", "; ", part_items)
    item = leads.filter(F.col("company_name").isNotNull()).join(told, "id", "left")
    body = labelled_lines(
        ("Lead: ", F.col("company_name")), ("Lead status: ", F.col("status")), ("Priority: ", F.col("priority")),
        ("Source: ", F.col("source")), ("Location: ", F.col("location")), ("Industry: ", joined("industry")),
        ("Added: ", _text("created_date")), ("Description: ", F.col("description")), ("Next action: ", F.col("next_action")),
        ("LinkedIn: ", F.col("linkedin_url")), ("Founder background (from notes): ", F.col("_history")),
        ("Page notes: ", F.col("body")))
    metadata = compact_json(
        name=F.col("company_name"), key=name_key("company_name"),
        status=F.concat(F.lit("Lead – "), F.coalesce("status", F.lit("no status"))), lead_status=F.col("status"),
        created=_text("created_date"), linkedin=F.col("linkedin_url"), pipeline_links=F.col("deal_pipeline_mapping"),
        url=F.col("url"))
    return _document(item, "lead:", _part_id("id"), "lead", F.col("company_name"), body, metadata)


def build_documents(t: DocumentTables) -> DataFrame:
    """All documents of the eleven builders."""
    records = model_records(t.model, t.career)
    parts = [
        deal_documents(t, records), model_only_documents(t, records), content_documents(t.content, t.pipeline),
        founder_documents(t.model, t.career), alumni_documents(t.patterns, t.facts),
        round_documents(t.rounds, t.universe), missed_documents(t.investor_missing),
        out_of_coverage_documents(t.out_of_coverage, t.universe), sector_master_documents(t.sector_master),
        investor_mix_documents(t.investor_mix), lead_documents(t.leads, t.history),
    ]
    return reduce(DataFrame.unionByName, parts)


def memory_documents(insights: DataFrame, feedback: DataFrame) -> DataFrame:
    """Saved insights and upvoted answers as documents; inactive ones are left out."""
    saved = _text(F.to_date("created_at"))
    insight = _document(
        insights.filter(F.col("active") & F.col("title").isNotNull()), "insight:", "id", "insight", F.col("title"),
        F.concat_ws(
            "\n", F.concat(F.lit("Team insight (saved "), saved, F.lit("): "), "title"), F.col("insight"),
            F.concat(F.lit("Evidence: "), "evidence"), F.concat(F.lit("Original question: "), "question")),
        compact_json(insight_id=F.col("id"), saved=saved))
    example = _document(
        feedback.filter((F.col("rating") == 1) & F.col("question").isNotNull()), "example:", "id", "answer_example",
        F.col("question"),
        F.concat_ws(
            "\n", F.concat(F.lit("Question the team asked: "), "question"),
            F.concat(F.lit("Answer the team marked as good ("), saved, F.lit("): "), F.col("answer")),
            F.concat(F.lit("How it was answered (query): "), F.col("sql"))),
        compact_json(feedback_id=F.col("id"), rated=saved))
    return insight.unionByName(example)


def newest_rules(rules: DataFrame, n: int | None = None) -> DataFrame:
    """The n newest active rules (all without n), to be shown oldest first."""
    active = rules.filter("active")
    return active if n is None else active.orderBy(newest("created_at"), newest("id")).limit(n)

import dataclasses
import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dealweave.plans import companies as co
from dealweave.plans import documents as docs
from dealweave.plans.deals import content_level, raw_data, row_sum, work_queue
from dealweave.plans.employers import employer_facts, founder_career, founder_facts
from dealweave.plans.model import EmptySourceError, rebuild_model, snapshot_view
from dealweave.plans.nightly import refresh
from dealweave.plans.universe import pipeline_records, round_totals
from dealweave.plans.worked_at import EmployerPatterns, profile_lines
from tests.test_rows_and_joins import rows

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def test_raw_data_null_rules(spark):
    df = spark.createDataFrame(
        [(1, "Pass", None, None), (2, "Pass", "bot", None), (3, "To be Passed", "me", ["Mail"]), (4, "Open", "me", None), (5, "Pass", "me", ["x"])],
        "id int, status string, created_by string, source array<string>").withColumn("meeting_date", F.lit("2024-01-31").cast("date"))
    got = raw_data(df, now().cast("date"), "bot", "Mail")
    assert rows(got.select("id", "days_since_first_meeting")) == [(1, 1), (5, 1)]


def test_content_level_and_row_sum(values):
    rows_ = [("t", "s", "n", "m"), ("", "s", "n", None), (None, "", "n", ""), (None, None, "", None)]
    assert values(rows_, "transcript string, summary string, page_notes string, meeting_notes string", content_level()) == [
        "transcript", "summary only", "notes only", "blank page"]
    assert values([(1.25, None)], "a double, b double", row_sum(["a", "b"])) == [Decimal("1.25")]


def test_work_queue(spark):
    def at(text):
        return dt.datetime.fromisoformat(text) if text else None

    items = spark.createDataFrame(
        [("a", at("2024-01-30"), None), ("b", None, None), ("c", at("2024-01-20"), None), ("d", at("2023-01-01"), dt.date(2024, 1, 25)), ("e", at("2023-01-01"), None)],
        "id string, created_time timestamp, meeting_date date").withColumn("deal", F.col("id")).withColumn("url", F.col("id"))
    fetched = spark.createDataFrame([("c", at("2024-01-31T03:00:00")), ("d", at("2024-01-31T05:00:00")), ("e", at("2020-01-01"))], "page_id string, fetched_at timestamp")
    assert rows(work_queue(items, fetched, now()).select("id", "reason")) == [("a", "new"), ("b", "new"), ("c", "refresh")]
    assert rows(work_queue(items, fetched, now(), n=1).select("id", "reason")) == [("a", "new"), ("c", "refresh")]


def snapshot(spark):
    base = {"url": "u", "status": "Pass", "f3_classification": None, "sectors": None, "source": None, "meeting_date": None, "source_created_time": None,
            "institutional_funding": "F1, F2;F1 ; "}
    items = []
    for deal, slots in (("d-1", [(" Ann ", "https://linkedin.com/in/ANN?x", "Acme, beta", "CTO - Acme Inc; CTO - Acme Inc;VP - R&D - New"), ("Bo", None, None, "CEO - Zed")]),
                        ("d-2", [(None, "linkedin.com/in/ann/", None, "Lead - ACME"), (None, None, "x", None), (" ", "", "y", None), ("Cy", "linkedin.com/in/cy", None, None)])):
        row = dict(base, id=deal, deal=deal.upper())
        for i in range(4):
            values = slots[i] if i < len(slots) else (None,) * 4
            for field, value in zip(("name", "linkedin", "previous_company_worked_at", "designations"), values):
                row[f"founder_{i + 1}_{field}"] = value
        items.append(row)
    schema = ("id string, deal string, url string, status string, f3_classification string, sectors array<string>, source array<string>, meeting_date date, "
              "source_created_time timestamp, institutional_funding string, " + ", ".join(
                  f"founder_{i}_{f} string" for i in range(1, 5) for f in ("name", "linkedin", "previous_company_worked_at", "designations")))
    return spark.createDataFrame(items, schema)


def companies(spark):
    return spark.createDataFrame([("Acme", ["Acme Inc"])], "name string, aliases array<string>")


def test_model(spark):
    held = spark.createDataFrame([("cy", "Old Cy")], "key string, name string")
    model = rebuild_model(snapshot(spark), companies(spark), held)
    assert rows(model.founders) == [
        ("ann", "Ann", "https://www.linkedin.com/in/ann"), ("cy", "Cy", "https://www.linkedin.com/in/cy"), ("nolink:d1:2", "Bo", None)]
    assert rows(model.deal_founders.select("deal_id", "slot", "founder_key")) == [
        ("d1", 1, "ann"), ("d1", 2, "nolink:d1:2"), ("d2", 1, "ann"), ("d2", 4, "cy")]
    assert rows(model.roles) == [
        ("ann", "Acme", "CTO", "CTO - Acme Inc"), ("ann", "Acme", "Lead", "Lead - ACME"), ("ann", "New", "VP - R&D", "VP - R&D - New")]
    assert {r.name for r in model.companies.collect()} == {"Acme", "New"}
    assert rows(model.investors) == [("F1",), ("F2",)] and model.deal_investors.count() == 4
    assert model.deals.filter("size(sectors) = 0").count() == 2
    assert {r.table: r.n for r in model.counts().collect()}["founders"] == 3
    wide = {r.deal_id: r for r in snapshot_view(model).collect()}
    assert wide["d1"].founder_names == "Ann, Bo" and wide["d2"].founder_name_4 == "Cy" and wide["d1"].institutional_funding == "F1, F2"
    with pytest.raises(EmptySourceError):
        rebuild_model(snapshot(spark).limit(0), companies(spark))


def test_employer_facts_both_versions(spark):
    model = rebuild_model(snapshot(spark), companies(spark))
    pipeline = spark.createDataFrame(
        [("p1", "D-1 Ltd", "Pass", dt.date(2024, 1, 1), "beta, labs; Acme", None, "Ann", ""), ("p2", None, "Pass", None, "ghost", None, None, None)],
        "id string, deal string, status string, meeting_date date, previous_company_worked_at string, previous_company string, founder_name string, founder_linkedin string") \
        .withColumn("f3_classification", F.lit("F")).withColumn("sectors", F.lit(None).cast("array<string>")).withColumn("created_time", now())
    entities = spark.createDataFrame([("beta", "Beta", None, "unresolved")], "name string, entity string, parent_group string, status string") \
        .withColumn("domain", F.lit(None).cast("string")).withColumn("entity_type", F.lit(None).cast("string"))
    decided = pipeline.select("id").filter("id = 'p1'")
    v2 = {(r.deal_id, r.company): r for r in employer_facts(pipeline, model, decided, entities).collect()}
    assert v2[("p1", "Acme")].via == "linkedin" and v2[("p1", "Acme")].title == "CTO" and v2[("p1", "Acme")].in_raw_data is True
    assert v2[("p1", "beta")].via == "founder_field" and v2[("p1", "beta")].entity == "Beta" and v2[("p1", "beta")].entity_status == "unresolved"
    assert ("p1", "labs") in v2 and not any(c == "ghost" for _, c in v2)
    assert v2[("d2", "Acme")].source == "snapshot" and v2[("d2", "Acme")].in_raw_data is None and v2[("d2", "Acme")].deal == "D-2"
    v1 = {(r.deal_id, r.company): r for r in employer_facts(pipeline, model, decided, entities, "name").collect()}
    assert v1[("d2", "Acme")].in_raw_data is False
    career = {r.founder_key: r for r in founder_career(model.founders, model.roles, employer_facts(pipeline, model, decided, entities)).collect()}
    assert career["ann"].career == "CTO at Acme; Lead at Acme; VP - R&D at New" and career["cy"].companies == [] and career["cy"].career is None


def test_mentions_are_dealt_by_deal_once(spark):
    """Attributes and flags come to the mentions by deal; rows without a model deal do not meet in one task."""
    model = rebuild_model(snapshot(spark), companies(spark))
    text = F.lit(None).cast("string")
    pipeline = spark.createDataFrame([("p1", "D-1 Ltd", "beta"), ("p1", "D-1 Ltd", "beta"), ("p3", "Z", "Acme, beta")],
                                     "id string, deal string, previous_company_worked_at string").select(
        "*", F.lit("Pass").alias("status"), F.lit(None).cast("date").alias("meeting_date"), text.alias("previous_company"),
        text.alias("founder_name"), text.alias("founder_linkedin"), text.alias("f3_classification"),
        F.lit(None).cast("array<string>").alias("sectors"), now().alias("created_time"))
    entities = spark.createDataFrame([("beta", "Beta", None, None, None, None)], "name string, entity string, parent_group string, status string, domain string, entity_type string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for dedupe in ("entity", "name"):
            facts = employer_facts(pipeline, model, pipeline.select("id"), entities, dedupe)
            assert "hashpartitioning(pipeline_id" not in facts._jdf.queryExecution().executedPlan().toString()
            got = [(r.deal_id, r.company, r.in_raw_data) for r in facts.collect() if r.source == "pipeline" and r.company == "beta"]
            assert sorted(got) == [("p1", "beta", True)] * 2 + [("p3", "beta", True)]  # a deal's row that comes twice
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_careers_leave_the_deals_own_fields_alone(spark):
    """The founders' facts give the same careers as all facts; of deal fields only those of a founder's key are read."""
    model = rebuild_model(snapshot(spark), companies(spark))
    text = F.lit(None).cast("string")
    pipeline = spark.createDataFrame(
        [("p1", "D-1 Ltd", "beta, labs; Acme"), ("p1", "D-1 Ltd", "more"), ("p3", "Z", "Acme, beta"), (None, "D-2", "beta"), ("p4", None, "ghost")],
        "id string, deal string, previous_company_worked_at string").select(
        "*", F.lit("Pass").alias("status"), F.lit(None).cast("date").alias("meeting_date"), text.alias("previous_company"),
        text.alias("founder_name"), text.alias("founder_linkedin"), text.alias("f3_classification"),
        F.lit(None).cast("array<string>").alias("sectors"), now().alias("created_time"))
    entities = spark.createDataFrame([("beta", "Beta", None, "unresolved", None, None), ("Acme", "ACME", None, None, None, None)],
                                     "name string, entity string, parent_group string, status string, domain string, entity_type string")
    odd = spark.createDataFrame([("deal:p3", "Odd", None), ("deal:p4", "Ghost", None), (None, "No key", None)], model.founders.schema)
    for founders in (model.founders, model.founders.unionByName(odd)):
        m = dataclasses.replace(model, founders=founders)
        facts, few = employer_facts(pipeline, m, pipeline.select("id"), entities), founder_facts(pipeline, m, entities)
        assert rows(founder_career(m.founders, m.roles, few)) == rows(founder_career(m.founders, m.roles, facts))
        own = {r.founder_key for r in few.filter("startswith(founder_key, 'deal:')").collect()}
        assert own == ({"deal:p3"} if founders is not model.founders else set())


def rounds(spark):
    data = [("r1", "Acme", "Seed", "Missing", "2020-01-01", "10", ["A", "B"], ["A"]), ("r2", "Acme", None, "Missing", "2021-01-01", None, None, []),
            ("r3", "Bolt", "Series A", "Pass", None, "30", ["A"], ["A"]), ("r4", "Bolt", "Seed", "Late", None, "5", ["X, Y"], None),
            ("r5", "Cove", "Seed", None, None, "1", None, None)]
    return spark.createDataFrame(
        [(i, c, n, s, dt.date.fromisoformat(d) if d else None, Decimal(a) if a else None, inv, lead, ["FinTech"], ["Mumbai"], 2015) for i, c, n, s, d, a, inv, lead in data],
        "id string, company string, round_name string, pipeline_state string, round_date date, round_amount_usd decimal(18,2), round_investors array<string>, "
        "lead_investor array<string>, sector array<string>, location array<string>, founded_year int")


def people(spark):
    return spark.createDataFrame([("Acme", True, [("N", "CEO"), ("M", None)], [], None, True, None), ("Bolt", False, None, None, None, None, None)],
                                 "company string, found boolean, founders array<struct<name:string,designation:string>>, prev_companies array<string>, colleges array<string>, "
                                 "serial_founder boolean, prior_funded_founder boolean")


def test_company_rounds(spark):
    got = {r.company: r for r in co.company_rounds(rounds(spark), people(spark)).collect()}
    a, b, c = got["Acme"], got["Bolt"], got["Cove"]
    assert (a.rounds, a.total_raised_usd, a.latest_round, a.age_at_latest_round, a.investor_count, a.missed) == (2, Decimal("10.00"), None, 6, 2, True)
    assert a.founders == "N (CEO); M" and a.founder_data == "On record" and a.founder_previous_companies == "Not recorded"
    assert (b.our_status, b.latest_round, b.latest_round_date, b.all_investors, b.founder_data) == ("Seen and passed", "Seed", None, "A, X, Y", "Not available")
    assert c.our_status == "Unknown" and c.missed is None and c.investor_count == 0 and c.founder_data == "Not looked up yet"
    split = {r.company: r.investor_list for r in co.investor_texts_as_list(co.company_rounds(rounds(spark), people(spark))).collect()}
    assert split["Bolt"] == ["A", "X", "Y"]


def test_segment_compare(spark):
    table = co.company_rounds(rounds(spark), people(spark))
    got = {(r.segment, r.ord): r for r in co.segment_compare(table).collect()}
    assert len(got) == 26
    assert got[("Fintech", 1)].missed == 1 and got[("Fintech", 1)].key_difference is False
    assert got[("All sectors", 13)].seen is None and got[("All sectors", 13)].reading == "Not enough data to compare."
    assert got[("All sectors", 12)].missed == 100 and got[("All sectors", 12)].seen == 0 and got[("All sectors", 12)].key_difference is True
    assert "%" in got[("All sectors", 12)].reading and "%" not in got[("All sectors", 11)].reading
    missed = {(r.segment, r.investor): (r.missed_companies, r.also_backed_seen) for r in co.missed_investors(table).collect()}
    assert missed == {("Fintech", "A"): (1, True), ("Fintech", "B"): (1, False)}
    assert {(r.investor, r.part, r.companies) for r in co.missed_names(table).collect()} == {("A", 0, "Acme"), ("B", 0, "Acme")}


def test_round_fanout_flag(spark):
    def total(**options):
        return {r.key: (r.rounds, r.total_raised_usd) for r in round_totals(rounds(spark), **options).collect()}

    assert total()["acme"] == (2, Decimal("10.00"))
    assert total(compat_fanout=True)["acme"] == (4, Decimal("30.00"))


def test_company_list_parts(spark):
    mentions = spark.createDataFrame(
        [(f"d{i}", f"Deal {i}", "Pass" if i % 2 else "To be Passed", None if i < 3 else "NA" if i < 5 else "Deck Scan", None, "Acme", s) for i in range(40) for s in ("acme", "ACME")],
        "id string, deal string, status string, decision_to_pass_stage string, f3_classification string, company string, spelling string")
    one = co.company_list(mentions).first()
    assert (one.deals, one.passed, one.stage_deck_scan, one.stage_not_set) == (40, 20, 35, 5)
    assert one.pass_stages == "Deck Scan 35, Not set 5" and one.f3_split == "Unclassified 40"
    assert rows(co.company_names(mentions).filter("kind = 'spelling'")) == [("Acme", "spelling", 0, "ACME, acme")]
    many = co.company_names(mentions, part_items=10).filter("kind = 'deal'").collect()
    assert sorted(r.part for r in many) == [0, 1, 2, 3] and {len(r.names.split(", ")) for r in many} == {10}
    assert len({n for r in many for n in r.names.split(", ")}) == 40


def test_sector_patterns_count_by_what_is_shown(spark):
    """Founders and deals of an employer and sector count once; founders that nobody reads are not counted."""
    facts = spark.createDataFrame(
        [("verified", "Acme", "A", "f1", "d1", "Pass", ["X", "Y"]), ("verified", "Acme Ltd", "A", "f1", "d1", None, ["X"]),
         (None, "x", "A", "f9", "d9", "Pass", ["X"]), ("unchecked", "Acme", "A", "f2", "d2", "To be Passed", None), ("verified", "Self", "A", "f3", "d3", "Pass", ["X"]),
         ("verified", "b", None, "f4", "d4", "Pass", ["X"]), ("verified", "c", "C", None, None, "Pass", [None, "Z"])],
        "entity_status string, company string, entity string, founder_key string, deal_id string, status string, sectors array<string>")
    got = co.sector_patterns(facts)
    assert rows(got) == [("A", "Unclassified", 1, 1, 0, 1), ("A", "X", 1, 1, 1, 0), ("A", "Y", 1, 1, 1, 0), ("C", "Z", 0, 0, 1, 0)]
    plan = got.select("company", "sector", "startups")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_worked_at_patterns(values):
    p = EmployerPatterns("groove|acme labs")
    texts = [("ex-Groove",), ("Ann (ex Groove)",), ("Groovepay",), ("Groover",), ("at Groove now",), ("GROOVE alumni",)]
    assert values(texts, "t string", F.col("t").rlike(p.name)) == [True, True, True, False, True, True]
    assert values(texts, "t string", F.col("t").rlike(p.title)) == [True, True, False, False, False, True]
    body = "Headline: VP at X\nother: no\n  Role : Dev\nBackground:"
    assert values([(body,), (None,)], "b string", profile_lines("b")) == [" VP at X  Dev ", None]


def test_failed_refresh_is_reported(spark):
    class Broken:
        pipeline = spark.range(1)

    result = refresh(Broken(), None, spark.createDataFrame([], "source string, ok boolean, started_at timestamp"), now(), "/tmp/unused")
    assert not result.ok and result.documents is None and result.note


def test_round_documents_look_up_each_company_once(spark):
    deals = spark.createDataFrame(
        [("d1", "ACME Inc", "Pass", "Deck Scan", "2020-01-01"), ("d2", "Acme", "Open", None, "2021-01-01"), ("d3", None, "Lost", None, None)],
        "id string, deal string, status string, decision_to_pass_stage string, created_time string").selectExpr(
        "*", "cast(null as string) as f3_classification", "array('s') as sectors", "cast(null as date) as meeting_date")
    records = pipeline_records(deals)
    assert rows(records.select("key", "pipeline_id", "pipeline_status")) == [("acme", "d2", "Open")]
    given = rounds(spark).withColumn("url", F.lit("u")).withColumn("company", F.when(F.col("id") != "r5", F.col("company")))
    given = given.unionByName(given.filter("id = 'r1'").withColumn("company", F.lit("acme ltd")))
    made = docs.round_documents(given, records)
    bodies = sorted((r.id, r.body.split("\n")[0].split(" raised")[0], (r.body.split("Our pipeline record: ") + [None])[1]) for r in made.collect())
    assert [b for b in bodies if b[0] != "round:r5"] == [
        ("round:r1", "Company: Acme", "Open"), ("round:r1", "Company: acme ltd", "Open"), ("round:r2", "Company: Acme", "Open"),
        ("round:r3", "Company: Bolt", None), ("round:r4", "Company: Bolt", None)]
    assert len(bodies) == 6
    # the rounds stay where they lie: only companies and records are shuffled
    assert "SortMergeJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_company_rounds_read_the_rounds_twice(spark):
    day = dt.date(2020, 1, 1)
    schema = rounds(spark).schema
    more = [("r6", None, "Seed", None, None, Decimal("2"), ["A"], None, None, None, None), ("r7", None, "Late", "Pass", None, None, [None, " "], ["L"], [], ["M"], 2001),
            ("r8", "Dusk", "One", "Late", day, Decimal("3"), ["B", "A"], ["L"], ["FinTech", None], ["M"], 2010),
            ("r9", "Dusk", "Two", "Missing", day, None, ["A"], ["L"], None, ["M"], 2011), ("r9", "Dusk", "Two", "Missing", day, None, ["A"], ["L"], None, ["M"], 2011),
            ("r99", "Dusk", None, None, None, Decimal("4"), None, ["K"], None, None, None)]
    given = rounds(spark).unionByName(spark.createDataFrame(more, schema)).repartition(3)
    made = co.company_rounds(given, people(spark))
    got = {r.company: r for r in made.collect()}
    figures = ("our_status", "sectors", "location", "founded_year", "rounds", "total_raised_usd", "latest_round", "latest_round_date", "latest_round_usd",
               "lead_investors", "investor_list")
    assert [got["Dusk"][f] for f in figures] == [
        "Missed (never in our pipeline)", "FinTech", "M", 2011, 4, Decimal("7.00"), "Two", day, None, "K, L", ["A", "B"]]
    # companies without a name are a group without lists, as a null key joins nothing
    assert [got[None][f] for f in figures] == ["Seen and passed", None, None, 2001, 2, Decimal("2.00"), "Late", None, None, None, None]
    assert got["Bolt"].latest_round == "Seed" and got["Bolt"].latest_round_usd == 5 and got["Acme"].latest_round is None
    assert made.schema["total_raised_usd"].dataType.simpleString() == "decimal(28,2)"
    # once for the latest rounds and once for the investors, the rest comes from written counts
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Repartition 3") == 2

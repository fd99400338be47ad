"""Counts, texts, pivots and comparisons per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import dt, query
from dealweave.catalog.rowsets import DECIDED_CHECK, decided
from dealweave.operators.lists import (
    breakdown, distinct_array, distinct_join, latest_by, list_parts, ordered_join, pivot_slots, shortest)
from dealweave.plans.companies import (
    METRICS, company_deals, company_list, company_mentions, company_names, company_rounds, missed_investors, missed_names,
    segment_compare)
from dealweave.plans.employers import employer_names
from dealweave.plans.worked_at import evidence_groups
from dealweave.session import materialised


@query("filtered_counts", """
    select o_custkey, count(*) as orders, count(*) filter (where o_orderstatus = 'F') as closed,
      count(distinct o_orderpriority) filter (where o_orderstatus <> 'F') as open_priorities,
      count(nullif(o_orderpriority, '4-NOT SPECIFIED')) as specified from orders group by o_custkey""")
def filtered_counts(t):
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(status == "F").alias("closed"),
        F.count_distinct(F.when(status != "F", F.col("o_orderpriority"))).alias("open_priorities"),
        F.count(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))).alias("specified"))


@query("pivot_slots", """
    with p as (select l_orderkey, l_linenumber as slot, max(p_name) as name from lineitem join part on p_partkey = l_partkey
      group by 1, 2)
    select l_orderkey, max(name) filter (where slot = 1) as name_1, max(name) filter (where slot = 2) as name_2,
      max(name) filter (where slot = 3) as name_3, max(name) filter (where slot = 4) as name_4,
      string_agg(name, ', ' order by slot) as names from p group by l_orderkey""")
def pivot_slots_query(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).groupBy(
        "l_orderkey", F.col("l_linenumber").alias("slot")).agg(F.max("p_name").alias("name"))
    wide = pivot_slots(rows, ["l_orderkey"], "slot", {"name": "name"})
    return wide.join(rows.groupBy("l_orderkey").agg(ordered_join("name", ["slot"]).alias("names")), "l_orderkey")


@query("ordered_string_agg", """
    select l_orderkey, string_agg(nullif(l_returnflag, 'N') || l_partkey::varchar, '; ' order by l_linenumber, l_partkey, l_suppkey)
      as lines from lineitem group by l_orderkey""")
def ordered_string_agg(t):
    rows = t.lineitem.withColumn(
        "v", F.concat(F.nullif("l_returnflag", F.lit("N")), F.col("l_partkey").cast("string")))
    return rows.groupBy("l_orderkey").agg(
        ordered_join("v", ["l_linenumber", "l_partkey", "l_suppkey"], "; ").alias("lines"))


@query("distinct_string_agg", """
    select c_nationkey, string_agg(distinct nullif(c_mktsegment, 'MACHINERY'), ', ' order by nullif(c_mktsegment, 'MACHINERY')) as segments,
      0 as part, (select string_agg(distinct c2.c_name, ', ' order by c2.c_name) from customer c2 where c2.c_nationkey = customer.c_nationkey) as names
    from customer group by c_nationkey""")
def distinct_string_agg(t):
    small = t.customer.groupBy("c_nationkey").agg(
        distinct_join(F.nullif("c_mktsegment", F.lit("MACHINERY"))).alias("segments"))
    return small.join(list_parts(t.customer, ["c_nationkey"], "c_name", "names"), "c_nationkey")


@query("distinct_array_agg", """
    select o_custkey, array_to_string(coalesce(list_sort(list(distinct o_orderpriority) filter (where o_orderstatus = 'F')), []), ', ') as closed,
      array_to_string(list_sort(list(distinct o_orderstatus)), ', ') as statuses from orders group by o_custkey""")
def distinct_array_agg(t):
    return t.orders.groupBy("o_custkey").agg(
        distinct_array("o_orderpriority", F.col("o_orderstatus") == "F").alias("closed"),
        distinct_array("o_orderstatus").alias("statuses"))


@query("latest_value", """
    select company, (array_agg(round_name order by round_date desc nulls last, id desc))[1] as latest_round,
      (array_agg(round_amount_usd order by round_date desc nulls last, id desc))[1]::double as latest_amount,
      (array_agg(url order by length(url), url))[1] as shortest_url from rounds group by company""")
def latest_value(t):
    return t.rounds.groupBy("company").agg(
        latest_by("round_name", "round_date", "id").alias("latest_round"),
        latest_by("round_amount_usd", "round_date", "id").alias("latest_amount"), shortest("url").alias("shortest_url"))


@query("breakdown_text", """
    with c as (select c_nationkey, o_orderpriority, count(distinct o_orderkey) as n from orders join customer on c_custkey = o_custkey group by 1, 2)
    select c_nationkey, string_agg(o_orderpriority || ' ' || n::varchar, ', ' order by n desc, o_orderpriority) as split from c group by 1""")
def breakdown_text_query(t):
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return breakdown(rows, ["c_nationkey"], "o_orderpriority", "o_orderkey", "split")


# --- previous companies ----------------------------------------------------------------------------------------

def entity_names(t):
    return employer_names(t.entities.select(F.col("name").alias("company"), "entity", F.col("status").alias("entity_status")))


def mentions(t):
    return company_mentions(decided(t, t.deals_full), entity_names(t))


_MENTIONS = f"""
    with r as (select * from deals_full where {DECIDED_CHECK}),
    s as (select r.*, trim(x.c) as spelling from r, unnest(string_split(previous_company_worked_at, ',')) as x(c) where trim(x.c) <> ''),
    n as (select lower(trim(name)) as k, entity, row_number() over (partition by lower(trim(name)) order by (status = 'verified') desc, entity) as i
      from entities where entity is not null and status in ('verified', 'probable', 'unchecked')),
    m as (select s.*, coalesce(n.entity, s.spelling) as company from s left join n on n.k = lower(s.spelling) and n.i = 1)"""


@query("company_list", _MENTIONS + """,
    p as (select company, id, any_value(status) as status, any_value(f3_classification) as f3,
      any_value(decision_to_pass_stage) as stage from m group by company, id),
    cell as (select company, status, f3, stage, count(*) as n from p group by all),
    part as (select company, 'stage' as side, case when stage is null or stage = 'NA' then 'Not set' else stage end as name, sum(n) as n from cell group by all
      union all select company, 'f3', coalesce(f3, 'Unclassified'), sum(n) from cell group by all),
    told as (select company, side, string_agg(concat(name, ' ', n), ', ' order by n desc, name) as text from part group by all),
    sums as (select company, sum(n) as deals, map_from_entries(list((stage, k) order by stage)) as by_stage from (
      select company, coalesce(stage, 'NA') as stage, sum(n) as n, sum(n) as k from cell group by all) group by company),
    state as (select company, sum(if(status = 'Pass', n, 0)) as passed, sum(if(status = 'To be Passed', n, 0)) as waiting from cell group by company)
    select company, deals, passed, waiting as to_be_passed, coalesce(by_stage['Deck Scan'], 0) as stage_deck_scan,
      coalesce(by_stage['First Call'], 0) as stage_first_call, coalesce(by_stage['First Call + Data'], 0) as stage_first_call_data,
      coalesce(by_stage['Multiple Calls'], 0) as stage_multiple_calls,
      coalesce(by_stage['Diligence'], 0) + coalesce(by_stage['Lot of Thinking'], 0) + coalesce(by_stage['Calls across time period'], 0)
        + coalesce(by_stage['Transaction'], 0) as stage_diligence_or_later,
      coalesce(by_stage['NA'], 0) as stage_not_set, s.text as pass_stages, f.text as f3_split
    from sums join state using (company) join (from told where side = 'stage') s using (company) join (from told where side = 'f3') f using (company)""")
def company_list_query(t):
    return company_list(mentions(t))


@query("company_names", _MENTIONS + """,
    x as (select distinct company, kind, name from (select company, 'deal' as kind, deal as name from m union all select company, 'spelling', spelling from m)
      where name is not null),
    z as (select *, (row_number() over (partition by company, kind order by md5(name)) - 1) // 10000 as part from x)
    select company, kind, part, string_agg(name, ', ' order by name) as names from z group by company, kind, part""")
def company_names_query(t):
    return company_names(mentions(t))


@query("company_deals", _MENTIONS + f"""
    select distinct company, deal, id as deal_id, status, coalesce(nullif(decision_to_pass_stage, 'NA'), 'Not set') as pass_stage,
      f3_classification, {dt('meeting_date')} as meeting_date, {dt('created_time')} as created_date, url from m""")
def company_deals_query(t):
    return company_deals(mentions(t))


# --- funding rounds --------------------------------------------------------------------------------------------

def people_of(t):
    """Founder data with the nested shape of its source."""
    person = F.struct(F.col("person").alias("name"), "designation")
    none = F.array().cast("array<string>")
    return t.company_people.select(
        "company", "found", F.when(F.col("person").isNotNull(), F.array(person, person)).alias("founders"),
        F.when(F.col("previous").isNotNull(), F.array("previous")).otherwise(none).alias("prev_companies"),
        none.alias("colleges"), "serial_founder", F.lit(None).cast("boolean").alias("prior_funded_founder"))


def companies_of(t):
    return company_rounds(t.rounds, people_of(t))


def stored_companies(t):
    """The companies as a written table: the comparisons below read them several times."""
    return materialised(companies_of(t))


ROUNDS_CHECK = """
    item as (select distinct company, kind, v from (
        select company, kind, unnest(vs) as v from (
          select company, unnest(['sector', 'place', 'lead', 'any']) as kind, unnest([sector, location, lead_investor, round_investors]) as vs from rounds))
      where trim(v) <> ''),
    held as (select company, map_from_entries(list((kind, vs))) as lists from (
        select company, kind, list(v order by v) as vs from item group by all) group by company),
    newest as (from rounds select company, round_name, round_amount_usd
      qualify row_number() over (partition by company order by round_date is null, round_date desc, id desc) = 1),
    plain as (select company, count(*) as rounds, sum(round_amount_usd) as total, max(round_date) as last_day, max(founded_year) as founded_year,
      max(pipeline_state) as state from rounds group by company),
    co as (select company, case state when 'Missing' then 'Missed (never in our pipeline)' when 'Late' then 'Seen late'
        else if(state ilike '%pass%', 'Seen and passed', ifnull(state, 'Unknown')) end as our_status, state = 'Missing' as missed,
      ifnull(list_has_any(lists['sector'], ['FinTech', 'Financial Services']), false) as is_fintech,
      array_to_string(lists['sector'], ', ') as sectors, array_to_string(lists['place'], ', ') as location, founded_year,
      year(last_day) - founded_year as age_at_latest_round, rounds, total as total_raised_usd, newest.round_name as latest_round,
      last_day as latest_date, newest.round_amount_usd as latest_usd, array_to_string(lists['lead'], ', ') as lead_investors,
      array_to_string(lists['any'], ', ') as all_investors, ifnull(len(lists['any']), 0) as investor_count, lists['any'] as investor_list,
      serial_founder, if(who.company is null, 'Not looked up yet', if(found, 'On record', 'Not available')) as founder_data,
      repeat(person || ifnull(' (' || designation || ')', '') || '; ', 2)[:-3] as founders,
      ifnull(previous, if(found, 'Not recorded', null)) as founder_previous_companies
    from plain join newest using (company) left join held using (company) left join company_people who using (company))"""


@query("company_rounds", "with " + ROUNDS_CHECK.strip() + f"""
    select company, our_status, missed::varchar as missed, is_fintech, sectors, location, founded_year::bigint as founded_year, age_at_latest_round::bigint as age_at_latest_round,
      rounds, total_raised_usd::double as total_raised_usd, latest_round, {dt('latest_date')} as latest_round_date, latest_usd::double as latest_round_usd,
      lead_investors, all_investors, investor_count::bigint as investor_count, founder_data, founders, founder_previous_companies,
      serial_founder::varchar as serial_founder, array_to_string(investor_list, ', ') as investor_list, null::varchar as founder_colleges,
      null::varchar as prior_funded_founder from co, (select 1 from rounds limit 1), (select 1 from company_people limit 1)""")
def company_rounds_query(t):
    flags = ("missed", "serial_founder", "prior_funded_founder")
    return companies_of(t).withColumns({c: F.col(c).cast("string") for c in flags})


_FIGURES = "with " + ROUNDS_CHECK.strip() + """,
    backer as (select unnest(investor_list) as i, company, missed, our_status from co),
    shared as (select distinct b.company from backer b join backer s on s.i = b.i and s.company <> b.company and not s.missed),
    judged as (select co.*, if(missed, 'Missed', 'Seen') as side, company in (from shared) as known,
        unnest(if(is_fintech, ['Fintech', 'All sectors'], ['All sectors'])) as segment
      from co where missed or our_status = 'Seen and passed'),
    x as (select segment, side, unnest(range(1, 14)) as ord, unnest([1, total_raised_usd / 1e6, latest_usd / 1e6,
        if(latest_round ilike 'series a%', 100, 0), if(latest_round ilike '%seed%', 100, 0), age_at_latest_round,
        if(location ilike '%bengaluru%' or location ilike '%bangalore%', 100, 0), if(location ilike '%mumbai%', 100, 0),
        if(regexp_matches(location, '(?i)delhi|gurugram|gurgaon|noida'), 100, 0),
        if(not regexp_matches(location, '(?i)bengaluru|bangalore|mumbai|delhi|gurugram|gurgaon|noida'), 100, 0),
        investor_count, if(known, 100, 0), 100 * serial_founder::int]::double[]) as v from judged),
    places as (select unnest(range(1, 14)) as ord, unnest([0, 2, 2, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0]) as digits, unnest($names) as metric),
    figure as (select segment, side, ord, case ord when 1 then count(*) when 3 then quantile_cont(v, 0.5) else avg(v) end as v from x group by segment, side, ord),
    pair as (select segment, ord, metric, digits, ends_with(metric, '(%)') as points,
        max(if(side = 'Missed', round(v, digits), null)) as missed, max(if(side = 'Seen', round(v, digits), null)) as seen
      from figure join places using (ord) group by all),
    told as (select *, ord > 1 and ifnull(if(points, abs(missed - seen) >= 8,
          round(abs(missed - seen), 4) >= round(greatest(abs(seen), 0.01) / 4, 4)), false) as key_difference,
        list_transform([missed, seen], lambda n: if(n is null, '', concat(if(digits = 0, n::bigint::varchar,
          if(digits = 1, n::decimal(24,1)::varchar, n::decimal(24,2)::varchar)), if(points, '%', '')))) as shown from pair)"""
_FIGURES = _FIGURES.replace("$names", str(list(METRICS)))


@query("segment_metrics", _FIGURES + """
    select segment, ord, metric, missed, seen, round(missed - seen, 2) as difference, key_difference,
      case when ord = 1 then concat('Never seen: ', shown[1], '; seen and passed: ', shown[2], '.')
        when missed is null or seen is null then 'Not enough data to compare.'
        else concat(regexp_replace(metric, ' \\(.*\\)$', ''), ': ', shown[1], ' for missed and ', shown[2], ' for seen companies',
          if(key_difference, ', a key difference.', ', about the same.')) end as reading
    from told, (select 1 from rounds limit 1), (select 1 from company_people limit 1)""")
def segment_metrics(t):
    return segment_compare(stored_companies(t))


_MISSED_NAMES = "with " + ROUNDS_CHECK.strip() + """,
    x as (select distinct if(is_fintech, 'Fintech', 'Other') as segment, unnest(investor_list) as investor, company from co where missed)"""


@query("missed_investors", _MISSED_NAMES + """,
    s as (select distinct unnest(investor_list) as investor from co where not missed)
    select segment, investor, count(*) as missed_companies, investor in (from s) as also_backed_seen
    from x, (select 1 from rounds limit 1), (select 1 from company_people limit 1) group by segment, investor""")
def missed_investors_query(t):
    return missed_investors(stored_companies(t))


@query("missed_names", _MISSED_NAMES + """,
    r as (select *, (row_number() over (partition by segment, investor order by md5(company)) - 1) // 10000 as part from x)
    select segment, investor, part, string_agg(company, ', ' order by company) as companies
    from r, (select 1 from rounds limit 1), (select 1 from company_people limit 1) group by segment, investor, part""")
def missed_names_query(t):
    return missed_names(companies_of(t))


# --- reports ---------------------------------------------------------------------------------------------------

@query("report_struct", """
    select (select count(*) from orders) as orders, (select max(o_orderdate)::date::varchar from orders) as last_order,
      (select string_agg(p || '=' || n::varchar, ', ' order by p) from (select o_orderpriority as p, count(*) as n from orders group by 1)) as by_priority,
      (select string_agg(r_name, ', ' order by r_name desc) from region) as regions""")
def report_struct(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    by_priority = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("o_orderpriority", "n")))).alias("m"))
    regions = t.region.agg(F.sort_array(F.collect_list("r_name"), asc=False).alias("x")).scalar()
    report = t.orders.agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_orderdate").cast("date").alias("last_order")).select(
        F.struct("orders", "last_order", by_priority.scalar().alias("by_priority"), regions.alias("regions")).alias("report"))
    entries = F.transform(F.map_entries("report.by_priority"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.select("report.orders", "report.last_order", entries.alias("by_priority"), "report.regions")


@query("evidence_groups", f"""
    with h as (select d.id as deal_id, d.deal, d.status, d.meeting_date, h.founder, h.company, h.role from founder_history h join deals d on d.id = h.deal_id)
    select deal_id, lower(split_part(regexp_replace(founder, '(?i)^(dr|mr|ms)\\.?\\s+', ''), ' ', 1)) as person, max(founder) as founder,
      string_agg(distinct deal, ', ' order by deal) as startup, string_agg(distinct company, ', ' order by company) as employer,
      coalesce(string_agg(distinct role, '; ' order by role) filter (where role is not null and role <> ''), 'Role not recorded') as role,
      string_agg(distinct status, ', ' order by status) as status, strftime(max(meeting_date), '%d %b %Y') as we_met from h group by 1, 2""")
def evidence_groups_query(t):
    d = t.deals.select(F.col("id").alias("deal_id"), "deal", "status", "meeting_date")
    hits = t.founder_history.join(d, "deal_id").select(
        "deal_id", "deal", "status", "meeting_date", "founder", F.col("company").alias("employer"), "role",
        F.lit(None).cast("string").alias("linkedin_url"), F.lit("Call notes").alias("recorded_in"))
    return evidence_groups(hits).drop("met_on", "linkedin_url", "recorded_in")

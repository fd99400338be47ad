"""Projections, filters, windows, sorts, limits and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import AS_OF, dt, query, ts
from dealweave.functions.json import json_contains
from dealweave.functions.order import newest, newest_known, oldest
from dealweave.functions.text import holds, holds_any, matches
from dealweave.operators.chunks import count_parts
from dealweave.operators.rows import first_per_group, rank_list, top_k, top_k_per, with_group_value
from dealweave.plans.answers import (
    ANALYSIS_WORDS, ASKING_WORDS, FINANCE_TOPIC, JOINING_WORDS, LONG_QUESTION, audit_sql, error_class, question_profile)
from dealweave.plans.deals import (
    content_level, deal_content, projection, raw_data, raw_data_content, row_sum, slim_sorted, work_queue)

DECIDED_CHECK = """status in ('Pass', 'To be Passed') and created_by is distinct from 'user-7'
    and not list_contains(coalesce(source, []), 'BUILDING')"""
AS_OF_TIME = f"timestamp '{AS_OF}'"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def decided(t, deals=None):
    return raw_data(deals if deals is not None else t.deals, as_of().cast("date"), "user-7", "BUILDING")


@query("raw_data", f"""
    select id, deal, status, {dt('meeting_date')} as meeting_date, datediff('day', meeting_date, date '2024-01-31') as days_since
    from deals where {DECIDED_CHECK}""")
def raw_data_query(t):
    return decided(t).select("id", "deal", "status", "meeting_date", F.col("days_since_first_meeting").alias("days_since"))


@query("slim_sorted", f"""
    select f3_classification, deal, {ts('created_time')} as created_time, founder_name, id, url from deals
    where {DECIDED_CHECK} order by f3_classification, deal""")
def slim(t):
    return slim_sorted(decided(t), ["f3_classification", "deal", "created_time", "founder_name", "id", "url"],
                       ["f3_classification", "deal"])


@query("passthrough_views", f"""
    select company, array_to_string(sector, ', ') as sector, {dt('round_date')} as round_date, founded_year::bigint as founded_year,
      array_to_string(location, ', ') as location, round_name, round_amount_usd::double as round_amount_usd,
      array_to_string(lead_investor, ', ') as lead_investor, array_to_string(round_investors, ', ') as round_investors,
      pipeline_state, id, url from rounds""")
def passthrough(t):
    return projection(t.rounds, "rounds")


@query("null_safe_row_sum", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, (cast(l_quantity as decimal(18,2)) + cast(l_extendedprice as decimal(18,2))
      + coalesce(cast(nullif(l_discount, 0) as decimal(18,2)), 0) + coalesce(cast(nullif(l_tax, 0) as decimal(18,2)), 0))::double as total
    from lineitem""")
def null_safe_row_sum(t):
    rows = t.lineitem.withColumn("d", F.nullif("l_discount", F.lit(0.0))).withColumn("x", F.nullif("l_tax", F.lit(0.0)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       row_sum(["l_quantity", "l_extendedprice", "d", "x"]).alias("total"))


@query("content_join", f"""
    select page_id, coalesce(p.deal, c.deal) as deal, p.status, {dt('p.meeting_date')} as meeting_date, p.url,
      length(transcript) as transcript_chars from content c left join deals p on p.id = c.page_id""")
def content_join(t):
    return deal_content(t.content, t.deals).select("page_id", "deal", "status", "meeting_date", "url", "transcript_chars")


@query("content_level", f"""
    select r.id, r.status, length(c.transcript) as transcript_chars, case when nullif(c.transcript, '') is not null then 'transcript'
      when nullif(c.summary, '') is not null then 'summary only'
      when nullif(c.page_notes, '') is not null or nullif(c.meeting_notes, '') is not null then 'notes only'
      else 'blank page' end as content_level
    from (select * from deals where {DECIDED_CHECK}) r left join content c on c.page_id = r.id""")
def content_level_query(t):
    return raw_data_content(decided(t), t.content).select("id", "status", "transcript_chars", "content_level")


@query("work_queue", f"""
    (select id, deal, url, 'new' as reason from deals where id not in (select page_id from content)
      order by created_time desc nulls last, id limit 50)
    union all
    (select id, p.deal, p.url, 'refresh' from deals p join content c on c.page_id = p.id
      where greatest(created_time, meeting_date::timestamp) > {AS_OF_TIME} - interval 9000 day
        and fetched_at < {AS_OF_TIME} - interval 20 hour order by created_time desc nulls last, id limit 50)""")
def work_queue_query(t):
    return work_queue(t.deals, t.content, as_of(), days=9000)


@query("pattern_predicates", """
    select p_partkey, p_name ilike '%WIDGET%' as named_like, regexp_matches(p_name, '(?i)^RED|anvil$') as named_re,
      not regexp_matches(p_name, '(?i)widget|ring') as not_named, list_has_any([p_type, p_brand], ['PROMO', 'Brand#3']) as overlaps,
      list_contains([p_type, p_brand], 'PROMO') as member, (p_name || ' (%)') like '%(\\%)' escape '\\' as percent
    from part""")
def pattern_predicates(t):
    tags = F.array("p_type", "p_brand")
    return t.part.select(
        "p_partkey", F.col("p_name").ilike("%WIDGET%").alias("named_like"), matches("p_name", r"^RED|anvil\z").alias("named_re"),
        (~matches("p_name", "widget|ring")).alias("not_named"), holds_any(tags, "PROMO", "Brand#3").alias("overlaps"),
        holds(tags, "PROMO").alias("member"), F.concat("p_name", F.lit(" (%)")).like(r"%(\%)").alias("percent"))


@query("json_contains", """
    select event_id, json_extract_string(props, '$.k') = '69' as one_key,
      json_extract_string(m, '$.name') = event_type and list_contains(json_extract_string(m, '$.tags[*]'), 'purchase')
        and json_extract_string(m, '$.at.k') = '7' as nested
    from (select *, '{"name":"' || event_type || '","tags":["x","' || event_type || '"],"at":' || props || '}' as m from events)""")
def json_contains_query(t):
    m = F.concat(F.lit('{"name":"'), "event_type", F.lit('","tags":["x","'), "event_type", F.lit('"],"at":'), "props", F.lit("}"))
    rows = t.events.withColumn("m", m)
    return rows.select(
        "event_id", json_contains("props", {"k": 69}).alias("one_key"),
        json_contains("m", {"name": "purchase", "tags": ["purchase"], "at": {"k": 7}}).alias("nested"))


@query("sql_audit", r"""
    with q as (select doc_id, case source when 'src1' then 'select ''a;b'' from t -- ; x' when 'src2' then 'drop table ' || lang
        when 'src3' then 'select 1; select 2' when 'src4' then 'with a as (select pg_sleep(1)) select * from a;;'
        when 'src5' then ' ;' else 'select ' || text end as sql from documents),
    b as (select *, regexp_replace(trim(sql), ';+\s*$', '') as body from q),
    c as (select *, regexp_replace(regexp_replace(regexp_replace(body, '''(?:[^'']|'''')*''', '''''', 'g'), '--[^\n]*', ' ', 'g'),
        '(?s)/\*.*?\*/', ' ', 'g') as bare from b)
    select doc_id, trim(body) = '' as is_empty, contains(bare, ';') as many_statements,
      not regexp_matches(bare, '(?i)^\s*(select|with)\b') as not_a_query,
      regexp_matches(bare, '(?i)\b(pg_sleep|set_config|copy)\s*\(') as blocked_call from c""")
def sql_audit(t):
    s = F.col("source")
    sql = (
        F.when(s == "src1", "select 'a;b' from t -- ; x").when(s == "src2", F.concat(F.lit("drop table "), "lang"))
        .when(s == "src3", "select 1; select 2").when(s == "src4", "with a as (select pg_sleep(1)) select * from a;;")
        .when(s == "src5", " ;").otherwise(F.concat(F.lit("select "), "text")))
    log = t.documents.select("doc_id", sql.alias("sql"))
    return audit_sql(log, "sql", ["pg_sleep", "set_config", "copy"]).drop("sql")


def _any(words) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


@query("question_profile", rf"""
    with q as (select conv_id, turn, text || case role when 'user' then '? And who? Also why' when 'system' then ' list fintech' else '' end as question
      from conversations),
    n as (select *, length(regexp_replace(question, '[^?]', '', 'g')) + len(regexp_extract_all(question, '{_any(JOINING_WORDS)}')) as parts,
      len(regexp_extract_all(question, '{_any(ASKING_WORDS)}')) as asks, length(question) as length from q)
    select conv_id, turn, parts, asks, length, regexp_matches(question, '(?i){FINANCE_TOPIC}') as about_finance,
      parts > 1 or asks > 1 or length > {LONG_QUESTION} or regexp_matches(question, '{_any(ANALYSIS_WORDS)}') as is_complex
    from n""")
def question_profile_query(t):
    tail = F.when(F.col("role") == "user", "? And who? Also why").when(F.col("role") == "system", " list fintech").otherwise("")
    rows = t.conversations.select("conv_id", "turn", F.concat("text", tail).alias("question"))
    return question_profile(rows).drop("question")


@query("error_class", r"""
    select id, case when error is null then null when regexp_matches(error, '(?i)api key|401|incorrect|key not set') then 'key'
      when regexp_matches(error, '(?i)quota|billing|credit|429|rate|demand|overload|503') then 'busy' else 'other' end as class
    from log""")
def error_class_query(t):
    return t.log.select("id", error_class("error").alias("class"))


# --- windows ---------------------------------------------------------------------------------------------------

@query("first_per_group", """
    with r as (select *, row_number() over (partition by o_custkey order by o_orderpriority, nullif(o_orderstatus, 'P') is null,
      o_orderdate desc, o_orderkey) as n from orders)
    select o_custkey, o_orderkey, o_orderpriority, nullif(o_orderstatus, 'P') as title from r where n = 1""")
def first_per_group_query(t):
    rows = t.orders.withColumn("title", F.nullif("o_orderstatus", F.lit("P")))
    best = first_per_group(rows, ["o_custkey"], [
        oldest("o_orderpriority"), F.col("title").isNull(), newest("o_orderdate"), oldest("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", "o_orderpriority", "title")


@query("rank_list", """
    select event_id, value, row_number() over (order by value desc, event_id) as rank from events
    order by value desc, event_id limit 60""")
def rank_list_query(t):
    return rank_list(t.events.select("event_id", "value"), [F.desc("value"), F.col("event_id")], 60)


@query("part_count", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) over (partition by l_orderkey) as parts from lineitem""")
def part_count(t):
    return count_parts(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey")


@query("group_total", """
    select o_orderkey, o_custkey, sum(o_totalprice::decimal(18,2)) over (partition by o_custkey)::double as customer_total
    from orders""")
def group_total(t):
    rows = t.orders.withColumn("amount", F.col("o_totalprice").cast("decimal(18,2)"))
    return with_group_value(rows, ["o_custkey"], customer_total=F.sum("amount")).select(
        "o_orderkey", "o_custkey", "customer_total")


# --- sorts and limits ------------------------------------------------------------------------------------------

@query("multi_key_sort", f"""
    select id, status, f3_classification, {dt('meeting_date')} as meeting_date from deals
    order by status = 'Pass' desc, meeting_date desc nulls first, f3_classification nulls last, id""")
def multi_key_sort(t):
    return t.deals.orderBy(
        (F.col("status") == "Pass").desc(), newest("meeting_date"), oldest("f3_classification"), oldest("id")
    ).select("id", "status", "f3_classification", "meeting_date")


@query("top_k", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem
    order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 1000""")
def top_k_query(t):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), order, 1000)


@query("top_k_per_query", """
    with r as (select p_brand, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (partition by p_brand
      order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey) as rank from lineitem join part on p_partkey = l_partkey)
    select * from r where rank <= 60""")
def top_k_per_query(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        "p_brand", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return top_k_per(rows, ["p_brand"], order, 60, rank="rank")


# --- unions ----------------------------------------------------------------------------------------------------

@query("union_sources", """
    select c_name as name, 'customer' as source, c_acctbal as amount from customer
    union all select s_name, 'supplier', s_acctbal from supplier
    union all select p_name, 'part', null from part""")
def union_sources(t):
    return (
        t.customer.select(F.col("c_name").alias("name"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("amount"))
        .unionByName(t.supplier.select(
            F.col("s_name").alias("name"), F.lit("supplier").alias("source"), F.col("s_acctbal").alias("amount")))
        .unionByName(t.part.select(
            F.col("p_name").alias("name"), F.lit("part").alias("source"), F.lit(None).cast("double").alias("amount"))))


@query("overlapping_segments", """
    select segment, count(*) as deals, sum(amount)::double as amount from (
      select 'Urgent' as segment, amount from deals where decision_to_pass_stage = 'Deck Scan'
      union all select 'All', amount from deals) group by segment""")
def overlapping_segments(t):
    segments = F.array_compact(F.array(
        F.when(F.col("decision_to_pass_stage") == "Deck Scan", F.lit("Urgent")), F.lit("All")))
    rows = t.deals.select(F.explode(segments).alias("segment"), "amount")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("deals"), F.sum("amount").alias("amount"))


@query("distinct_rows", "select distinct f3_classification, decision_to_pass_stage, status from deals")
def distinct_rows(t):
    return t.deals.select("f3_classification", "decision_to_pass_stage", "status").distinct()


@query("log_search", """
    with f as (select * from log where (question ilike '%click%' or answer ilike '%click%') and error is null)
    select id, coalesce(user_email, client_id) as who, question, (select count(*) from f) > 100 as truncated from f
    order by id desc limit 100""")
def log_search_query(t):
    from dealweave.plans.usage import log_search
    return log_search(t.log, limit=100, text="click", status="answered").select(
        "id", "who", "question", "truncated")

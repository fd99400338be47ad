"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import dt, nk, query, ts
from dealweave.functions.hashing import content_hash, request_key
from dealweave.functions.json import compact_json
from dealweave.functions.text import company_part, joined, name_key, profile_slug, question_key, title_part


@query("name_key", f"""
    with n as (select deal as name from deals union all select s_name || ' Pvt Ltd' from supplier union all select ' ' || p_name || ' & Co' from part
      union all select url from pages union all select text from documents)
    select name, {nk('name')} as key from n""")
def name_key_query(t):
    names = (
        t.deals.select(F.col("deal").alias("name"))
        .unionByName(t.supplier.select(F.concat("s_name", F.lit(" Pvt Ltd")).alias("name")))
        .unionByName(t.part.select(F.concat(F.lit(" "), "p_name", F.lit(" & Co")).alias("name")))
        .unionByName(t.pages.select(F.col("url").alias("name")))
        .unionByName(t.documents.select(F.col("text").alias("name"))))
    return names.select("name", name_key("name").alias("key"))


@query("profile_slug", """
    select id, coalesce(lower(nullif(regexp_extract(founder_1_linkedin, '(?i)linkedin\\.com/in/([^/?#]+)', 1), '')), 'nolink:' || id || ':1') as key_1,
      lower(nullif(regexp_extract(founder_2_linkedin, '(?i)linkedin\\.com/in/([^/?#]+)', 1), '')) as key_2 from snapshot""")
def profile_slug_query(t):
    own = F.concat(F.lit("nolink:"), "id", F.lit(":1"))
    return t.snapshot.select("id", F.coalesce(profile_slug("founder_1_linkedin"), own).alias("key_1"),
                             profile_slug("founder_2_linkedin").alias("key_2"))


@query("title_company_split", r"""
    with e as (select id, trim(unnest(string_split_regex(founder_1_designations, ';\s*'))) as raw from snapshot)
    select id, raw, case when contains(raw, ' - ') then trim(regexp_extract(raw, '(?s)^(.*) - .*$', 1)) end as title,
      case when contains(raw, ' - ') then trim(regexp_extract(raw, '(?s)^.* - (.*)$', 1)) else raw end as company from e""")
def title_company_split(t):
    rows = t.snapshot.select("id", F.explode(F.split("founder_1_designations", r";\s*")).alias("raw"))
    return rows.select("id", F.trim("raw").alias("raw"), title_part("raw").alias("title"), company_part("raw").alias("company"))


@query("string_functions", r"""
    select p_partkey, lower(p_brand) || '/' || upper(p_type) as low_up, trim('  ' || p_name || ' ') as trimmed, replace(p_name, 'red', 'RED') as replaced,
      substr(p_name, 1, 3) as head, substr(p_name, 4) as tail, length(p_name) as size, split_part(p_name, ' ', 2) as second,
      concat_ws(' | ', nullif(p_type, 'PROMO'), p_brand) as joined_text, nullif(p_type, 'PROMO') || '!' as concat_null,
      strpos(p_name, 'd') as pos, regexp_replace(p_name, '[aeiou]', '_', 'g') as no_vowels,
      nullif(regexp_extract(p_brand, '#(\d+)', 1), '') as number, array_to_string(regexp_extract_all(p_name, '[a-z]+', 0), '+') as words,
      'n: ' || coalesce(nullif(p_type, 'PROMO'), '') || ', ' || p_size::varchar as formatted,
      array_to_string(string_split_regex(p_name, '\s+'), ',') as split_words
    from part""")
def string_functions(t):
    kind = F.nullif("p_type", F.lit("PROMO"))
    return t.part.select(
        "p_partkey", F.concat(F.lower("p_brand"), F.lit("/"), F.upper("p_type")).alias("low_up"),
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.replace("p_name", F.lit("red"), F.lit("RED")).alias("replaced"), F.substring("p_name", 1, 3).alias("head"),
        F.expr("substr(p_name, 4)").alias("tail"), F.length("p_name").alias("size"),
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("second"), F.concat_ws(" | ", kind, "p_brand").alias("joined_text"),
        F.concat(kind, F.lit("!")).alias("concat_null"), F.locate("d", "p_name").alias("pos"),
        F.regexp_replace("p_name", "[aeiou]", "_").alias("no_vowels"),
        F.nullif(F.regexp_extract("p_brand", r"#(\d+)", 1), F.lit("")).alias("number"),
        F.array_join(F.regexp_extract_all("p_name", F.lit("[a-z]+"), F.lit(0)), "+").alias("words"),
        F.format_string("n: %s, %s", F.coalesce(kind, F.lit("")), "p_size").alias("formatted"),
        F.array_join(F.split("p_name", r"\s+"), ",").alias("split_words"))


@query("date_functions", f"""
    select o_orderkey, datediff('day', o_orderdate::date, date '2001-01-01') as days, {ts("o_orderdate - interval 20 hour")} as earlier,
      {dt("o_orderdate::date")} as day, {dt("date_trunc('week', o_orderdate)")} as week, year(o_orderdate) as year,
      epoch(o_orderdate)::bigint as seconds, strftime(o_orderdate, '%d %b %Y') as shown,
      {ts("greatest(o_orderdate, timestamp '1998-01-01', null)")} as later,
      len(generate_series(date_trunc('week', o_orderdate), timestamp '2001-01-01', interval 7 day)) as weeks_left
    from orders""")
def date_functions(t):
    d = F.col("o_orderdate")
    end = F.lit("2001-01-01 00:00:00").cast("timestamp")
    week = F.date_trunc("week", d)
    steps = F.when(week <= end, F.size(F.sequence(week, end, F.make_dt_interval(F.lit(7))))).otherwise(0)
    return t.orders.select(
        "o_orderkey", F.datediff(F.lit("2001-01-01").cast("date"), d).alias("days"),
        (d - F.make_dt_interval(F.lit(0), F.lit(20))).alias("earlier"), d.cast("date").alias("day"),
        week.cast("date").alias("week"), F.year(d).alias("year"), F.unix_timestamp(d).alias("seconds"),
        F.date_format(d, "dd MMM yyyy").alias("shown"),
        F.greatest(d, F.lit("1998-01-01 00:00:00").cast("timestamp"), F.lit(None).cast("timestamp")).alias("later"),
        steps.alias("weeks_left"))


@query("math_functions", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice::decimal(18,2), 1)::double as rounded,
      abs(l_discount - l_tax) as gap, least(greatest(l_quantity, 5), 40) as clamped,
      round((100 * l_discount)::decimal(18,2) / nullif(l_tax, 0)::decimal(18,2), 4)::double as percent,
      l_extendedprice / 1000000 as millions, 1.3 / (60 + l_linenumber) + 1.0 / (60 + l_quantity) as score
    from lineitem""")
def math_functions(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice").cast("decimal(18,2)"), 1).alias("rounded"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.least(F.greatest("l_quantity", F.lit(5.0)), F.lit(40.0)).alias("clamped"),
        F.round((F.col("l_discount") * 100).cast("decimal(18,2)") / F.nullif("l_tax", F.lit(0.0)).cast("decimal(18,2)"), 4).alias("percent"),
        (F.col("l_extendedprice") / 1_000_000).alias("millions"),
        (F.lit(1.3) / (F.col("l_linenumber") + 60.0) + F.lit(1.0) / (F.col("l_quantity") + 60.0)).alias("score"))


@query("array_functions", """
    select id, len(sectors) as size, array_to_string(sectors, ', ') as text, list_contains(coalesce(source, []), 'BUILDING') as member,
      not status in ('Pass', 'Tracking') as outside, coalesce(list_has_any(sectors, ['BUILDING', '1-URGENT']), false) as overlap,
      array_to_string(list_concat(coalesce(sectors, []), coalesce(source, [])), '+') as chained, sectors[1] as first,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(sectors, []), coalesce(source, [])))), ',') as distinct_values
    from deals""")
def array_functions(t):
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("sectors", none), F.coalesce("source", none))
    return t.deals.select(
        "id", F.size("sectors").alias("size"), F.array_join("sectors", ", ").alias("text"),
        F.array_contains(F.coalesce("source", none), "BUILDING").alias("member"),
        (~F.col("status").isin("Pass", "Tracking")).alias("outside"),
        F.coalesce(F.arrays_overlap("sectors", F.array(F.lit("BUILDING"), F.lit("1-URGENT"))), F.lit(False)).alias("overlap"),
        F.array_join(both, "+").alias("chained"), F.get("sectors", F.lit(0)).alias("first"),
        F.array_join(F.sort_array(F.array_distinct(both)), ",").alias("distinct_values"))


@query("json_functions", """
    select event_id, json_extract_string(props, '$.k') as k, json_exists(props, '$.k') as has_k, json_exists(props, '$.z') as has_z,
      '{"id":' || event_id::varchar || ',"type":"' || event_type || '"' || case when event_type <> 'view' then ',"user":' || user_id::varchar else '' end || '}' as built,
      json_extract_string('["' || event_type || '","x"]', '$[0]') as first from events""")
def json_functions(t):
    user = F.when(F.col("event_type") != "view", F.col("user_id"))
    return t.events.select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("props", "$.k").isNotNull().alias("has_k"), F.get_json_object("props", "$.z").isNotNull().alias("has_z"),
        compact_json(id=F.col("event_id"), type=F.col("event_type"), user=user).alias("built"),
        F.get(F.from_json(F.to_json(F.array("event_type", F.lit("x"))), "array<string>"), F.lit(0)).alias("first"))


@query("hash_functions", r"""
    select doc_id, md5(coalesce(nullif(case when lang = 'de' then '' else source end, ''), '(unnamed)') || chr(10) || text) as content,
      sha256(trim(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[\s?.!]+$', '')) || chr(10) || lang || chr(10) || '') as request
    from documents""")
def hash_functions(t):
    title = F.when(F.col("lang") == "de", "").otherwise(F.col("source"))
    return t.documents.select("doc_id", content_hash(title, "text").alias("content"),
                              request_key("text", "lang", F.lit(None).cast("string")).alias("request"))


@query("question_key", r"""
    select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text || ' ?! .'), '\s+', ' ', 'g'), '[\s?.!]+$', '')) as key
    from conversations""")
def question_key_query(t):
    return t.conversations.select("conv_id", "turn", question_key(F.concat("text", F.lit(" ?! ."))).alias("key"))


@query("optional_lines", """
    select id, concat_ws(chr(10), 'Deal: ' || deal, 'Class: ' || f3_classification, 'Sectors: ' || array_to_string(sectors, ', ')) as body from deals""")
def optional_lines(t):
    from dealweave.functions.text import labelled_lines
    return t.deals.select("id", labelled_lines(
        ("Deal: ", F.col("deal")), ("Class: ", F.col("f3_classification")), ("Sectors: ", joined("sectors"))).alias("body"))

"""Join shapes and rows made from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import chunks_of, nk, parts_of, query
from dealweave.catalog.rowsets import DECIDED_CHECK, decided
from dealweave.functions.order import newest, oldest
from dealweave.operators.chunks import register_text_chunks
from dealweave.operators.joins import (
    alias_cascade, alias_map, canonical_name, explode_array, explode_split, join_first, link_by_key, nearest_match,
    regex_join, unpivot_slots, with_exists, with_in_flag, with_other_owner)

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("left_enrich", """
    select c_custkey, n_name, r_name from customer left join nation on n_nationkey = c_nationkey and n_nationkey <> 3
    left join region on r_regionkey = n_regionkey""")
def left_enrich(t):
    nation = t.nation.filter("n_nationkey <> 3")
    return t.customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(
        t.region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("inner_link", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name from lineitem join part on p_partkey = l_partkey
    join supplier on s_suppkey = l_suppkey""")
def inner_link(t):
    return t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(
        t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(*KEY, "p_name", "s_name")


@query("full_outer_merge", """
    with a as (select o_custkey as k, count(*) as n_f from orders where o_orderstatus = 'F' group by 1),
    b as (select o_custkey as k, count(*) as n_urgent from orders where o_orderpriority = '1-URGENT' group by 1)
    select coalesce(a.k, b.k) as custkey, n_f, n_urgent from a full join b on a.k = b.k""")
def full_outer_merge(t):
    def counted(condition, name):
        return t.orders.filter(condition).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias(name))

    return counted("o_orderstatus = 'F'", "n_f").join(counted("o_orderpriority = '1-URGENT'", "n_urgent"), "custkey", "full")


@query("semi_flag", """
    select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') as has_closed from customer
    where exists (select 1 from orders where o_custkey = c_custkey)""")
def semi_flag(t):
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    kept = t.customer.join(orders, "c_custkey", "left_semi")
    return with_exists(kept, orders.filter("o_orderstatus = 'F'"), ["c_custkey"], "has_closed").select("c_custkey", "has_closed")


@query("anti_filter", """
    select p_partkey, p_name from part where not exists (
      select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'A' and l_linestatus = 'O')""")
def anti_filter(t):
    used = t.lineitem.filter("l_returnflag = 'A' and l_linestatus = 'O'").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(used, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query("in_flag_nullable", f"""
    select id, (f3_classification in (select c_mktsegment from customer where c_acctbal > 9900))::varchar as big_segment,
      (created_by in (select created_by from deals where {DECIDED_CHECK} and created_by is not null))::varchar as known_user
    from deals""")
def in_flag_nullable(t):
    big = t.customer.filter("c_acctbal > 9900").select("c_mktsegment")
    users = decided(t).filter("created_by is not null").select(F.col("created_by").alias("u"))
    rows = with_in_flag(t.deals, big, "f3_classification", "c_mktsegment", "big_segment")
    return with_in_flag(rows, users, "created_by", "u", "known_user").select(
        "id", F.col("big_segment").cast("string").alias("big_segment"), F.col("known_user").cast("string").alias("known_user"))


@query("broadcast_scalar", """
    select o_orderkey, o_totalprice > (select avg(o_totalprice::decimal(18,2)) from orders) as above_mean,
      (select max(o_totalprice) from orders) - o_totalprice as below_max from orders""")
def broadcast_scalar(t):
    mean = t.orders.agg(F.avg(F.col("o_totalprice").cast("decimal(18,2)"))).scalar()
    top = t.orders.agg(F.max("o_totalprice")).scalar()
    return t.orders.select("o_orderkey", (F.col("o_totalprice") > mean).alias("above_mean"),
                           (top - F.col("o_totalprice")).alias("below_max"))


@query("regex_join", r"""
    with p as (select s_name as name, '\b(' || case when s_nationkey < 8 then 'red' when s_nationkey < 16 then 'old' else 'x+' end
      || '|' || lower(s_name) || ')\b.*g' as pattern from supplier group by all
      union all select 'broken', '(' )
    select p_partkey, name from part join (select * from p where name <> 'broken') p on regexp_matches(p_name, '(?is)' || pattern)""")
def regex_join_query(t):
    word = F.when(F.col("s_nationkey") < 8, "red").when(F.col("s_nationkey") < 16, "old").otherwise("x+")
    patterns = t.supplier.select(
        F.col("s_name").alias("name"),
        F.concat(F.lit(r"\b("), word, F.lit("|"), F.lower("s_name"), F.lit(r")\b.*g")).alias("pattern")).distinct()
    broken = t.region.select(F.lit("broken").alias("name"), F.lit("(").alias("pattern")).distinct()
    return regex_join(t.part.select("p_partkey", "p_name"), "p_name", patterns.unionByName(broken), "name", "pattern") \
        .select("p_partkey", "name")


@query("inequality_self_join", """
    with l as (select l.*, p_type as state, p_name || p_brand as company from lineitem l join part on p_partkey = l_partkey)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, exists (select 1 from l s where s.l_suppkey = l.l_suppkey
      and s.l_orderkey = l.l_orderkey and s.company <> l.company and s.state <> 'PROMO') as known from l""")
def inequality_self_join(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        *KEY, F.col("p_type").alias("state"), F.concat("p_name", "p_brand").alias("company"),
        F.concat_ws("-", "l_suppkey", "l_orderkey").alias("investor"))
    seen = rows.filter("state <> 'PROMO'")
    return with_other_owner(rows, seen, "investor", "company", "known").select(*KEY, "known")


@query("nearest_date_match", """
    with l as (select o_orderkey, o_custkey, case when o_orderpriority <> '5-LOW' then o_orderdate::date end as d from orders
        where o_orderstatus = 'F'),
    r as (select o_orderkey as rid, o_custkey as rk, case when o_orderpriority <> '2-HIGH' then o_orderdate::date end as rd,
        case when o_orderpriority <> '3-MEDIUM' then o_totalprice end as created from orders where o_orderstatus = 'O'),
    j as (select o_orderkey, rid, row_number() over (partition by o_orderkey order by
        abs(datediff('day', coalesce(d, date '1900-01-01'), coalesce(rd, date '1900-01-01'))), created desc nulls first, rid) as n
      from l left join r on rk = o_custkey)
    select o_orderkey, rid as match_rid from j where n = 1""")
def nearest_date_match(t):
    day, low = F.col("o_orderdate").cast("date"), F.col("o_orderpriority")
    left = t.orders.filter("o_orderstatus = 'F'").select(
        "o_orderkey", F.col("o_custkey").alias("k"), F.when(low != "5-LOW", day).alias("d"))
    right = t.orders.filter("o_orderstatus = 'O'").select(
        F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("k"), F.when(low != "2-HIGH", day).alias("rd"),
        F.when(low != "3-MEDIUM", F.col("o_totalprice")).alias("created"))
    return nearest_match(left, right, "k", "d", "rd", [newest("created"), oldest("rid")], ["rid"]).select(
        "o_orderkey", "match_rid")


@query("normalised_key_join", f"""
    with d as (select id, {nk('deal')} as k from deals), s as (select id as sid, {nk('deal')} as sk from snapshot)
    select d.id, k as key, sid from d left join s on sk = k""")
def normalised_key_join(t):
    right = t.snapshot.select(F.col("id").alias("sid"), F.col("deal").alias("snapshot_name"))
    return link_by_key(t.deals.select("id", "deal"), right, "deal", "snapshot_name").select("id", "key", "sid")


@query("alias_map", """
    with z as (select lower(name) as key, name, 1 as o from companies
      union all select lower(unnest(aliases)), name, 2 from companies),
    r as (select *, row_number() over (partition by key order by o, name) as n from z)
    select key, name as canonical from r where n = 1""")
def alias_map_query(t):
    return alias_map(t.companies)


@query("alias_cascade", """
    with v as (select distinct case o_orderpriority when '1-URGENT' then c_mktsegment when '2-HIGH' then c_mktsegment || ' Corp'
        when '3-MEDIUM' then lower(c_mktsegment) when '5-LOW' then 'Nation ' || c_nationkey::varchar
        else 'New ' || c_mktsegment end as v from orders join customer on c_custkey = o_custkey)
    select v, coalesce((select min(name) from companies where name = v), (select min(name) from companies where list_contains(aliases, v)),
      (select min(name) from companies where lower(name) = lower(v)), v) as company from v""")
def alias_cascade_query(t):
    p, seg = F.col("o_orderpriority"), F.col("c_mktsegment")
    v = (F.when(p == "1-URGENT", seg).when(p == "2-HIGH", F.concat(seg, F.lit(" Corp"))).when(p == "3-MEDIUM", F.lower(seg))
         .when(p == "5-LOW", F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")))
         .otherwise(F.concat(F.lit("New "), seg)))
    values = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(v.alias("v")).distinct()
    resolved, _ = alias_cascade(values, "v", t.companies)
    return resolved.select("v", "company")


@query("canonical_names", """
    select s.id, s.x as spelling, coalesce(min(c.name), s.x) as company from (
      select id, unnest(list_transform(string_split(founder_1_previous_company_worked_at, ','), lambda x: trim(x))) as x from snapshot) s
    left join (select name, unnest(list_append(aliases, name)) as a from companies) c on lower(c.a) = lower(s.x) group by s.id, s.x""")
def canonical_names(t):
    spelled = explode_split(t.snapshot.select("id", "founder_1_previous_company_worked_at"),
                            "founder_1_previous_company_worked_at", "spelling")
    return canonical_name(spelled, "spelling", alias_map(t.companies), "company").select("id", "spelling", "company")


@query("lateral_split", f"""
    select id, unnest({parts_of("previous_company_worked_at || ' ; ,x' || chr(10) || ' y '")}) as part from deal_previous""")
def lateral_split(t):
    text = F.concat("previous_company_worked_at", F.lit(" ; ,x\n y "))
    return explode_split(t.deal_previous.withColumn("text", text), "text", "part").select("id", "part")


@query("lateral_unnest", """
    select id, 'inner' as mode, unnest(sectors) as element from deals
    union all select id, 'outer', unnest(case when len(sectors) > 0 then sectors else [null] end) from deals
    union all select id, 'default', unnest(case when len(sectors) > 0 then sectors else ['Unclassified'] end) from deals
    union all select id, 'joined', unnest(list_concat(coalesce(sectors, []), coalesce(source, []))) from deals""")
def lateral_unnest(t):
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("sectors", none), F.coalesce("source", none))
    parts = [
        explode_array(t.deals, "sectors", "element").select("id", F.lit("inner").alias("mode"), "element"),
        explode_array(t.deals, "sectors", "element", "outer").select("id", F.lit("outer").alias("mode"), "element"),
        explode_array(t.deals, "sectors", "element", "default", "Unclassified").select("id", F.lit("default").alias("mode"), "element"),
        explode_array(t.deals, both, "element").select("id", F.lit("joined").alias("mode"), "element"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("lateral_unpivot", """
    with u as (
      select l_orderkey, l_linenumber, l_partkey, l_suppkey, 1 as slot, nullif(l_returnflag, 'N') as name, nullif(l_tax, 0) as amount from lineitem
      union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, l_linestatus, nullif(l_discount, 0) from lineitem)
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, slot, name, amount from u where name is not null or amount is not null""")
def lateral_unpivot(t):
    rows = t.lineitem.withColumn("f", F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag"))) \
        .withColumn("x", F.nullif("l_tax", F.lit(0.0))).withColumn("d", F.nullif("l_discount", F.lit(0.0)))
    slots = [{"name": "f", "amount": "x"}, {"name": "l_linestatus", "amount": "d"}]
    out = unpivot_slots(rows.select(*KEY, "f", "x", "l_linestatus", "d"), slots, keep=("name", "amount"))
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("lateral_first", """
    select c_custkey, (select min(o_orderkey) from orders where o_custkey = c_custkey) as first_order from customer""")
def lateral_first(t):
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("first_order"))
    return join_first(t.customer.select("c_custkey"), orders, "c_custkey", [oldest("first_order")])


@query("lateral_function", f"with recursive {chunks_of('select doc_id as id, text as txt, 1600 as size from documents').strip()}" + """
    select id as doc_id, part::bigint as part, chunk, parts::bigint as parts from cut""")
def lateral_function(t):
    register_text_chunks(t.spark)
    return t.spark.sql(
        "select d.doc_id, c.part, c.chunk, count(*) over (partition by d.doc_id) as parts "
        "from {docs} d, lateral text_chunks(d.text, 1600) c", docs=t.documents)

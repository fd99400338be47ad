"""Sources, upserts, pruning and document merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import AS_OF, query, ts
from dealweave.functions.order import newest, oldest
from dealweave.operators.merge import (
    apply_patches, classify_documents, finish_documents, merge_documents, prune_stale, upsert, vector_table)
from dealweave.operators.rows import bounded, latest_per_key
from dealweave.session import shared_folder
from dealweave.sources.entities import apply_overrides, load_entities
from dealweave.sources.pages import SourceColumn, convert, extract_properties, load_source, read_pages, PAGE_SCHEMA

_COLUMNS = [
    SourceColumn("Name", "name", "text"), SourceColumn("Segment", "segment", "text"),
    SourceColumn("Tags", "tags", "arr"), SourceColumn("Parts", "parts", "arrsplit"),
    SourceColumn("Balance", "balance", "num"), SourceColumn("Active", "active", "bool"),
    SourceColumn("Met", "met", "date"), SourceColumn("Owner", "owner", "text"),
    SourceColumn("Roll", "roll", "arr"), SourceColumn("Code", "code", "text"),
    SourceColumn("Links", "links", "arr"), SourceColumn("Made", "made", "ts"),
]


def _page_json(t):
    """Customers as exported pages, one JSON text per page."""
    text, s = F.col("c_name"), F.struct
    name = F.array(s(F.substring(text, 1, 9).alias("plain_text")), s(F.substring(text, 10, 100).alias("plain_text")))
    item = s(F.lit("select").alias("type"), s(F.col("c_mktsegment").alias("name")).alias("select"))
    props = s(
        s(F.lit("title").alias("type"), name.alias("title")).alias("Name"),
        s(F.lit("select").alias("type"), s(F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("name")).alias("select"))
        .alias("Segment"),
        s(F.lit("multi_select").alias("type"), F.when(F.col("c_acctbal") > 0, F.array(
            s(F.col("c_mktsegment").alias("name")), s(F.lit("").alias("name")), s(F.lit("x").alias("name"))))
          .otherwise(F.array().cast("array<struct<name:string>>")).alias("multi_select")).alias("Tags"),
        s(F.lit("rich_text").alias("type"), F.array(s(F.concat(F.lit("a ;b;; "), "c_mktsegment").alias("plain_text")))
          .alias("rich_text")).alias("Parts"),
        s(F.lit("number").alias("type"), F.col("c_acctbal").alias("number")).alias("Balance"),
        s(F.lit("checkbox").alias("type"), (F.col("c_acctbal") > 100).alias("checkbox")).alias("Active"),
        s(F.lit("date").alias("type"), s(F.lit("2024-03-05T10:00:00Z").alias("start")).alias("date")).alias("Met"),
        s(F.lit("created_by").alias("type"), s(F.col("c_nationkey").cast("string").alias("id")).alias("created_by"))
        .alias("Owner"),
        s(F.lit("rollup").alias("type"), s(F.lit("array").alias("type"), F.array(item, item).alias("array"))
          .alias("rollup")).alias("Roll"),
        s(F.lit("unique_id").alias("type"), s(F.col("c_custkey").alias("number"), F.lit("C").alias("prefix"))
          .alias("unique_id")).alias("Code"),
        s(F.lit("relation").alias("type"), F.array(s(F.lit("a-b-c").alias("id"))).alias("relation")).alias("Links"),
        s(F.lit("created_time").alias("type"), F.lit("2024-03-05T10:20:30Z").alias("created_time")).alias("Made"))
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "database").otherwise("page")
    return t.customer.select(F.to_json(s(
        kind.alias("object"), F.concat(F.lit("p-"), F.col("c_custkey").cast("string")).alias("id"),
        (F.col("c_acctbal") < -500).alias("in_trash"), (F.col("c_nationkey") == 24).alias("archived"),
        props.alias("properties"))).alias("value"))


def _pages(t):
    return _page_json(t).select(F.from_json("value", PAGE_SCHEMA).alias("p")).select("p.*")


@query("pages_extract", """
    select 'p-' || c_custkey::varchar as id, c_name as name, nullif(c_mktsegment, 'MACHINERY') as segment,
      case when c_acctbal > 0 then c_mktsegment || ', , x' else '' end as tags, 'a ;b;; ' || c_mktsegment as parts,
      (c_acctbal > 100)::varchar as active, '2024-03-05T10:00:00Z' as met, 'user-' || c_nationkey::varchar as owner,
      c_mktsegment || ', ' || c_mktsegment as roll, 'C-' || c_custkey::varchar as code,
      'https://pages.example/abc' as links, '2024-03-05T10:20:30Z' as made
    from customer""")
def pages_extract(t):
    return extract_properties(_pages(t), [c for c in _COLUMNS if c.name != "balance"])


@query("pages_convert", """
    with raw as (select event_id, json_extract_string(props, '$.k') as k, event_type, value from events),
    shaped as (select event_id, case event_type when 'click' then '["' || k || '","","b"]' when 'view' then k || '; x ;;y'
      when 'error' then '' when 'purchase' then '__YES__' else '2024-01-0' || substr(k, 1, 1) || 'T00:00:00Z' end as raw,
      k, event_type from raw)
    select event_id,
      case event_type when 'click' then k || ', , b' when 'error' then null else raw end as arr,
      case event_type when 'click' then k || ', b' when 'view' then k || ', x, y' when 'error' then null else raw end as arrsplit,
      case when event_type = 'error' then null else (raw = '__YES__')::varchar end as bool,
      k::double as num,
      case when event_type = 'signup' then case when raw like '2024-01-00%' then null else substr(raw, 1, 10) end end as date,
      nullif(raw, '') as text
    from shaped""")
def pages_convert(t):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit('["'), k, F.lit('","","b"]')))
        .when(kind == "view", F.concat(k, F.lit("; x ;;y"))).when(kind == "error", "").when(kind == "purchase", "__YES__")
        .otherwise(F.concat(F.lit("2024-01-0"), F.substring(k, 1, 1), F.lit("T00:00:00Z"))))
    shaped = t.events.select("event_id", raw.alias("raw"), k.alias("k"))
    return shaped.select(
        "event_id", convert("raw", "arr").alias("arr"), convert("raw", "arrsplit").alias("arrsplit"),
        convert("raw", "bool").cast("string").alias("bool"), convert("k", "num").alias("num"),
        convert("raw", "date").alias("date"), convert("raw", "text").alias("text"))


@query("pages_scan", f"""
    select 'p-' || c_custkey::varchar as id, 'https://pages.example/p' || c_custkey::varchar as url, c_name as name,
      nullif(c_mktsegment, 'MACHINERY') as segment, case when c_acctbal > 0 then c_mktsegment || ', x' end as tags,
      'a, b, ' || c_mktsegment as parts, c_acctbal as balance, c_acctbal > 100 as active, '2024-03-05' as met,
      'user-' || c_nationkey::varchar as owner, c_mktsegment || ', ' || c_mktsegment as roll,
      'C-' || c_custkey::varchar as code, 'https://pages.example/abc' as links, '2024-03-05 10:20:30' as made,
      '{AS_OF}' as synced_at
    from customer where c_mktsegment <> 'AUTOMOBILE' and not c_acctbal < -500 and c_nationkey <> 24""")
def pages_scan(t):
    folder = shared_folder(t.spark) + "/pages"
    _page_json(t).write.text(folder)
    return load_source(read_pages(t.spark, folder), _COLUMNS, F.lit(AS_OF).cast("timestamp"))


# Old orders are the mirror, open and pending ones arrive again with a new total.
_MIRROR = "select o_orderkey as id, o_totalprice as total, o_orderdate::date as day from orders where o_orderstatus <> 'O'"
_BATCH = """select o_orderkey as id, o_totalprice + 1 as total, o_orderdate::date as day from orders
    where o_orderstatus <> 'F'"""


def _mirror(t):
    return t.orders.filter(F.col("o_orderstatus") != "O").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("date").alias("day"))


def _batch(t):
    """Every row arrives twice; the larger total is the later one."""
    rows = t.orders.filter(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("id"), F.explode(F.array(F.col("o_totalprice"), F.col("o_totalprice") + 1)).alias("total"),
        F.col("o_orderdate").cast("date").alias("day"))
    return rows


@query("mirror_upsert", f"""
    with old as ({_MIRROR}), new as ({_BATCH})
    select id, total, day::varchar as day from new
    union all select id, total, day::varchar from old where id not in (select id from new)""")
def mirror_upsert(t):
    return upsert(_mirror(t), _batch(t), "id", [F.desc("total")])


_STAMPED = """select o_orderkey as id, case when o_orderpriority = '1-URGENT' then 'old' else 'run' end as stamp from orders"""


def _stamped(t):
    return t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "old").otherwise("run").alias("stamp"))


@query("mirror_prune_guarded", f"""
    with held as ({_STAMPED}), g as (select count(*) filter (where stamp = 'run') as seen, count(*) as held from held)
    select h.id, h.stamp, g.seen, g.held, g.seen > 0 and g.seen >= 0.75 * g.held as pruned,
      case when g.seen > 0 and g.seen >= 0.75 * g.held then g.held - g.seen else 0 end as removed
    from held h, g where h.stamp = 'run' or not (g.seen > 0 and g.seen >= 0.75 * g.held)""")
def mirror_prune_guarded(t):
    kept, report = prune_stale(_stamped(t), "stamp", "run", 0.75)
    row = report.select(F.struct("seen", "held", "pruned", "removed").alias("r")).scalar()
    return kept.select("id", "stamp", row["seen"].alias("seen"), row["held"].alias("held"), row["pruned"].alias("pruned"),
                       row["removed"].alias("removed"))


@query("sync_log_latest", f"""
    with r as (select *, row_number() over (partition by source order by finished_at desc, id desc) as n,
        row_number() over (partition by source, ok order by finished_at desc, id desc) as n_ok,
        row_number() over (partition by source, error like 'nightly%' order by finished_at desc, id desc) as n_note from runs)
    select 'all' as view, source, id, {ts('finished_at')} as finished_at, ok, error from r where n = 1
    union all select 'ok', source, id, {ts('finished_at')}, ok, error from r where ok and n_ok = 1
    union all select 'nightly', source, id, {ts('finished_at')}, ok, error from r where error like 'nightly%' and n_note = 1""")
def sync_log_latest(t):
    order = [newest("finished_at"), newest("id")]
    views = {"all": t.runs, "ok": t.runs.filter("ok"), "nightly": t.runs.filter(F.col("error").ilike("nightly%"))}
    out = None
    for view, rows in views.items():
        part = latest_per_key(rows, ["source"], order).select(
            F.lit(view).alias("view"), "source", "id", "finished_at", "ok", "error")
        out = part if out is None else out.unionByName(part)
    return out


@query("entity_load", """
    select 'n' || event_id::varchar as name, event_type as entity, null::varchar as parent_group, 'org' as entity_type,
      null::varchar as domain, 'verified' as status, 'high' as confidence, null::varchar as evidence_url,
      '' as note, json_extract_string(props, '$.k')::int::bigint as cluster from events""")
def entity_load(t):
    row = F.array(
        F.concat(F.lit("n"), F.col("event_id").cast("string")), F.col("event_type"), F.lit(None).cast("string"), F.lit("org"),
        F.lit(None).cast("string"), F.lit("verified"), F.lit("high"), F.lit(None).cast("string"), F.lit(""),
        F.get_json_object("props", "$.k"))
    return load_entities(t.events.select(F.to_json(F.array(row)).alias("rows")))


_EDITS = """select p_partkey as edit_no, ' ' || p_name || ' ' as name,
    case p_type when 'PROMO' then 'delete' else 'save' end as action,
    case p_type when 'LARGE' then 'wrong' else 'verified' end as status, 'Edited ' || p_brand as entity, ' ' as parent_group,
    'type' as entity_type, cast(null as varchar) as domain, p_type as note from part where p_size > 40"""


@query("manual_overrides", f"""
    with edits as ({_EDITS}), valid as (select *, row_number() over (partition by trim(name) order by edit_no desc) as n
      from edits where action = 'delete' or status = 'verified'),
    last as (select * from valid where n = 1)
    select coalesce(e.name, trim(l.name)) as name, case when l.edit_no is not null then l.entity else e.entity end as entity,
      case when l.edit_no is not null then null else e.parent_group end as parent_group,
      case when l.edit_no is not null then l.entity_type else e.entity_type end as entity_type,
      case when l.edit_no is not null then l.status else e.status end as status,
      case when l.edit_no is not null then null else e.domain end as domain
    from entities e full join last l on trim(l.name) = e.name where l.edit_no is null or l.action <> 'delete'""")
def manual_overrides(t):
    edits = t.part.filter("p_size > 40").select(
        F.col("p_partkey").alias("edit_no"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"),
        F.when(F.col("p_type") == "PROMO", "delete").otherwise("save").alias("action"),
        F.when(F.col("p_type") == "LARGE", "wrong").otherwise("verified").alias("status"),
        F.concat(F.lit("Edited "), "p_brand").alias("entity"), F.lit(" ").alias("parent_group"), F.lit("type").alias("entity_type"),
        F.lit(None).cast("string").alias("domain"), F.col("p_type").alias("note"))
    out, _ = apply_overrides(t.entities, edits, [F.desc("edit_no")])
    return out


@query("patch_update", """
    select c_custkey as id, case when c_nationkey < 5 then case when c_mktsegment = 'BUILDING' then null else 'P ' || c_mktsegment end
        else c_name end as name,
      case when c_nationkey < 5 and c_acctbal > 0 then 'moved' else c_mktsegment end as segment from customer""")
def patch_update(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    name = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.concat(F.lit(" P "), "c_mktsegment"))
    changes = F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("name"), name, F.lit("segment"), F.lit("moved"))).otherwise(
        F.create_map(F.lit("name"), name))
    patches = t.customer.filter("c_nationkey < 5").select(F.col("c_custkey").alias("id"), changes.alias("changes"))
    out, _ = apply_patches(rows, patches, "id", ["name", "segment"])
    return out


# Stored documents and a rebuild of them: some languages are gone, some titles, bodies or metadata changed.
_OLD_DOCS = """select id, kind, title, body, metadata, md5(title || chr(10) || body) as content_hash, title as embedding
    from docs where kind <> 'src1'"""
_NEW_DOCS = """select id, kind, case kind when 'src2' then '' else title end as title,
    case kind when 'src3' then body || '!' else body end as body, case kind when 'src4' then '{{}}' else metadata end as metadata
    from docs where kind not in ('src5', 'src6')"""
_CHANGES = f"""
    with o as ({_OLD_DOCS}), raw as ({_NEW_DOCS.replace('{{}}', '{}')}),
    n as (select id, kind, coalesce(nullif(title, ''), '(unnamed)') as title, body, metadata,
      md5(coalesce(nullif(title, ''), '(unnamed)') || chr(10) || body) as content_hash from raw),
    sides as (select coalesce(o.id, n.id) as id, o.id as oid, n.id as nid, o.kind as okind, o.content_hash as oh,
        n.content_hash as nh, o.metadata as om, n.metadata as nm, o.embedding as oe, n.kind as nkind, o.title as ot, n.title as nt
      from o full join n on o.id = n.id),
    marked as (select *, case when oid is null then 'insert' when nid is null then case when okind = 'src6' then 'protected'
        else 'delete' end when oh = nh and om = nm then 'unchanged' else 'update' end as change from sides)"""


def _stored_docs(t):
    docs = t.docs.filter(F.col("kind") != "src1")
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return finish_documents(docs).withColumn("embedding", F.array(F.length("title").cast("float"))) \
        .withColumn("updated_at", moment).withColumn("embedded_at", moment)


def _rebuilt_docs(t):
    docs = t.docs.filter(~F.col("kind").isin("src5", "src6"))
    kind = F.col("kind")
    return finish_documents(
        docs.withColumn("title", F.when(kind == "src2", "").otherwise(F.col("title")))
        .withColumn("body", F.when(kind == "src3", F.concat("body", F.lit("!"))).otherwise(F.col("body")))
        .withColumn("metadata", F.when(kind == "src4", "{}").otherwise(F.col("metadata"))))


@query("snapshot_diff", _CHANGES + """
    select id, case when change in ('unchanged', 'protected') then okind else nkind end as kind,
      case when change in ('unchanged', 'protected') then ot else nt end as title,
      case when change in ('unchanged', 'protected') then oh else nh end as content_hash,
      change in ('unchanged', 'protected') or (oh is not null and oh = nh) as has_embedding,
      case when change in ('unchanged', 'protected') then '2024-01-01 00:00:00' else '2024-01-31 00:00:00' end as updated_at
    from marked where change <> 'delete'""")
def snapshot_diff(t):
    state, _ = merge_documents(_stored_docs(t), _rebuilt_docs(t), F.lit(AS_OF).cast("timestamp"), ["src6"])
    return state.select(
        "id", "kind", "title", "content_hash", F.col("embedding").isNotNull().alias("has_embedding"), "updated_at")


@query("snapshot_diff_counts", _CHANGES + " select change, count(*) as documents from marked group by change")
def snapshot_diff_counts(t):
    return classify_documents(_stored_docs(t), _rebuilt_docs(t), ["src6"]).groupBy("change").agg(
        F.count(F.lit(1)).alias("documents"))


@query("vector_projection", """
    select 'doc' || doc_id::varchar as id, source as kind, round(embedding[1]::double, 5) as first_value from documents
    join embeddings on vec_id = doc_id""")
def vector_projection(t):
    docs = t.docs.join(
        t.embeddings.select(F.concat(F.lit("doc"), F.col("vec_id").cast("string")).alias("id"), "embedding"), "id", "left")
    return vector_table(docs).select("id", "kind", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first_value"))


@query("bounded_result", """
    select o_orderkey, o_totalprice, (select count(*) from orders) > 500 as truncated from orders
    order by o_totalprice desc, o_orderkey limit 500""")
def bounded_result(t):
    return bounded(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), oldest("o_orderkey")], 500)

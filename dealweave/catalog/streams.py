"""Streaming jobs over the driver's files, compared with the batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from dealweave.catalog.base import Tables, query, ts
from dealweave.catalog.rowsets import as_of
from dealweave.operators.merge import finish_documents, vector_table
from dealweave.session import shared_folder
from dealweave.streaming import jobs
from dealweave.streaming.quota import run_usage_steps


def streamed(t: Tables, table: str) -> Tables:
    """The same views with one table read as a stream, whether it is one file or a folder of files."""
    batch = t.spark.read.parquet(f"{t.folder}/{table}.parquet")
    # A pattern of one name: a plain path to a file would be taken for a folder.
    stream = jobs.file_stream(t.spark, f"{t.folder}/{{{table}.parquet}}", batch.schema)
    out = Tables(t.spark, t.folder)
    times = {f.name: F.col(f.name).cast("timestamp") for f in batch.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    out._known[table] = stream.withColumns(times) if times else stream
    return out


_NEW = """select id, kind, title, case when kind = 'src3' then body || '!' else body end as body, metadata from docs where kind <> 'src5'"""


@query("stream_doc_merge", f"""
    with o as (select id, kind, title, body, md5(title || chr(10) || body) as h from docs where kind not in ('src1', 'src2')), n as ({_NEW})
    select coalesce(n.id, o.id) as id, coalesce(n.kind, o.kind) as kind, md5(coalesce(n.title, o.title) || chr(10) || coalesce(n.body, o.body)) as content_hash,
      o.id is not null and (n.id is null or o.body = n.body) as has_vector from n full join o on o.id = n.id""")
def stream_doc_merge(t):
    """Stored documents meet a stream that brings new ones and changed texts; vectors of changed texts go."""
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    stored = finish_documents(t.docs.filter(~F.col("kind").isin("src1", "src2"))).withColumn(
        "embedding", F.array(F.lit(1.0).cast("float"))).withColumn("updated_at", moment).withColumn("embedded_at", moment)
    arriving = streamed(t, "documents").docs.filter("kind <> 'src5'").withColumn(
        "body", F.when(F.col("kind") == "src3", F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    state = jobs.stream_merge(arriving, stored, shared_folder(t.spark), as_of())
    vectors = vector_table(state).select("id", F.lit(True).alias("v"))
    return state.join(vectors, "id", "left").select(
        "id", "kind", "content_hash", F.coalesce("v", F.lit(False)).alias("has_vector"))


@query("stream_embed_pending", """
    select 'doc' || doc_id::varchar as id, source as kind, 64::bigint as dimensions, '2024-01-31 00:00:00' as embedded_at from documents""")
def stream_embed_pending(t):
    docs = streamed(t, "documents").docs.select(
        "id", "kind", "title", "body", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("timestamp").alias("embedded_at"))
    done = jobs.stream_embed(docs, shared_folder(t.spark), as_of())
    return done.select("id", "kind", F.size("embedding").alias("dimensions"), "embedded_at")


@query("stream_usage_24h", f"""
    select {ts('w')} as window_start, {ts('w + interval 24 hour')} as window_end, user_email as client, count(*) as used
    from (select user_email, unnest(generate_series(date_trunc('hour', created_at) - interval 23 hour, date_trunc('hour', created_at), interval 1 hour)) as w
      from log where error is null) group by w, user_email""")
def stream_usage_24h(t):
    return jobs.rolling_usage(streamed(t, "events").log, shared_folder(t.spark))


@query("stream_usage_steps", f"""
    with u as (select user_email as client, date_trunc('second', created_at) as s, created_at from log where error is null and user_email is not null),
    moves as (select client, s as moment, 1 as n from u union all select client, s + interval 24 hour, -1 from u),
    net as (select client, moment, sum(n) as n from moves group by 1, 2),
    total as (select client, moment, sum(n) over (partition by client order by moment) as used from net)
    select client, {ts('moment')} as "at", used::bigint as used from total
    where moment < (select max(created_at) from u) - interval 3600500 millisecond""")
def stream_usage_steps(t):
    """Uses of the last 24 hours to the second, as far as the watermark has come."""
    return run_usage_steps(streamed(t, "events").log, shared_folder(t.spark))


@query("stream_daily_kpis", f"""
    select {ts("date_trunc('day', created_at)")} as day, count(*) filter (where error is null) as answered, count(*) filter (where error is not null) as failed,
      count(*) filter (where rating = 1) as up, count(*) filter (where rating = -1) as down from log group by 1""")
def stream_daily_kpis(t):
    return jobs.updated_result(jobs.daily_kpis(streamed(t, "events").log), shared_folder(t.spark), ["day"])


@query("stream_dedupe_queries", "select distinct lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) as q from log")
def stream_dedupe_queries(t):
    return jobs.appended_result(jobs.distinct_queries(streamed(t, "events").log).select("q"), shared_folder(t.spark))

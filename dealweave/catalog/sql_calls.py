"""The library's functions as they are called from SQL."""

from __future__ import annotations

from dealweave.catalog.base import AS_OF, CHECKS, chunks_of, nk, query
from dealweave.sql_functions import register, register_queue


@query("sql_name_key", f"""
    select id, {nk('deal')} as key, {nk("company")} as company_key from (
      select id, deal, deal || ' Technologies Pvt Ltd' as company from deals)""")
def sql_name_key(t):
    register(t.spark)
    return t.spark.sql(
        "select id, name_key(deal) as key, name_key(deal || ' Technologies Pvt Ltd') as company_key from {deals}", deals=t.deals)


@query("sql_document_chunks", f"with recursive {chunks_of('select doc_id as id, text as txt, 1600 as size from documents').strip()}" + """
    select id as doc_id, part::bigint as part, chunk from cut""")
def sql_document_chunks(t):
    register(t.spark)
    return t.spark.sql(
        "select doc_id, part, chunk from document_chunks(TABLE(select doc_id, text from {docs}), 1600)", docs=t.documents)


@query("sql_fetch_queue")
def sql_fetch_queue(t):
    t.deals.createOrReplaceTempView("deals")
    t.content.createOrReplaceTempView("content")
    register_queue(t.spark)
    return t.spark.sql(f"select * from fetch_queue(timestamp '{AS_OF}', 9000, 50)")


CHECKS["sql_fetch_queue"] = CHECKS["work_queue"]

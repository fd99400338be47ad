"""Functions to call from SQL: ``register(spark)`` makes them known to the session.

* ``name_key(text)``, ``profile_slug(text)``, ``title_part(text)``, ``company_part(text)`` are SQL expressions, which the
  optimiser puts in place of the call;
* ``document_chunks(TABLE(...), size)`` cuts the ``text`` of each row of a table and passes its other columns on;
* ``fetch_queue(as_of, days, n)`` reads the views ``deals`` and ``content`` (``register_queue`` once these exist).
"""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from dealweave.functions.text import LEGAL_SUFFIXES, WEB_SUFFIXES
from dealweave.operators.chunks import chunk_text

_ENTRY = "trim(entry)"
_SCALARS = {
    "name_key(name STRING)": rf"""nullif(regexp_replace(regexp_replace(regexp_replace(
        replace(lower(trim(coalesce(name, ''))), '&', 'and'), r'\.({'|'.join(WEB_SUFFIXES)})\z', ''),
        '[^a-z0-9]', ''), r'({'|'.join(LEGAL_SUFFIXES)})\z', ''), '')""",
    "profile_slug(link STRING)": r"lower(nullif(regexp_extract(link, r'(?i)linkedin\.com/in/([^/?#]+)', 1), ''))",
    "title_part(entry STRING)": rf"if(contains({_ENTRY}, ' - '), trim(regexp_extract({_ENTRY}, r'(?s)^(.*) - .*\z', 1)), null)",
    "company_part(entry STRING)": rf"if(contains({_ENTRY}, ' - '), trim(regexp_extract({_ENTRY}, r'(?s)^.* - (.*)\z', 1)), {_ENTRY})",
}


class DocumentChunks:
    """Numbered pieces of each row's ``text``; a null text has none. The schema follows the table handed over."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("document_chunks takes a table: document_chunks(TABLE(SELECT ...), 1600)")
        names = [f.name for f in rows.dataType.fields]
        if "text" not in names or {"part", "chunk"} & {n.lower() for n in names}:
            raise ValueError("the table needs a column text, and none named part or chunk")
        kept = [f for f in rows.dataType.fields if f.name != "text"]
        return AnalyzeResult(T.StructType(
            [*kept, T.StructField("part", T.IntegerType()), T.StructField("chunk", T.StringType())]))

    def eval(self, rows: Row, size: int):
        text = rows["text"]
        if text is None:
            return
        kept = [v for n, v in rows.asDict().items() if n != "text"]
        for i, piece in enumerate(chunk_text(text, size), 1):
            yield (*kept, i, piece)


def register(spark: SparkSession) -> None:
    """Scalar functions and ``document_chunks``."""
    for signature, body in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
    spark.udtf.register("document_chunks", udtf(DocumentChunks, useArrow=True))


def register_queue(spark: SparkSession) -> None:
    """``fetch_queue(as_of, days, n)``: the n newest items never fetched and the n newest recent ones with an old copy."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION fetch_queue(as_of TIMESTAMP, days INT, n INT)
        RETURNS TABLE (id STRING, deal STRING, url STRING, reason STRING) RETURN
        WITH judged AS (
          SELECT d.id, d.deal, d.url, d.created_time, if(c.page_id IS NULL, 'new', 'refresh') AS reason
          FROM deals d LEFT JOIN content c ON c.page_id = d.id
          WHERE c.page_id IS NULL OR (
            greatest(d.created_time, CAST(d.meeting_date AS TIMESTAMP)) > fetch_queue.as_of - make_dt_interval(fetch_queue.days)
            AND c.fetched_at < fetch_queue.as_of - INTERVAL '20' HOUR)),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY reason ORDER BY created_time DESC NULLS LAST, id) AS place FROM judged)
        SELECT id, deal, url, reason FROM ranked WHERE place <= fetch_queue.n""")

"""Functions called from SQL give what the column helpers give."""

import pytest
from pyspark.sql import functions as F

from dealweave.functions.text import company_part, name_key, profile_slug, title_part
from dealweave.operators.chunks import chunk_text
from dealweave.sql_functions import register

TEXTS = [None, "", "  ", "Swift.AI", "A & B Pvt Ltd", "swift labs\n", "x.io\n", "CEO - Swift - Labs", " - ", "Solo", "Éa.co",
         "https://LinkedIn.com/in/Ann-B/?x", "linkedin.com/company/x", "CTO\nnow - Amber"]


def test_scalars(spark):
    register(spark)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    calls = df.selectExpr("name_key(t) a", "profile_slug(t) b", "title_part(t) c", "company_part(t) d")
    helpers = df.select(name_key("t").alias("a"), profile_slug("t").alias("b"), title_part("t").alias("c"), company_part("t").alias("d"))
    assert calls.collect() == helpers.collect()
    assert "PythonUDF" not in calls._jdf.queryExecution().toString()


def test_chunks_of_a_table(spark):
    register(spark)
    long = "One. Two three! " * 40
    docs = spark.createDataFrame([(1, long, "x"), (2, None, "y"), (3, "", "z"), (4, "short", None)], "id int, text string, tag string")
    got = spark.sql("select * from document_chunks(TABLE({d}), 100)", d=docs)
    assert got.columns == ["id", "tag", "part", "chunk"]
    assert [r.chunk for r in got.filter("id = 1").orderBy("part").collect()] == list(chunk_text(long, 100))
    assert {(r.id, r.tag, r.chunk) for r in got.filter("id > 1").collect()} == {(4, None, "short")}
    split = spark.sql("select id, max(part) n from document_chunks(TABLE({d}) PARTITION BY (tag), 100) group by id", d=docs)
    assert {r.id: r.n for r in split.collect()} == {1: len(list(chunk_text(long, 100))), 4: 1}
    with pytest.raises(Exception, match="column text"):
        spark.sql("select * from document_chunks(TABLE({d}), 100)", d=docs.withColumn("part", F.lit(1))).collect()

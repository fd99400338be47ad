"""The training-data pipeline: documents in, token counts and digests of the kept texts out.

Stages, each over all documents its predecessor kept:

* quality: documents that the fertility rules reject go;
* line_dedup: lines found in ten documents or more go, the documents stay with what is left of their text;
* near_dedup: the document with the smallest id of each component of near copies (SimHash fingerprints of four-word
  shingles, four differing bits at most) stays;
* decontaminate: documents that hold a twentieth or more of benchmark words go;
* encode: byte-level BPE token counts, ids and digests.

Nulls, empty texts, ties and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.llm import byte_bpe, decontaminate, line_runs, quality, simhash
from dealweave.llm.common import stored

#: Words of a shingle of the near-duplicate stage; links are fingerprints within ``simhash.MAX_BITS`` bits.
SHINGLE = 4


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fertility rules."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share; ``n_chars`` follows the text."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    kept = line_runs.drop_common_lines(docs.select(*names))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("text", F.col("kept_text")).select(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return simhash.keep_one(docs, size=SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, ids and digests of every document left."""
    return byte_bpe.encode_texts(docs, keep=["doc_id", "lang", "source", "n_chars"]).select(
        "doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontaminate", decontamination), ("encode", encode),
]
#: The fertility of a tokeniser is not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

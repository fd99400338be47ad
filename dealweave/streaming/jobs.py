"""Structured Streaming jobs over arriving files. Each ends when its input is used up (``availableNow``).

Results are written by ``foreachBatch`` to a table on shared storage; nothing is gathered in the driver. A batch that
is run again after a failure writes the same table of its batch number, so the result does not change.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from dealweave.functions.text import query_text_key
from dealweave.operators.merge import classify_documents, finish_documents, merge_documents
from dealweave.operators.rows import first_per_group
from dealweave.plans.search import Embedder, embed_pending, hashed_words
from dealweave.session import list_paths
from dealweave.streaming.log_table import LogTable

WATERMARK = "1 hour"
#: Hours of a window of the rolling usage.
USAGE_HOURS = 24
DEDUPE_HORIZON = "30 days"


def file_stream(spark: SparkSession, folder: str, schema: StructType, glob: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str,
               mode: str = "append") -> None:
    """Process everything that is there, then stop; an error of the stream is raised here."""
    query = stream.writeStream.outputMode(mode).foreachBatch(on_batch).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def written(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """What the batches wrote below a folder; no rows if nothing has arrived so far."""
    if not list_paths(spark, f"{folder}/*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


def stream_merge(arriving: DataFrame, target: DataFrame, folder: str, as_of: Column) -> DataFrame:
    """Arriving documents merged into the stored ones; a batch reads the rows of its ids and writes those that change.

    ``arriving``: id, kind, title, body, metadata. Within a batch the longest text of an id wins. Run again on the
    same folder, the job takes up the stored state; ``target`` then is not read.
    """
    table = LogTable(target.sparkSession, f"{folder}/documents", target.schema)
    table.start(target)

    def merge(batch: DataFrame, number: int) -> None:
        new = finish_documents(first_per_group(
            batch, ["id"], [F.desc(F.length("body")), F.col("title"), F.xxhash64(*batch.columns)])).persist()
        old = table.before(number, new)
        state, _ = merge_documents(old, new, as_of)
        same = classify_documents(old, new).filter("change = 'unchanged'").select("id")
        table.write(state.join(new.select("id"), "id", "left_semi").join(same, "id", "left_anti"), number)
        table.compact_if_due(number)
        new.unpersist()

    run_to_end(arriving, merge, f"{folder}/checkpoint")
    return table.current()


def stream_embed(arriving: DataFrame, folder: str, as_of: Column, embedder: Embedder = hashed_words) -> DataFrame:
    """Arriving documents with their embeddings filled, one directory per batch."""
    spark, out = arriving.sparkSession, f"{folder}/embedded"
    schema = arriving.schema

    def embed(batch: DataFrame, number: int) -> None:
        embed_pending(batch, as_of, embedder).write.mode("overwrite").parquet(f"{out}/batch={number}")

    run_to_end(arriving, embed, f"{folder}/checkpoint")
    return written(spark, out, schema)


def hourly_usage(log: DataFrame, user: str = "user_email") -> DataFrame:
    """Successful uses per user and hour. An hour is held until the last of the windows it counts in has closed."""
    return (
        log.withWatermark("created_at", f"{USAGE_HOURS} hours").filter(F.col("error").isNull())
        .groupBy(F.window("created_at", "1 hour"), F.col(user).alias("client")).agg(F.count(F.lit(1)).alias("used"))
        .select(F.col("window.start").alias("hour"), "client", "used")
    )


def usage_windows(hourly: DataFrame) -> DataFrame:
    """Uses per user in every window of 24 hours, moved by the hour, from the uses per hour.

    The hours are dealt by user before each is copied into its windows, so the copies are not shuffled. The number of
    shares is given, since the rows are few only before they are copied.
    """
    shares = int(hourly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.col("hour") - F.expr(f"interval '{USAGE_HOURS - 1}' hour")
    starts = F.sequence(first, F.col("hour"), F.expr("interval '1' hour"))
    counted = hourly.repartition(shares, "client").select("client", F.explode(starts).alias("window_start"), "used") \
        .groupBy("client", "window_start").agg(F.sum("used").alias("used"))
    return counted.select(
        "window_start", (F.col("window_start") + F.expr(f"interval '{USAGE_HOURS}' hour")).alias("window_end"), "client", "used")


def rolling_usage(log: DataFrame, folder: str, user: str = "user_email") -> DataFrame:
    """Successful uses per user in every window of the last 24 hours, moved by the hour.

    The stream keeps one count per user and hour instead of one per window. A late row counts in all of its windows as
    long as the newest of them is open.
    """
    return usage_windows(updated_result(hourly_usage(log, user), folder, ["hour", "client"]))


def daily_kpis(log: DataFrame) -> DataFrame:
    """Counts by outcome per day."""
    return (
        log.withWatermark("created_at", WATERMARK).groupBy(F.window("created_at", "1 day")).agg(
            F.count_if(F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"),
            F.count_if(F.col("rating") == 1).alias("up"), F.count_if(F.col("rating") == -1).alias("down"))
        .select(F.col("window.start").alias("day"), "answered", "failed", "up", "down")
    )


def updated_result(aggregated: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregated stream to its end in update mode and return the newest row of every key.

    Each batch writes the windows it changed to a folder of its number, so a repeated batch replaces its own rows, and
    the state of windows that the watermark has closed is let go.
    """
    spark, out = aggregated.sparkSession, f"{folder}/result"

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part-{number}")

    run_to_end(aggregated, add, f"{folder}/checkpoint", "update")
    schema = StructType([*aggregated.schema.fields, StructField("_batch", IntegerType())])
    return first_per_group(written(spark, out, schema), keys, [F.desc("_batch")]).drop("_batch")


def appended_result(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to its end in append mode and return the rows it let go."""
    spark, out = stream.sparkSession, f"{folder}/result"

    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part-{number}")

    run_to_end(stream, add, f"{folder}/checkpoint")
    return written(spark, out, stream.schema)


def distinct_queries(queries: DataFrame, text: str = "question", horizon: str = DEDUPE_HORIZON) -> DataFrame:
    """Each normalised question once within the horizon."""
    return queries.withColumn("q", query_text_key(text)).withWatermark("created_at", horizon) \
        .dropDuplicatesWithinWatermark(["q"])

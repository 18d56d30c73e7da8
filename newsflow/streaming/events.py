"""Streams: daily batches merged into a master, and windows over an event stream. The same functions serve a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import articles as ar
from ..sources.files import scratch


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, users and value by window and type. On a stream, events later than the watermark are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return (
        rows.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users_about"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "events", "users_about", "total")
    )


def unique_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder as a stream, with the schema of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def run_to_table(stream: DataFrame, mode: str = "complete", tag: str = "stream") -> DataFrame:
    """Runs a stream over all that is there, then reads its result. Offsets and state lie in the shared folder.

    A batch that is run again after a failure overwrites its own output, so it counts once.
    """
    spark = stream.sparkSession
    path = scratch(spark, tag)

    def save(batch: DataFrame, number: int) -> None:
        target = f"{path}/out" if mode == "complete" else f"{path}/out/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def merge_stream(incoming: DataFrame, path: str, order: str = "ord") -> None:
    """Adds the new urls of every micro-batch to the master at `path`, a folder of its own for each batch.

    New means: in no earlier batch. A batch that is run again overwrites its own folder and does not see it.
    """
    spark = incoming.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        known = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).option("basePath", f"{path}/master").parquet(f"{path}/master") if number else batch.limit(0).withColumn("batch", F.lit(0))
        ar.new_rows(batch, known.where(F.col("batch") < number)).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/master/batch={number}")

    incoming.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()

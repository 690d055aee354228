"""File-based streams: ingest that ends when the files are read, windows with watermarks, job state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.scratch import scratch


def drained(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all files there are now and reads its result; state and output lie in the shared folder."""
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str, files_a_trigger: int = 4) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # as a pattern the path may name a file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{sf_dir}/event[s].parquet")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type; with a watermark, so state stays bounded."""
    w = F.window("at", width)
    found = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(w, "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")

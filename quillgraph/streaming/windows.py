"""Windows over the event stream: tumbling counts, debounced sessions, deduplication."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import delete_at_exit, shared_dir


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c.split(".")[-1])


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result as a table.

    In complete mode the last batch is the result, in append mode all batches are. Batches are written
    under their number, so a batch that is run again replaces itself.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(sink).trigger(availableNow=True).start()
    q.awaitTermination()
    delete_at_exit(spark, base)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def tumbling(stream: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) of fixed windows."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(_stamp("w.start"), "event_type", "n", F.round("total", 4).alias("total"))


def debounced(stream: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """(user_id, start, last, n): bursts of a user's events that a quiet ``gap`` ends; ``last`` is the event before the gap."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return w.select("user_id", _stamp("w.start"), _stamp("last"), "n")


def deduplicated(stream: DataFrame, late: str = "60 days") -> DataFrame:
    """(user_id, event_type): first sightings."""
    return stream.withWatermark("ts", late).select("ts", "user_id", "event_type").dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type")

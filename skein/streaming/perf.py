"""Load-test results as a stream: an addition of this engine's own.

Request rows that land in a folder are aggregated in event-time windows with a
watermark and upserted as samples, batch by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

REQUESTS = "endpoint_fqn string, ts timestamp, elapsed_ms double"


def windowed_samples(requests: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """endpoint_fqn, start, end, n, p50_ms, p99_ms, rps for each window; requests: (endpoint_fqn, ts, elapsed_ms).

    Percentiles are approximate: a stream keeps sketches, not all values.
    """
    rows = requests.filter("endpoint_fqn <> '' and ts is not null").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", window).alias("w"), "endpoint_fqn").agg(
        F.count("*").alias("n"), F.percentile_approx("elapsed_ms", 0.5, 10_000).alias("p50_ms"), F.percentile_approx("elapsed_ms", 0.99, 10_000).alias("p99_ms"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return out.select("endpoint_fqn", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "p50_ms", "p99_ms", (F.col("n") / seconds).alias("rps"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n of sessions that a gap ends; events: (user_id, ts)."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def ingest_folder(spark: SparkSession, folder: str, out: str, checkpoint: str, window: str = "1 minute", late: str = "5 minutes") -> StreamingQuery:
    """Reads JSON request rows that land in folder; closed windows are appended to Parquet at out, each once."""
    stream = spark.readStream.schema(REQUESTS).json(folder)
    return (windowed_samples(stream, window, late).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())

"""Streams of events: windowed counts, dedup within a watermark, and sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 4) -> DataFrame:
    """Micro-batches of a few files each."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def unique_events(stream: DataFrame, within: str = "1 hour") -> DataFrame:
    """Events without repeats that come within the watermark; state is bounded by it."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Run a stream over what is there now; its last state, or all it appended, as a table."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'all' if mode == 'complete' else f'batch={number}'}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/all" if mode == "complete" else folder)


def _folder(spark: SparkSession) -> str:
    import tempfile

    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{home}/stream-{uuid.uuid4().hex}"


@query("stream_daily_counts", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01, STR-05's neighbour: tumbling windows over the event stream, complete output."""
    got = drain(daily_counts(read_events(spark, f"{sf_dir}/events*.parquet")), _folder(spark), "complete")
    return got.select(F.col("w.start").alias("day"), "event_type", "n", F.round("v", 4).alias("total"))


@query("stream_unique_events", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_unique_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-02, SRC-26: dedup within a watermark, appended."""
    stream = read_events(spark, f"{sf_dir}/events*.parquet")
    return drain(unique_events(stream, "60 days").select("event_type", "event_id"), _folder(spark), "append").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, s
""")  # fmt: skip
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: sessions with a gap of two hours, complete output."""
    got = drain(sessions(read_events(spark, f"{sf_dir}/events*.parquet")), _folder(spark), "complete")
    return got.select("user_id", F.col("w.start").alias("began"), "n")

"""Streaming forms of the log reports: each takes a streaming (or batch) frame and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_kpis(audit: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Counts per window and action; ``slide`` makes trailing windows. The watermark drops what comes later than ``late``."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return audit.withWatermark("ts", late).groupBy(w, "action").agg(F.count("*").alias("n"), F.avg("rank").alias("avg_rank")).select(F.col("window.start").alias("start"), "action", "n", "avg_rank")


def attributed_clicks(searches: DataFrame, clicks: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Clicks with every search of the same actor up to ``within`` before; state is bounded by both watermarks."""
    s = searches.select(F.col("event_id").alias("search_event_id"), F.col("actor").alias("s_actor"), F.col("ts").alias("s_ts")).withWatermark("s_ts", late)
    c = clicks.select("event_id", "actor", "ts").withWatermark("ts", late)
    return c.join(s, F.expr(f"actor = s_actor AND s_ts <= ts AND s_ts >= ts - interval {within}")).select("event_id", "search_event_id", "actor")


def zero_result_alerts(log: DataFrame, least: int, window: str = "1 day", late: str = "1 day") -> DataFrame:
    return log.where("result_count = 0").withWatermark("ts", late).groupBy(F.window("ts", window), "query").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("window.start").alias("start"), "query", "n")


def closed_alerts(log: DataFrame, least: int, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Alerts in append mode: the watermark follows all rows of the log, so that a day without empty results closes the days before it too."""
    empty = F.sum(F.when(F.col("result_count") == 0, 1).otherwise(0))
    counted = log.withWatermark("ts", late).groupBy(F.window("ts", window), "query").agg(empty.alias("n"))
    return counted.where(F.col("n") >= least).select(F.col("window.start").alias("start"), "query", "n")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def feedback_counts(audit: DataFrame) -> DataFrame:
    """Running feedback counts per query, for update mode."""
    return audit.where("action = 'feedback_submitted'").groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))


def backfill(stream: DataFrame, path: str, spec: str, checkpoint: str, embed) -> None:
    """Append rows of the stream, embedded under ``spec``, that ``path`` doesn't hold under it yet; a repeated batch adds nothing."""

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            have = spark.read.parquet(path).where(F.col("spec") == spec).select("id")
            batch = batch.join(have, "id", "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        embed(batch).withColumn("spec", F.lit(spec)).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

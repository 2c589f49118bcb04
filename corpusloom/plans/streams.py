"""Queries: the streaming operators, run to the end of the tables with availableNow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C
from corpusloom.sources.scratch import new_folder
from corpusloom.streaming import late, logs


def _glob(path: str) -> str:
    """A pattern for the table's path, as a stream may read a single file by pattern only."""
    return path.removesuffix("t") + "[t]"


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream of its files."""
    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(_glob(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that a stream yields until its input ends, from a table in the shared folder.

    A row of a key may appear again in update mode; the caller keeps the last.
    """
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else stream.withColumn("epoch", F.lit(0).cast("long")).schema).parquet(f"{base}/out")


def _audit(e: DataFrame) -> DataFrame:
    action = F.when(F.col("event_type") == "view", "sop_search").when(F.col("event_type") == "click", "search_result_click").when(F.col("event_type") == "purchase", "quick_answer_open").otherwise("feedback_submitted")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.where("event_type <> 'error'").select("event_id", "ts", F.col("user_id").alias("actor"), action.alias("action"), k.alias("rank"), F.concat(F.lit("q"), k.cast("string")).alias("query"))


@query("t1_windowed_kpis", using("kb_audit", "SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, action, count(*) AS n, round(avg(rank), 6) AS avg_rank FROM kb_audit GROUP BY ALL"))
def t1(spark, d):
    out = drained(logs.windowed_kpis(_audit(events_stream(spark, d)), late="3650 days"), "complete")
    return out.where(F.col("epoch") == out.agg(F.max("epoch")).first()[0]).select(F.unix_micros("start").alias("start_us"), "action", "n", F.round("avg_rank", 6).alias("avg_rank"))


@query("t2_click_stream_join", using("kb_audit", "SELECT c.event_id, s.event_id AS search_event_id, c.actor FROM kb_audit c JOIN kb_audit s ON c.actor = s.actor AND s.ts <= c.ts AND s.ts >= c.ts - INTERVAL 1 HOUR WHERE c.action = 'search_result_click' AND s.action = 'sop_search'"))
def t2(spark, d):
    a = _audit(events_stream(spark, d))
    b = _audit(events_stream(spark, d))
    return drained(logs.attributed_clicks(a.where("action = 'sop_search'"), b.where("action = 'search_result_click'")))


@query("t3_zero_result_alerts", using("kb_log", "SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, query, count(*) AS n FROM kb_log WHERE result_count = 0 GROUP BY ALL HAVING count(*) >= 2"))
def t3(spark, d):
    e = events_stream(spark, d).where("event_type in ('view', 'click', 'purchase', 'error')")
    k = F.get_json_object("props", "$.k").cast("int")
    log = e.select("ts", F.concat(F.lit("q"), k.cast("string")).alias("query"), F.when(F.col("event_type") == "error", 0).otherwise(k % 7).alias("result_count"))
    out = drained(logs.zero_result_alerts(log, 2, late="3650 days"), "complete")
    return out.where(F.col("epoch") == out.agg(F.max("epoch")).first()[0]).select(F.unix_micros("start").alias("start_us"), "query", "n")


@query("t5_embedding_backfill_stream", "SELECT vec_id AS id, 'm:64' AS spec, label AS embedded FROM embeddings")
def t5(spark, d):
    path = f"{d}/embeddings.parquet"
    base = new_folder(spark, "stream")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(_glob(path)).select(F.col("vec_id").alias("id"), "label")
    for run in range(2):  # the second run finds every row done
        logs.backfill(stream, f"{base}/rows", "m:64", f"{base}/state-{run}", lambda b: b.withColumnRenamed("label", "embedded"))
    return spark.read.parquet(f"{base}/rows").select("id", "spec", "embedded")


@query("t6_feedback_counts_stream", using("kb_audit", "SELECT query, count(*) AS n FROM kb_audit WHERE action = 'feedback_submitted' GROUP BY 1"))
def t6(spark, d):
    out = drained(logs.feedback_counts(_audit(events_stream(spark, d))), "update")
    return out.groupBy("query").agg(F.max_by("n", "epoch").alias("n"))


LATE = "2 days"
ARRIVALS = 3
FED = """, a AS (SELECT *, least((day(ts) - 1) // 10 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END, 2) AS arrival FROM kb_audit),
m AS (SELECT arrival, max(ts) AS newest FROM a GROUP BY 1), lim AS (SELECT x.arrival, max(m.newest) - INTERVAL 2 DAY AS lim FROM m x LEFT JOIN m ON m.arrival < x.arrival GROUP BY 1),
f AS (SELECT a.*, ts IS NULL OR coalesce(ts < lim, false) AS aside FROM a JOIN lim USING (arrival)), o AS (SELECT * FROM f WHERE NOT aside),
e AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS closed FROM o)
"""


def _fed(spark: SparkSession, d: str, consumers: dict[str, late.Consumer]) -> tuple[str, DataFrame]:
    """The audit log as a feed of three deliveries, each taken when it arrives; every seventh event comes one delivery late. Returns the folder and all rows."""
    base = new_folder(spark, "feed")
    events = C.audit(spark, d)
    arrival = F.least(F.floor((F.dayofmonth("ts") - 1) / 10) + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0), F.lit(ARRIVALS - 1))
    for k in range(ARRIVALS):
        events.where(F.coalesce(arrival, F.lit(0)) == k).write.mode("append").parquet(f"{base}/in")
        late.drain(spark.readStream.schema(events.schema).parquet(f"{base}/in"), base, LATE, consumers)
    return base, late.rows(spark, base, events.schema)


def _closed(spark: SparkSession, d: str, name: str, work: late.Consumer) -> DataFrame:
    """What one consumer has given out: the windows that the watermark closed."""
    base, _ = _fed(spark, d, {name: work})
    return spark.read.parquet(f"{base}/{name}")


@query("t1_late_rows", using("kb_audit", FED + "SELECT event_id, arrival AS epoch FROM f WHERE aside"))
def t1_late_rows(spark, d):
    """Rows that came after their watermark, with the batch that brought them."""
    return _fed(spark, d, {})[1].where("aside__").select("event_id", "epoch")


@query("t1_closed_windows", using("kb_audit", FED + "SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, action, count(*) AS n, round(avg(rank), 6) AS avg_rank FROM o, e WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= closed GROUP BY ALL"))
def t1_closed_windows(spark, d):
    """Days that the watermark closed, without the late rows."""
    out = _closed(spark, d, "daily", lambda s: logs.windowed_kpis(s, late=LATE))
    return out.select(F.unix_micros("start").alias("start_us"), "action", "n", F.round("avg_rank", 6).alias("avg_rank"))


@query("t1_trailing_windows", using("kb_audit", FED + ", w AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS start, action FROM o, range(7) r(k)) SELECT CAST(epoch_us(start) AS BIGINT) AS start_us, action, count(*) AS n FROM w, e WHERE start + INTERVAL 7 DAY <= closed GROUP BY ALL"))
def t1_trailing_windows(spark, d):
    """Trailing weeks, one a day, that the watermark closed."""
    return _closed(spark, d, "weekly", lambda s: logs.windowed_kpis(s, "7 days", "1 day", LATE)).select(F.unix_micros("start").alias("start_us"), "action", "n")


@query("t3_closed_alerts", using("kb_audit", FED + "SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS start_us, query, count(*) AS n FROM o, e WHERE rank % 7 = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= closed GROUP BY ALL HAVING count(*) >= 2"))
def t3_closed_alerts(spark, d):
    """Queries with two or more empty results on a closed day; the watermark is that of all rows, not of the empty results alone."""
    empty = F.when(F.col("rank") % 7 == 0, 0).otherwise(1)
    return _closed(spark, d, "alerts", lambda s: logs.closed_alerts(s.withColumn("result_count", empty), 2, late=LATE)).select(F.unix_micros("start").alias("start_us"), "query", "n")


@query("t4_session_stream", using("kb_audit", FED + ", g AS (SELECT actor, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY actor ORDER BY ts)), s AS (SELECT actor, ts, sum(new) OVER (PARTITION BY actor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT actor AS user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, count(*) AS n FROM s, e GROUP BY actor, s, closed HAVING max(ts) + INTERVAL 6 HOUR <= closed"))
def t4_session_stream(spark, d):
    """Sessions of a user, ended by six idle hours, that the watermark closed."""
    out = _closed(spark, d, "sessions", lambda s: logs.sessions(s.withColumnRenamed("actor", "user_id"), "6 hours", LATE))
    return out.select("user_id", F.unix_micros("first").alias("first_us"), "n")

"""Reports over search, click, feedback and zero-result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attribute_clicks(audit: DataFrame, width_s: int = 86_400) -> DataFrame:
    """Each click with the latest search of the same actor at or before it (event_id, search_event_id, elapsed_s, rank).

    An as-of join in one window over (actor, time bucket): searches are carried into later buckets as their bucket's last one, so
    a busy actor is spread over buckets and no pair of click and search rows is made.
    """
    rows = audit.where(F.col("action").isin("sop_search", "search_result_click")).select("event_id", "ts", "actor", "action", "rank")
    is_search = F.col("action") == "sop_search"
    bucketed = rows.withColumn("b", F.floor(F.unix_timestamp("ts") / width_s))
    order = F.struct("ts", (~is_search).alias("click"), "event_id")
    inside = Window.partitionBy("actor", "b").orderBy("ts", F.when(is_search, 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(is_search, F.struct("event_id", "ts")), ignorenulls=True)
    ends = bucketed.groupBy("actor", "b").agg(F.max_by(F.when(is_search, F.struct("event_id", "ts")), F.when(is_search, order)).alias("end"))
    before = ends.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("actor").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))).select("actor", "b", "carried")
    found = bucketed.withColumn("own", last.over(inside)).where(~is_search).join(before, ["actor", "b"]).withColumn("s", F.coalesce("own", "carried")).where("s is not null")
    return found.select("event_id", "actor", "rank", F.col("s.event_id").alias("search_event_id"), (F.unix_micros("ts") - F.unix_micros("s.ts")).alias("elapsed_us"))


def ops_kpis(audit: DataFrame, log: DataFrame) -> DataFrame:
    """One row of counts and rates, each log read once."""
    a = audit.agg(F.count_if(F.col("action") == "sop_search").alias("searches"), F.count_if(F.col("action") == "search_result_click").alias("clicks"), F.count_if(F.col("action") == "quick_answer_open").alias("quick_opens"), F.count_if(F.col("action") == "feedback_submitted").alias("feedback"), F.countDistinct("actor").alias("actors"), F.avg(F.when(F.col("action") == "search_result_click", F.col("rank"))).alias("avg_clicked_rank"))
    b = log.agg(F.count("*").alias("retrievals"), F.avg((F.col("result_count") == 0).cast("double")).alias("zero_rate"), F.expr("percentile(latency_ms, 0.5)").alias("median_latency"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def popular_queries(log: DataFrame, limit: int = 6) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).orderBy(F.col("n").desc(), F.col("last_seen").desc(), F.col("query").desc()).limit(limit)


def zero_result_clusters(log: DataFrame, least: int, limit: int, canonical: Column) -> DataFrame:
    """Queries that found nothing at least ``least`` times, with a confidence between .48 and .94."""
    g = log.where("result_count = 0").groupBy("query").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen")).where(F.col("n") >= least)
    confidence = F.least(F.lit(0.94), 0.48 + F.least(F.col("n"), F.lit(10)) * 0.035 + F.when(canonical, 0.2).otherwise(0.0))
    return g.withColumn("confidence", confidence).orderBy(F.col("n").desc(), F.col("query")).limit(limit)


def feedback_queue(events: DataFrame, keys: list[str], newest: int) -> DataFrame:
    """The newest feedback events grouped by what they are about: count, last time, latest comment, severity."""
    recent = events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(newest)
    g = recent.groupBy(*keys).agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"), F.max_by("comment", F.when(F.trim("comment") != "", F.struct("ts", "event_id"))).alias("comment"))
    return g.withColumn("severity", F.when(F.col("n") >= 5, "high").when(F.col("n") >= 2, "medium").otherwise("low"))


def session_rollup(messages: DataFrame, longest: int = 600) -> DataFrame:
    """Per session: messages, turns of the user, and the last characters of its text in order."""
    g = messages.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("seq").alias("last_seq"), F.array_sort(F.collect_list(F.struct("seq", "content"))).alias("m"))
    return g.select("session_id", "n", "user_turns", "last_seq", F.right(F.array_join(F.col("m.content"), " "), F.lit(longest)).alias("summary"))


def recent_turns(messages: DataFrame, n: int) -> DataFrame:
    """The last n user or assistant turns per session, numbered in order."""
    kept = messages.where(F.col("role").isin("user", "assistant"))
    last = kept.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("seq").desc()))).where(F.col("back") <= n)
    return last.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).drop("back")


def follow_up(messages: DataFrame, short: int) -> DataFrame:
    """User turns; a short one is preceded by the two messages before it."""
    w = Window.partitionBy("session_id").orderBy("seq")
    both = messages.withColumn("p1", F.lag("content", 1).over(w)).withColumn("p2", F.lag("content", 2).over(w)).where("role = 'user'")
    return both.select("session_id", "seq", F.when(F.length("content") < short, F.concat_ws(" ", "p2", "p1", "content")).otherwise(F.col("content")).alias("expanded"))


def ranking_eval(golden: DataFrame, ranked: DataFrame, query_id: str, doc_id: str) -> DataFrame:
    """Per query: whether the first, first three and first five hit, precision at 3 and recall at 5."""
    j = golden.groupBy(query_id).agg(F.count("*").alias("wanted")).join(ranked.join(golden.withColumn("hit", F.lit(1)), [query_id, doc_id], "left").groupBy(query_id).agg(*(F.coalesce(F.sum(F.when((F.col("rank") <= k) & (F.col("hit") == 1), 1)), F.lit(0)).alias(f"h{k}") for k in (1, 3, 5))), query_id, "left").fillna(0)
    return j.select(query_id, (F.col("h1") > 0).alias("top1"), (F.col("h3") > 0).alias("top3"), (F.col("h5") > 0).alias("top5"), (F.col("h3") / 3).alias("p_at_3"), (F.col("h5") / F.col("wanted")).alias("r_at_5"))

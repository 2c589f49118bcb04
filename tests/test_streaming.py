"""Streams in several micro-batches with late rows: nothing lost, state bounded, a stopped run goes on."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import late, logs

START = dt.datetime(2024, 3, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, action string, rank int, aside string"


def at(hours):
    return None if hours is None else START + dt.timedelta(hours=hours)


def feed(spark, base, deliveries, consumers, span="1 day"):
    for rows in deliveries:
        df = spark.createDataFrame([(i, u, at(h), "view", 1, "x") for i, u, h in rows], SCHEMA)
        df.coalesce(2).write.mode("append").parquet(f"{base}/in")
        late.drain(spark.readStream.schema(df.schema).parquet(f"{base}/in"), base, span, consumers)
    return late.rows(spark, base, df.schema)


def split(deliveries, span):
    """Plain loop: (id, hours) on time and aside."""
    newest, kept, aside = None, [], []
    for rows in deliveries:
        for i, u, h in rows:
            (aside if h is None or newest is not None and h < newest - span else kept).append((i, u, h))
        seen = [h for _, _, h in rows if h is not None]
        newest = max([*seen, *([] if newest is None else [newest])], default=None)
    return kept, aside


DELIVERIES = [
    [(1, 1, 0), (2, 1, 5), (3, 2, 30), (3, 2, 30), (4, 2, None)],  # a repeated row, a row without time
    [],
    [(5, 1, 6), (6, 1, 5.5), (7, 2, 100), (8, 3, 2)],  # 6 is exactly one day before 30: on time; 5.5 and 2 are late
    [(9, 1, 76), (10, 1, 75), (11, 2, 101), (12, 3, 300)],
    [(13, 3, 277), (14, 3, 270), (15, 1, 900)],
]


def test_split_equals_plain_loop(spark, tmp_path):
    got = feed(spark, str(tmp_path), DELIVERIES, {}).select("event_id", "aside__").collect()
    kept, aside = split(DELIVERIES, 24)
    assert sorted(r[0] for r in got if not r[1]) == sorted(i for i, _, _ in kept)
    assert sorted(r[0] for r in got if r[1]) == sorted(i for i, _, _ in aside)


def test_closed_days_and_sessions_equal_plain_loop(spark, tmp_path):
    base = str(tmp_path)
    feed(spark, base, DELIVERIES, {"daily": lambda s: logs.windowed_kpis(s, late="1 day"), "sessions": lambda s: logs.sessions(s, "3 hours", "1 day")})
    kept, _ = split(DELIVERIES, 24)
    closed = max(h for _, _, h in kept) - 24
    days = {}
    for _, _, h in kept:
        days[h // 24 * 24] = days.get(h // 24 * 24, 0) + 1
    got = {(r["start"] - START).total_seconds() / 3600: r["n"] for r in spark.read.parquet(f"{base}/daily").collect()}
    assert got == {d: n for d, n in days.items() if d + 24 <= closed}
    runs = []
    for _, u, h in sorted(kept, key=lambda x: (x[1], x[2])):
        if runs and runs[-1][0] == u and h - runs[-1][2] < 3:
            runs[-1][2:] = [h, runs[-1][3] + 1]
        else:
            runs.append([u, h, h, 1])
    got = sorted((r["user_id"], (r["first"] - START).total_seconds() / 3600, r["n"]) for r in spark.read.parquet(f"{base}/sessions").collect())
    assert got == sorted((u, a, n) for u, a, b, n in runs if b + 3 <= closed)


def test_state_stays_bounded(spark, tmp_path):
    """A delivery a day for eight days: at most the open days stay in the state store, and everything is given out."""
    base, sizes = str(tmp_path), []
    for day in range(8):
        feed(spark, base, [[(day * 10 + k, k, day * 24 + 3 * k) for k in range(5)]], {"daily": lambda s: logs.windowed_kpis(s, late="1 day")})
        sizes.append(spark.read.format("statestore").load(f"{base}/state-daily").count())
    assert max(sizes) <= 3
    assert spark.read.parquet(f"{base}/daily").agg(F.sum("n")).first()[0] == 6 * 5


def test_stopped_run_goes_on(spark, tmp_path):
    """A consumer that fails after the rows are committed, and rows of a batch that was never committed: both end as if nothing had happened."""
    base = str(tmp_path)
    spark.createDataFrame([(99, 9, at(0), "view", 1, "x")], SCHEMA).withColumn("aside__", F.lit(False)).write.partitionBy("aside__").parquet(f"{base}/rows/epoch=0")

    def broken(stream):
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        feed(spark, base, DELIVERIES[:1], {"sessions": broken})
    work = {"sessions": lambda s: logs.sessions(s, "3 hours", "1 day")}
    got = feed(spark, base, DELIVERIES[1:], work)
    kept, aside = split([DELIVERIES[0], *DELIVERIES[1:]], 24)
    assert sorted(r[0] for r in got.collect()) == sorted(i for i, _, _ in kept + aside)
    other = str(tmp_path / "whole")
    feed(spark, other, DELIVERIES, work)
    assert sorted(spark.read.parquet(f"{base}/sessions").select("user_id", "n").collect()) == sorted(spark.read.parquet(f"{other}/sessions").select("user_id", "n").collect())

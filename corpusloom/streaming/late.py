"""Late rows set aside: a stream is split by its watermark before anything is aggregated, so that no row is lost in silence.

Each micro-batch is written once to the shared folder, its rows split into those on time and those aside. Then the consumers, each a
streaming query with its own state, take the rows on time up to the end and stop. A consumer thus always gets whole batches in
order: its own watermark never passes the one that split them, and drops nothing. A stopped run goes on where it was.

``base`` holds ``rows/epoch=N/aside__=...`` (the rows), ``marks/epoch=N`` (newest time up to N; its presence commits the rows), and
a table and a state folder per consumer. A batch that is repeated before its mark is overwritten; one repeated after it is left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

Consumer = Callable[[DataFrame], DataFrame]


def _newest(spark: SparkSession, base: str, epoch: int) -> tuple[bool, int | None]:
    """Whether a batch is committed, and the newest time (microseconds) up to it."""
    try:
        return True, spark.read.schema("newest long").parquet(f"{base}/marks/epoch={epoch}").first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False, None


def rows(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All rows so far, with ``epoch`` and ``aside__``; the filter on either reads only its folders."""
    return spark.read.schema(StructType(list(schema)).add("epoch", "long").add("aside__", BooleanType())).parquet(f"{base}/rows")


def drain(stream: DataFrame, base: str, late: str, consumers: Mapping[str, Consumer], ts: str = "ts") -> None:
    """Take what the stream holds up to now, split it, and let every consumer work on the rows on time.

    A row is aside if its time is null, or more than ``late`` before the newest time of all earlier batches. A consumer sets a
    watermark of ``late`` (or more) itself and appends to the table ``base/<its name>``. Equal rows are kept apart; an empty batch
    changes nothing; without earlier batches nothing is late.
    """
    schema, span = stream.schema, f"interval {late}"

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if not _newest(spark, base, epoch)[0]:
            before = _newest(spark, base, epoch - 1)[1]
            limit = F.timestamp_micros(F.lit(before).cast("long")) - F.expr(span)
            aside = F.col(ts).isNull() | F.coalesce(F.col(ts) < limit, F.lit(False))
            path = f"{base}/rows/epoch={epoch}"
            batch.withColumn("aside__", aside).write.mode("overwrite").partitionBy("aside__").parquet(path)
            kept = spark.read.schema(StructType(list(schema)).add("aside__", BooleanType())).parquet(path).where(~F.col("aside__"))
            kept.agg(F.greatest(F.max(F.unix_micros(ts)), F.lit(before).cast("long")).alias("newest")).write.mode("overwrite").parquet(f"{base}/marks/epoch={epoch}")
        on_time = spark.readStream.schema(schema).parquet(f"{base}/rows/epoch=*/aside__=false")
        started = [
            work(on_time).writeStream.queryName(name).format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/state-{name}").trigger(availableNow=True).start()
            for name, work in consumers.items()
        ]
        for q in started:
            q.awaitTermination()

    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()

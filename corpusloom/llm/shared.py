"""Small helpers that the training-data operators share: the cluster's shared folder, bounded samples and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, as in tests, may go without: it gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, name: str, batch_rows: int = 1000) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut, lost executors recompute nothing.

    While it is written, rows go to Python in batches of ``batch_rows`` at most: texts and shingle sets may be long.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema, rows = df.schema, spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(int(rows), batch_rows) if int(rows) > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, rows)
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of materialize once no plan reads them any more, through Hadoop's file system, wherever the shared folder is."""
    for df in tables:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread_join(rows: DataFrame, side: DataFrame, on: str, hot: int = 20_000) -> DataFrame:
    """Inner join of ``rows`` with ``side(on, ...)`` of one row a key. Rows of a key with more than ``hot`` of them are dealt over several
    copies of its side row. The table of such keys, of which n rows have n / hot at most, is broadcast. ``rows`` is read twice."""
    parts = F.broadcast(rows.groupBy(on).agg(F.count("*").alias("__n")).where(F.col("__n") > hot).select(on, F.ceil(F.col("__n") / F.lit(hot)).cast("int").alias("__parts")))
    n = F.coalesce("__parts", F.lit(1))
    left = rows.join(parts, on, "left").withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), n).cast("int")).drop("__parts")
    right = side.join(parts, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
    return left.join(right, [on, "__salt"]).drop("__salt")


def name(column: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def ddl(column: str, kind: str) -> str:
    return "`" + column.replace("`", "``") + "` " + kind


def hashed_place(column: str, seed: int) -> Column:
    """A place in 0 .. 2**63 - 1 for a value: a hash, so that rows of least place are a random sample at any size."""
    return F.shiftrightunsigned(F.xxhash64(name(column), F.lit(seed)), 1)


def first_labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, values: tuple[int, ...], n: int, seed: int) -> DataFrame:
    """(id, y, place): of each value in ``values`` the ``n`` labels of least place whose document is there.

    Only ids are shuffled; the result has at most n * len(values) rows, so that it can be broadcast. Repeated labels count once.
    """
    there = docs.select(name(id_col).cast("long").alias("id"))
    found = labels.select(name(id_col).cast("long").alias("id"), name(label_col).cast("int").alias("y")).where(F.col("y").isin(*values)).join(there, "id", "left_semi").withColumn("place", hashed_place("id", seed)).distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("place"))).where(F.col("rank") <= n).drop("rank")


def arrow_map(df: DataFrame, rows: Callable[..., Iterator[tuple]], schema: str, arrow: pa.Schema, chunk: int = 256) -> DataFrame:
    """``rows(*columns)`` gets up to ``chunk`` values of each column as lists and yields output tuples.

    Work and output go in small chunks, so a task's memory does not follow Arrow's batch size.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                out = list(rows(*(c.to_pylist() for c in part.columns)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, schema)

"""The driver's tables as a governed corpus: versions, units, messages, logs, elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ordering import position


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per document row; its document is the source, its number the position by doc_id."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), F.col("source").alias("document_id"), F.col("lang").alias("vertical"), "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("version_id"), "quality", "toxic")
    status = F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "rejected").otherwise("needs_review")
    risk = F.when(F.col("toxic") == 1, "high").when(F.col("toxic") == 0, "low").otherwise("")
    numbers = position(docs.select("document_id", "version_id"), ["document_id"], "version_id", "version_number").select("version_id", "version_number")
    return docs.join(numbers, "version_id").join(labels, "version_id", "left").select("version_id", "document_id", "version_number", status.alias("review_status"), risk.alias("risk_level"), "vertical", "text", "n_chars")


def with_status(v: DataFrame) -> DataFrame:
    """The highest approved version of a document is published, lower approved ones are archived, the rest drafts."""
    current = v.where("review_status = 'approved'").groupBy("document_id").agg(F.max("version_number").alias("current_number"))
    status = F.when((F.col("review_status") == "approved") & (F.col("version_number") == F.col("current_number")), "published").when(F.col("review_status") == "approved", "archived").otherwise("draft")
    return v.join(current, "document_id", "left").withColumn("status", status).drop("current_number")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank trimmed lines of the documents."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "raw")).select("version_id", "chunk_index", F.trim("raw").alias("content")).where("content <> ''")


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an audit log; rank and query come from props' k."""
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "view", "sop_search").when(F.col("event_type") == "click", "search_result_click").when(F.col("event_type") == "purchase", "quick_answer_open").otherwise("feedback_submitted")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("actor"), action.alias("action"), k.alias("rank"), F.concat(F.lit("q"), k.cast("string")).alias("query"), "value")


def retrieval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase', 'error')")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("q"), k.cast("string")).alias("query"), F.when(F.col("event_type") == "error", 0).otherwise(k % 7).alias("result_count"), F.col("value").alias("latency_ms"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One graph per order; its nodes are the distinct line numbers, titled by the first part name, with the largest quantity as support."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("long").alias("node_id"), "l_quantity")
    named = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey", "left")
    return named.groupBy("graph_id", "node_id").agg(F.coalesce(F.min("p_name"), F.lit("")).alias("title"), F.max("l_quantity").alias("support"))


def drawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as drawn: each returned (yes) or accepted (no) line leads to the line number that its part key gives, known or not, once or more."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return lines.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("long").alias("from_node"), (F.col("l_partkey") % 7 + 1).alias("to_node"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("condition"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct drawn edges whose end exists."""
    known = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").cast("long").alias("to_node"))
    return drawn_edges(spark, sf_dir).distinct().join(known, ["graph_id", "to_node"], "left_semi").select("graph_id", "from_node", "to_node", "condition")

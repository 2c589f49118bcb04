"""The training-data pipeline: language, toxicity, near duplicates, packing.

Null, empty and blank texts have no letter, so that the first stage drops them. A null id or source, language or size never
matters. Rows that repeat an id and its text fare alike; of rows that repeat an id with other texts each has its own fate. Further
columns are kept up to the last stage. Empty tables, and tables without labels, give empty or unfiltered results.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents, of the rows that they keep.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, minhash, packing, registry, toxicity
from corpusloom.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled rows show; rejected ones, and those without a letter, go."""
    model = langid.fit_table(docs.where(registry.fold("doc_id", 4) != 2))
    return docs.where(langid.accepted(model, docs["text"], spark))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score under 0.7."""
    model = registry.toxic_model(docs, registry.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(model, docs["text"], spark) < 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    A row goes by its id and text together; rows with a null id stay.
    """
    found = minhash.near_duplicates(docs, cfg=minhash.MinHashConfig(shingle=5, percent=80))
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone"), "text_key").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["__gone"]) & (F.xxhash64(docs["text"]) == gone["text_key"]), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [("language ID", language), ("toxicity", toxic), ("MinHash near-dedup", near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; every stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs

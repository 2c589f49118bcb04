"""Hybrid retrieval of a query set over a corpus: lexical and vector scores, fusion, top-k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators.nearest import knn
from corpusloom.operators.ordering import top_k
from corpusloom.sources.scratch import written


def postings(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, length): one row per distinct term of a text."""
    long = corpus.select(F.col(id_col), T.tokens(F.col(text_col)).alias("ts")).select(id_col, F.size("ts").alias("length"), F.explode("ts").alias("term"))
    return long.groupBy(id_col, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


SCORED = 4096  # queries that one group of a block scores


def _weighted(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float, b: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(asked, weighted): asked(q, term, part) of the queries and weighted(block, term, id, w) of the asked terms' postings, documents being dealt to blocks.

    Texts are read once: a row without a term stands for each text, so that their number and mean length come from the written table.
    """
    parts = max(1, -(-queries.count() // SCORED))
    asked = queries.select(F.col(query_id).alias("q"), F.explode(T.or_terms(F.col(query_text))).alias("term")).distinct()
    asked = written(asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts))), "asked")
    terms = asked.select("term").distinct()
    few = terms.count() <= 200_000
    terms = terms.unionByName(terms.sparkSession.range(1).select(F.lit(None).cast("string").alias("term")))
    ts = F.coalesce(T.tokens(F.col(doc_text)), F.array().cast("array<string>"))
    sized = corpus.select(F.col(doc_id).alias("id"), ts.alias("ts"))
    long = sized.select("id", F.size("ts").alias("length"), F.explode(F.concat("ts", F.array(F.lit(None).cast("string")))).alias("term")).alias("x")
    known = (F.broadcast(terms) if few else terms).alias("y")
    long = long.join(known, F.col("x.term").eqNullSafe(F.col("y.term")), "left_semi")
    held = written(long.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length")), "postings")
    docs, mean = held.where("term is null").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.coalesce(F.sum(F.col("tf") * F.col("length")) / F.sum("tf"), F.lit(0.0))).first()
    held = held.where("term is not null").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-docs // block)))))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    return asked, held.join(df, "term").select("block", "term", "id", weight.alias("w"))


def _scored(asked: DataFrame, weighted: DataFrame, k: int | None) -> DataFrame:
    """(q, id, s): the best k documents, or all, of each block for asked(q, term, part, block)."""
    dealt = weighted.join(asked.select("block", "part").distinct(), "block").select(F.col("block").alias("of_block"), F.col("part").alias("of_part"), "term", "id", "w")
    kind = f"q {asked.schema['q'].dataType.simpleString()}, id {weighted.schema['id'].dataType.simpleString()}, s double"
    return dealt.groupBy("of_block", "of_part").cogroup(asked.groupBy("block", "part")).applyInPandas(lambda postings, terms: best_of_block(postings, terms, k), kind)


def bm25(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k1: float = 1.2, b: float = 0.75, block: int = 512) -> DataFrame:
    """(query_id, doc_id, lexical_score) of every pair that shares a term (OR semantics).

    A block's postings meet the queries' terms in one task, so that a pair is a row once, with its sum, and not once a shared term. Queries and texts
    without terms have no row; a document or query id is one row.
    """
    asked, weighted = _weighted(queries, corpus, query_id, query_text, doc_id, doc_text, k1, b, block)
    every_part = asked.select("part").distinct().agg(F.collect_list("part").alias("parts")).first()["parts"]
    met = weighted.select("block").distinct().withColumn("part", F.explode(F.array(*map(F.lit, every_part)).cast("array<long>")))
    every = _scored(asked.join(met, "part"), weighted, None)
    return every.select(F.col("q").alias(query_id), F.col("id").alias(doc_id), F.col("s").alias("lexical_score"))


def bm25_top(queries: DataFrame, corpus: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str, k: int, k1: float = 1.2, b: float = 0.75, block: int = 512, first: int = 2) -> DataFrame:
    """(query_id, doc_id, lexical_score, rank): the exact best k of ``bm25`` per query, ties (of nine decimals) to the smaller id, by block maxima.

    Documents are dealt to blocks of about ``block``, so the postings of a stop word are many blocks' work; each block keeps a term's largest
    weight. The sum of a query's maxima bounds what a block can hold. The ``first`` blocks of largest bound give each query a k-th best score, and
    of the others only those are scored whose bound reaches it. Pairs of query and document never leave the task that scores a block: at most k a
    query do. Queries and texts without terms have no row; a document or query id is one row.
    """
    asked, weighted = _weighted(queries, corpus, query_id, query_text, doc_id, doc_text, k1, b, block)
    bounds = asked.join(weighted.groupBy("term", "block").agg(F.max("w").alias("w")), "term").groupBy("q", "block").agg(F.sum("w").alias("bound"))
    bounds = written(bounds, "bounds")

    score = lambda blocks: _scored(asked.join(blocks, "q"), weighted, k)
    opening = top_k(bounds, ["q"], first, F.col("bound").desc(), F.col("block"), rank="place").select("q", "block")
    found = written(score(opening), "found")
    floor = top_k(found, ["q"], k, F.col("s").desc(), F.col("id")).where(F.col("rank") == k).select("q", F.col("s").alias("floor"))
    rest = bounds.join(opening, ["q", "block"], "left_anti").join(floor, "q", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-9)).select("q", "block")
    every = found.unionByName(score(rest))
    return top_k(every, ["q"], k, F.round("s", 9).desc(), F.col("id")).select(F.col("q").alias(query_id), F.col("id").alias(doc_id), F.col("s").alias("lexical_score"), "rank")


def best_of_block(postings: pd.DataFrame, asked: pd.DataFrame, k: int | None) -> pd.DataFrame:
    """The best k documents, or all that share a term, of one block for each query of ``asked(q, term)``, from ``postings(term, id, w)``."""
    postings = postings.sort_values("term", kind="stable")
    ids, at = np.unique(postings["id"].to_numpy(), return_inverse=True)
    weights, words = postings["w"].to_numpy(float), postings["term"].to_numpy()
    lo, hi = (np.searchsorted(words, asked["term"].to_numpy(), side) for side in ("left", "right"))
    out = []
    for q, rows in asked.groupby("q").indices.items():
        spans = np.concatenate([np.arange(lo[r], hi[r]) for r in rows])
        if len(spans):
            scores = np.bincount(at[spans], weights[spans], len(ids))
            hit = np.unique(at[spans])
            best = hit if k is None else hit[np.lexsort((hit, -np.round(scores[hit], 9)))[:k]]
            out.append(pd.DataFrame({"q": q, "id": ids[best], "s": scores[best]}))
    return pd.concat(out) if out else pd.DataFrame({"q": asked["q"][:0], "id": ids[:0], "s": np.empty(0)})


def hashed_vectors(corpus: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """(id, v array<double>): signed, hashed bag of words of unit length; texts without tokens have no row.

    Sums of the buckets are combined in the task that reads a text, so one row of ``dims`` numbers a task and text is shuffled.
    """
    words = corpus.select(F.col(id_col), F.explode(T.tokens(F.col(text_col))).alias("t"))
    placed = words.select(id_col, V.hash_bucket(F.col("t"), dims).cast("int").alias("at"), V.hash_sign(F.col("t")).cast("double").alias("x"))
    sparse = placed.groupBy(id_col, "at").agg(F.sum("x").alias("x"))
    filled = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    v = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0)))
    unit = filled.select(id_col, v.alias("v")).withColumn("n", V.norm(F.col("v")))
    return unit.select(id_col, F.when(F.col("n") > 0, F.transform("v", lambda x: x / F.col("n"))).otherwise(F.array_repeat(F.lit(0.0), dims)).alias("v"))


def reciprocal_rank_fusion(rankings: list[DataFrame], query_id: str, doc_id: str, k: int = 60) -> DataFrame:
    """(query_id, doc_id, rrf) from frames with a rank column."""
    every = rankings[0].select(query_id, doc_id, "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select(query_id, doc_id, "rank"))
    return every.groupBy(query_id, doc_id).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def merge_sources(keyword: DataFrame, vector: DataFrame, query_id: str, doc_id: str, k: int = 60) -> DataFrame:
    """Full outer merge of two ranked sources; only rows that both found have a fusion score, others 0."""
    a = keyword.select(query_id, doc_id, "lexical_score", F.col("rank").alias("keyword_rank"))
    b = vector.select(query_id, doc_id, "vector_score", F.col("rank").alias("vector_rank"))
    both = F.col("keyword_rank").isNotNull() & F.col("vector_rank").isNotNull()
    fused = F.when(both, 1.0 / (k + F.col("keyword_rank")) + 1.0 / (k + F.col("vector_rank"))).otherwise(0.0)
    return a.join(b, [query_id, doc_id], "full_outer").select(query_id, doc_id, F.coalesce("lexical_score", F.lit(0.0)).alias("lexical_score"), F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), "keyword_rank", "vector_rank", fused.alias("fusion_score"))


def reliable(df: DataFrame, least: float = 0.12) -> DataFrame:
    return df.where((F.col("lexical_score") > 0) | (F.col("vector_score") >= least))


def relax_if_empty(strict: DataFrame, loose: DataFrame, query_id: str) -> DataFrame:
    """The strict rows; for queries without any, the loose ones, marked as relaxed."""
    kept = strict.withColumn("relaxed", F.lit(False))
    return kept.unionByName(loose.join(strict.select(query_id).distinct(), query_id, "left_anti").withColumn("relaxed", F.lit(True)))


def backfill(primary: DataFrame, secondary: DataFrame, query_id: str, doc_id: str, limit: int, order: Column) -> DataFrame:
    """Primary rows, then secondary ones that are not there yet, up to a limit per query."""
    more = secondary.join(primary.select(query_id, doc_id), [query_id, doc_id], "left_anti")
    every = primary.withColumn("source", F.lit(0)).unionByName(more.withColumn("source", F.lit(1)))
    return top_k(every, [query_id], limit, F.col("source"), order, F.col(doc_id))


def hybrid_retrieve(queries: DataFrame, corpus: DataFrame, query_id: str = "query_id", doc_id: str = "chunk_id", text: str = "text", candidates: int = 30, output: int = 10, dims: int = 64) -> DataFrame:
    """Flagship: lexical and vector candidates, merged, fused and ordered; ten per query."""
    lexical = bm25_top(queries, corpus, query_id, text, doc_id, text, candidates)
    nearest = knn(hashed_vectors(queries, query_id, text, dims), written(hashed_vectors(corpus, doc_id, text, dims), "vectors"), query_id, doc_id, candidates)
    merged = reliable(merge_sources(lexical, nearest, query_id, doc_id))
    best = top_k(merged, [query_id], output, F.round("fusion_score", 9).desc(), F.round("lexical_score", 9).desc(), F.round("vector_score", 9).desc(), F.col(doc_id))
    return best.select(query_id, doc_id, "lexical_score", "vector_score", "fusion_score", "rank")


def source_rank(df: DataFrame, query_id: str, source: str, score: str, doc_id: str) -> DataFrame:
    return df.withColumn("source_rank", F.row_number().over(Window.partitionBy(query_id, source).orderBy(F.col(score).desc(), F.col(doc_id))))

"""Exact nearest neighbours by cosine: blocks of queries meet parts of the corpus, one matrix product a tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import top_k

BAND = 2e-9  # scores are ordered by nine decimals; a product's rounding is far below that
TILE, CHUNK = 4_000_000, 32_768  # numbers of a tile, pairs that are scored at once


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, starts, numbers, zero) of a column of arrays; null arrays and arrays with a null have length -1, zero marks vectors of norm 0."""
    lists = column.combine_chunks()
    held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    lengths = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, held)
    if flat.null_count:
        lengths[np.unique(np.repeat(np.arange(len(held)), held)[flat.is_null().to_numpy(zero_copy_only=False)])] = -1
    numbers = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    filled = np.bincount(np.repeat(np.arange(len(held)), held)[numbers * numbers != 0], minlength=len(held)) > 0
    return lengths, np.cumsum(held) - held, numbers, (lengths >= 0) & ~filled


def _matrix(starts: np.ndarray, numbers: np.ndarray, width: int) -> np.ndarray:
    return numbers[starts[:, None] + np.arange(width)]


def _sums(x: np.ndarray) -> np.ndarray:
    """Row sums from left to right, as the column expression adds."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def best_of_cell(queries: pa.Table, corpus: pa.Table, k: int) -> pa.Table:
    """(q, id, score) of queries(q, v) in corpus(id, v): all rows that can be among the best k.

    The product only picks candidates; scores are those of ``vectors.cosine``: 0 with a zero vector, else null with a null, a null component or another length.
    Of rows with one score the k smallest ids are enough, so that copies add no more than that.
    """
    (ql, qs, qx, qz), (cl, cs, cx, cz) = _vectors(queries.column("v")), _vectors(corpus.column("v"))
    place = np.empty(len(cl), np.int64)
    place[pc.array_sort_indices(corpus.column("id").combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(cl))
    found = []
    for width in np.unique(ql):
        rows, fits = np.flatnonzero(ql == width), np.flatnonzero((cl == width) & (width >= 0))
        a, b = (_matrix(s, x, max(width, 0)) for s, x in ((qs[rows], qx), (cs[fits], cx)))
        na, nb = np.sqrt(_sums(a * a)), np.sqrt(_sums(b * b))
        with np.errstate(all="ignore"):
            ua, ub = (np.where(n[:, None] == 0, 0.0, m / n[:, None]) for m, n in ((a, na), (b, nb)))
        odd = not (np.isfinite(ua).all() and np.isfinite(ub).all())
        step = max(1, TILE // max(1, len(cl)))
        for at in range(0, len(rows), step):
            tile = np.full((len(ua[at : at + step]), len(cl)), -np.inf)
            with np.errstate(all="ignore"):
                near = ua[at : at + step] @ ub.T
            tile[:, fits] = np.where(np.isnan(near), np.inf, near) if odd else near
            tile[:, cz] = tile[qz[rows[at : at + step]]] = 0.0
            floor = np.partition(tile, len(cl) - k, axis=1)[:, len(cl) - k] if len(cl) > k else np.full(len(tile), -np.inf)
            i, j = np.nonzero(tile >= floor[:, None] - BAND)
            held, zero = (cl[j] == width) & (width >= 0), cz[j] | qz[rows[at + i]]
            score, known, of = np.zeros(len(i)), held | zero, np.searchsorted(fits, j)
            for lo in range(0, len(i), CHUNK):
                w = lo + np.flatnonzero((held & ~zero)[lo : lo + CHUNK])
                x, y = at + i[w], of[w]
                with np.errstate(all="ignore"):
                    score[w] = _sums(a[x] * b[y]) / (na[x] * nb[y])
            key = np.where(known, np.where(np.isnan(score), np.inf, score), -np.inf)
            order = np.lexsort((place[j], -key, i))
            i, j, score, known, key = (z[order] for z in (i, j, score, known, key))
            first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (key[1:] != key[:-1])]) if len(i) else np.empty(0, np.int64)
            keep = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
            found.append((rows[at + i[keep]], j[keep], score[keep], known[keep]))
    i, j, score, known = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
    return pa.table({"q": queries.column("q").take(pa.array(i)), "id": corpus.column("id").take(pa.array(j)), "vector_score": pa.array(score, mask=~known)})


def knn(queries: DataFrame, corpus: DataFrame, query_id: str, doc_id: str, k: int, vec: str = "v", block: int = 16_384, part: int = 65_536) -> DataFrame:
    """(query_id, doc_id, vector_score, rank): exact nearest by cosine for a stated query set, ties (of nine decimals) to the smaller id.

    Queries go in blocks, corpus rows in parts of bounded size; each block meets each part in one task, and only the best k of a query leave it.
    The corpus is counted first, so it should be a table or cheap to read.
    """
    asked, rows = queries.count(), corpus.count()
    blocks = max(1, -(-asked // block))
    parts = max(1, -(-rows // part), min(queries.sparkSession.sparkContext.defaultParallelism, -(-rows // 2048)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.select(F.pmod(F.xxhash64(query_id), F.lit(blocks)).alias("block"), every(parts).alias("part"), F.col(query_id).alias("q"), F.col(vec).alias("v"))
    right = corpus.select(every(blocks).alias("block"), F.pmod(F.xxhash64(doc_id), F.lit(parts)).alias("part"), F.col(doc_id).alias("id"), F.col(vec).alias("v"))
    kind = f"q {queries.schema[query_id].dataType.simpleString()}, id {corpus.schema[doc_id].dataType.simpleString()}, vector_score double"
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda a, b: best_of_cell(a, b, k), kind)
    named = met.select(F.col("q").alias(query_id), F.col("id").alias(doc_id), "vector_score")
    return top_k(named, [query_id], k, F.round("vector_score", 9).desc(), F.col(doc_id))

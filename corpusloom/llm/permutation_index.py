"""Approximate nearest neighbours by a permutation index.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order and is posted in
those pivots' inverted files, with its position there. Files are kept in slots, each with the files of a random share of
the vectors of bounded size. A query reads the files of its own nearest pivots in every slot and adds up the footrule
distance (sum of differences of positions; a pivot that is missing on one side counts as the last position); in each
slot the same share of the vectors, those of least distance, is compared with the query by the exact inner product.

Inner product search is reduced to nearest neighbours first: a vector x of norm at most M is extended by
sqrt(M*M - x.x), a query by 0, so that the order by inner product is the order by distance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, materialize, name


@dataclass(frozen=True)
class PermutationConfig:
    """pivots: at most so many, at least one per ``rows_per_pivot`` rows up to that; a bounded sample that does not grow.
    posted: pivots that a vector is posted under. read: nearest pivots of a query, whose files it reads. rerank: share of all vectors, those of
    least footrule distance, that a query is compared with exactly; ``least`` of them at least.
    part: vectors in a slot of the inverted files, on average. block: queries that a slot answers in one task, on average."""

    pivots: int = 1024
    rows_per_pivot: int = 8
    posted: int = 128
    read: int = 64
    rerank: float = 0.04
    least: int = 1000
    part: int = 4096
    block: int = 4096
    seed: int = 3


def usable(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of rows that take part: an id, and a vector that is not null, empty or zero and has only finite parts."""
    v = name(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(name(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0)).where(ok)


def orders(v: np.ndarray, pivots: np.ndarray, m2: float, k: int, query: bool) -> np.ndarray:
    """The k nearest pivots of each row of v, nearest first, ties to the smaller pivot."""
    extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(m2 - (v * v).sum(axis=1), 0))
    lifted = np.column_stack([v, extra])
    d = (pivots * pivots).sum(axis=1)[None, :] - 2 * lifted @ pivots.T
    if k < d.shape[1]:
        near = np.sort(np.argpartition(d, k, axis=1)[:, : k + 1], axis=1)
        d = np.take_along_axis(d, near, axis=1)
        return np.take_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :k], axis=1).astype(np.int16)
    return np.argsort(d, axis=1, kind="stable").astype(np.int16)


def footrule(q: np.ndarray, rows: np.ndarray, n_pivots: int) -> np.ndarray:
    """Footrule distance of one query order to many orders; a pivot that only one side lists stands at the last position there."""
    last = rows.shape[1]
    place = np.full(n_pivots, last, np.int32)
    place[q] = np.arange(len(q))
    shared = place[rows]
    at = np.arange(last)
    d = np.abs(shared - at[None, :])
    total = d.sum(axis=1)
    in_both = np.where(shared < last, last - shared, 0).sum(axis=1)
    return total + (last - np.arange(len(q))).sum() - in_both


def nearness(qo: np.ndarray, starts: np.ndarray, rows: np.ndarray, places: np.ndarray, n: int, k: int) -> np.ndarray:
    """What a query's inverted files take off the largest footrule distance, for each of a slot's n vectors.

    The file of pivot p is rows[starts[p]:starts[p+1]] with the positions there. A pivot at places i and j of two orders, where k
    stands for missing ones, takes off (k - i) + (k - j) - |i - j|, twice the lesser of k - i and k - j.
    """
    total = np.zeros(n, np.int32)
    for i, p in enumerate(qo):
        a, b = starts[p], starts[p + 1]
        total[rows[a:b]] += np.minimum(k - places[a:b], k - i)
    return 2 * total


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", cfg: PermutationConfig = PermutationConfig()) -> DataFrame:
    """The k nearest rows of ``table`` by inner product for each row of ``queries``, never the row of the same id.

    Returns (query_id, rank from 1, vec_id, score in double precision), ties to the smaller id. Rows whose vector is null, zero or not
    finite take no part on either side; a query has k rows if there are so many candidates, else all; an empty table gives none. A
    repeated id of the table is a candidate per row, one of the queries asks once, with its least vector. Other columns are
    ignored. Vectors of another length than the most frequent one (on ties, the shortest) are left out.
    """
    spark = table.sparkSession
    base = usable(table, id_col, vec_col)
    stats = base.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m2"), F.mode(F.size("v"), True).alias("dim")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not stats["n"]:
        return spark.createDataFrame([], result)
    n, dim, m2 = int(stats["n"]), int(stats["dim"]), float(stats["m2"])
    base = base.where(F.size("v") == dim)
    wanted = max(1, min(cfg.pivots, n // cfg.rows_per_pivot or 1))
    sample = [r["v"] for r in base.orderBy(F.xxhash64("id", F.lit(cfg.seed)), "id").limit(wanted).collect()]  # bounded by cfg.pivots
    raw = np.array(sample)
    pivots = np.column_stack([raw, np.sqrt(np.maximum(m2 - (raw * raw).sum(axis=1), 0))])
    n_pivots, posted = len(pivots), min(cfg.posted, len(pivots))
    kind = np.float32 if "float" in table.schema[vec_col].dataType.simpleString() else np.float64  # floats are kept as they are
    shared = spark.sparkContext.broadcast(pivots)  # at most cfg.pivots vectors

    def ordered(query: bool, kind: type):
        def rows(ids, vectors):
            o = orders(np.array(vectors), shared.value, m2, min(cfg.read, posted) if query else posted, query)
            for i, v, x in zip(ids, vectors, o, strict=True):
                yield i, np.array(v, kind).tobytes(), x.tobytes()

        return rows

    kept, kept_schema = "id long, v binary, o binary", pa.schema([("id", pa.int64()), ("v", pa.binary()), ("o", pa.binary())])
    slots = -(-n // cfg.part)
    posts = arrow_map(base, ordered(False, kind), kept, kept_schema, chunk=1024)
    dealt = posts.groupBy(F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot")).agg(F.collect_list(F.struct("id", "v", "o")).alias("m"))

    def invert(slot, members):
        for s, m in zip(slot, members, strict=True):
            flat = np.frombuffer(b"".join(x["o"] for x in m), np.int16)
            order = np.argsort(flat, kind="stable")
            starts = np.searchsorted(flat[order], np.arange(n_pivots + 1)).astype(np.int32)
            yield s, np.array([x["id"] for x in m]).tobytes(), b"".join(x["v"] for x in m), starts.tobytes(), (order // posted).astype(np.int32).tobytes(), (order % posted).astype(np.int16).tobytes()

    names = ("ids", "vs", "starts", "rows", "places")
    files = arrow_map(dealt, invert, "slot int, " + ", ".join(f"{x} binary" for x in names), pa.schema([("slot", pa.int32())] + [(x, pa.binary()) for x in names]), chunk=1)
    files = materialize(files, "inverted-files")

    asked = usable(queries, id_col, vec_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(arrow_map(asked, ordered(True, np.float64), kept, kept_schema, chunk=1024), "asked")
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], result)
    blocks = -(-n_asked // cfg.block)
    readers = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v", "o")).alias("readers"))
    # Every slot answers every block of queries; a pair of them, both of bounded size, is one row.
    met = files.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(readers.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))), ["slot", "block"])

    def answer(ids, vs, starts, rows, places, readers):
        for i, v, s, r, p, qs in zip(ids, vs, starts, rows, places, readers, strict=True):
            i, s, r, p = np.frombuffer(i, np.int64), np.frombuffer(s, np.int32), np.frombuffer(r, np.int32), np.frombuffer(p, np.int16)
            v = np.frombuffer(v, kind).reshape(len(i), -1).astype(np.float64)
            keep = max(k, int(np.ceil(len(i) * max(cfg.rerank, cfg.least / n)))) + 1  # one more: the query's own row
            for q in qs:
                near = nearness(np.frombuffer(q["o"], np.int16), s, r, p, len(i), posted)
                at = np.argpartition(-near, keep)[:keep] if keep < len(i) else np.arange(len(i))
                at = at[i[at] != q["id"]]
                scores = exact(v[at], np.frombuffer(q["v"], np.float64))
                for b in np.lexsort((i[at], -scores))[:k]:
                    yield q["id"], int(i[at[b]]), float(scores[b])

    found = arrow_map(met.select(*names, "readers"), answer, "query_id long, vec_id long, score double", pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), chunk=1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component to the last."""
    total = np.zeros(len(vectors))
    for j in range(vectors.shape[1]):
        total += vectors[:, j] * q[j]
    return total

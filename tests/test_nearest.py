"""Nearest neighbours by tiles against the column expression over every pair."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import nearest, ordering


def plain(queries, corpus, k):
    met = queries.crossJoin(corpus.withColumnRenamed("v", "w")).select("q", "id", V.cosine(F.col("v"), F.col("w")).alias("vector_score"))
    return ordering.top_k(met, ["q"], k, F.round("vector_score", 9).desc(), F.col("id"))


def shown(df):
    return sorted((r.q, r["rank"], r.id, repr(r.vector_score)) for r in df.collect())


@pytest.mark.parametrize("tile", [7, 4_000_000])
def test_equals_all_pairs_with_copies_zeros_nulls_and_other_lengths(spark, monkeypatch, tile):
    rng = random.Random(3)
    vs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(30)]
    odd = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5, [1.0, 2.0], []]
    rows = [(f"d{k:03d}", v) for k, v in enumerate(vs + vs[:1] * 40 + odd)]
    corpus = spark.createDataFrame(rows, "id string, v array<double>")
    queries = spark.createDataFrame([(k, v) for k, v in enumerate(vs[:6] + odd)], "q long, v array<double>")
    monkeypatch.setattr(nearest, "TILE", tile)
    for k in (1, 5, 100):
        assert shown(nearest.knn(queries, corpus, "q", "id", k, block=4, part=16)) == shown(plain(queries, corpus, k))


def test_copies_do_not_leave_a_cell():
    table = lambda name, n: pa.table({name: pa.array(range(n)), "v": pa.array([[1.0, 2.0]] * n)})
    assert nearest.best_of_cell(table("q", 2), table("id", 5000), 3).to_pydict() == {"q": [0] * 3 + [1] * 3, "id": [0, 1, 2] * 2, "vector_score": [pytest.approx(1.0)] * 6}

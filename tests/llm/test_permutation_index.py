import numpy as np

from corpusloom.llm import permutation_index as pi


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = pi.exact(x, x[i])
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-s[j], ids[j]))[:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(10, 16))
    x = centers[rng.integers(0, 10, 1500)] + rng.normal(size=(1500, 16)) * 0.7
    x[7] = x[8]
    ids = list(range(1500))
    table = spark.createDataFrame([(i, v.tolist(), "s") for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score string")
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 20)
    cfg = pi.PermutationConfig(pivots=64, part=256)
    rows = pi.search(table, table.where("vec_id % 50 = 0"), 20, cfg=cfg).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    exact = {(q, i): s for q in want for i, s in zip(ids, pi.exact(x, x[q]))}
    assert all(exact[q, i] == s and i != q for q, v in got.items() for i, s in v)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_small_tables_give_all(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (40, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (11, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pi.search(table, table.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 0.5), (0, 2, 4, 0.5), (0, 3, 20, 0.0), (20, 1, 3, 0.5), (20, 2, 4, 0.5), (20, 3, 0, 0.0)]
    assert pi.search(table.limit(0), table.limit(0)).count() == 0


def test_footrule_against_definition():
    rng = np.random.default_rng(2)
    for _ in range(40):
        q, rows = rng.permutation(12)[:5], np.array([rng.permutation(12)[:5] for _ in range(6)])
        place = lambda o: [list(o).index(p) if p in o else 5 for p in range(12)]
        want = [sum(abs(a - b) for a, b in zip(place(q), place(r))) for r in rows]
        assert pi.footrule(q, rows, 12).tolist() == want


def test_inverted_files_add_up_to_the_footrule():
    rng = np.random.default_rng(3)
    k, n_pivots = 6, 15
    orders = np.array([rng.permutation(n_pivots)[:k] for _ in range(40)]).astype(np.int16)
    flat = orders.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    for _ in range(10):
        q = rng.permutation(n_pivots)[:k].astype(np.int16)
        got = k * (k + 1) - pi.nearness(q, starts, order // k, (order % k).astype(np.int16), 40, k)
        assert got.tolist() == pi.footrule(q, orders, n_pivots).tolist()


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in table.where("embedding is not null").collect()}
    ids, x = list(rows), np.array(list(rows.values()))
    want = brute(ids, x, [i for i in ids if i % 20 == 0][:40], 20)
    got = {}
    for r in pi.search(table, table.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & {i for i, _ in v}) / 20 for q, v in want.items()]) >= 0.9


def test_repeated_rows_and_other_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (3, [1.0]), (4, [0.0, 2.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = pi.search(table, table.where("vec_id = 20"), 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(4, 2.0), (1, 1.0), (1, 1.0)]

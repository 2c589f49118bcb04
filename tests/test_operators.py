"""Parity cases on tiny frames."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import analytics, chunking, governance, graphs, ordering, overlaps, ranking, relations, retrieval, similarity
from corpusloom.plans import relations as relation_plans


def plain_chunks(sizes, target, overlap):
    """The greedy rule as a loop: close before the target is exceeded, re-seed with trailing units of up to overlap tokens."""
    out, first, k = [], 0, 0
    while k < len(sizes):
        if k > first and sum(sizes[first : k + 1]) > target:
            out.append((first, k))
            nxt = k if k - first <= 1 else min(next((j for j in range(first + 1, k) if sum(sizes[j:k]) <= overlap), k), k - 1)
            first = k if sum(sizes[nxt : k + 1]) > target else nxt
        k += 1
    return out + [(first, len(sizes))]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_follow_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 90) for _ in range(40)]
    units = spark.createDataFrame([(1, i, " ".join(["w"] * n)) for i, n in enumerate(sizes)], "d int, i int, x string")
    rows = chunking.chunk(units, "d", ["i"], "x", 120, 30).orderBy("chunk_index").collect()
    assert [(r.first_unit, r.end_unit) for r in rows] == plain_chunks(sizes, 120, 30)
    assert all(r.tokens == sum(sizes[r.first_unit : r.end_unit]) == len(r.content.split()) for r in rows)


def test_repair_joins_incomplete_units(spark):
    df = spark.createDataFrame([(["If late,", "call.", "Then wait and", "ask", "Done."],), ([],)], "u array<string>")
    got = [r[0] for r in df.select(chunking.repair(F.col("u"), r"(,|\band)$")).collect()]
    assert got == [["If late, call.", "Then wait and ask", "Done."], []]


def test_claims_keep_every_version_and_differ_by_the_whole_text(spark):
    long = "the same beginning " * 20
    rows = [(k, long + "one") for k in range(9)] + [(0, long + "one"), (9, long + "two"), (9, "note the end"), (9, "if the end")]
    units = chunking.claims(spark.createDataFrame(rows, "version_id long, content string"), "content")
    got = sorted((r.dup_count, r.versions, r.unit_type) for r in chunking.claim_counts(units, "version_id", "content").collect())
    assert got == [(1, 1, "condition"), (1, 1, "note"), (1, 1, "section"), (10, 9, "section")]
    assert units.select("claim", "version_id").distinct().count() == 12


def test_positions_equal_a_window(spark):
    df = spark.createDataFrame([(k % 3 if k % 2 else 0, k * 7 % 101) for k in range(101)], "g long, o long")
    rows = ordering.position(df, ["g"], "o", "p", width=10).collect()
    for g in {r.g for r in rows}:
        assert [r.p for r in sorted((r for r in rows if r.g == g), key=lambda r: r.o)] == list(range(1, sum(r.g == g for r in rows) + 1))


def test_publish_archives_the_previous(spark):
    v = spark.createDataFrame([(1, "d", 1, "published"), (2, "d", 2, "draft"), (3, "e", 1, "draft")], "version_id long, document_id string, version_number long, status string")
    got = {r.version_id: r.status for r in governance.publish(v, spark.createDataFrame([(2,)], "version_id long")).collect()}
    assert got == {1: "archived", 2: "published", 3: "draft"}


def test_attribution_takes_the_last_search_over_buckets(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "sop_search", 0), (2, "2024-01-03 00:00:00", 7, "search_result_click", 1), (3, "2024-01-03 00:00:01", 7, "sop_search", 0), (4, "2024-01-03 00:00:01", 7, "search_result_click", 2), (5, "2024-01-01 00:00:00", 8, "search_result_click", 1)]
    a = spark.createDataFrame(rows, "event_id long, t string, actor long, action string, rank int").withColumn("ts", F.to_timestamp("t"))
    got = {r.event_id: r.search_event_id for r in analytics.attribute_clicks(a).collect()}
    assert got == {2: 1, 4: 3}


def test_relation_targets_need_one_match(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "source long, title string")
    d = spark.createDataFrame([(10, "a"), (20, "b"), (21, "b"), (3, "c")], "id long, title string")
    assert [(r.source, r.target_id) for r in relations.exact_targets(e, d, "title", "id", "source").collect()] == [(1, 10)]


def test_pairs_of_frequent_tokens_are_kept(spark):
    rng = random.Random(5)
    sets = {k: {"the", "same", "title"} if k < 20 else {"the"} | {f"w{rng.randint(0, 9)}" for _ in range(4)} for k in range(50)}
    docs = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [(99, [])], "id long, ts array<string>")
    classes = relations.token_classes(docs, "id", "ts").cache()
    found = {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in relations.class_pairs(classes, block=3).collect()}
    of = {r.id: r["class"] for r in classes.collect()}
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert len(want) == 50 * 49 // 2
    for (a, b), (shared, m, n) in want.items():
        if of[a] == of[b]:
            assert sets[a] == sets[b]
        else:
            assert found[min(of[a], of[b]), max(of[a], of[b])] == ((shared, m, n) if of[a] < of[b] else (shared, n, m))
    assert len(found) == len({frozenset((of[a], of[b])) for a, b in want if of[a] != of[b]})
    rows = relations.member_pairs(classes, "id", relations.class_pairs(classes, block=3), 50).collect()
    assert len(rows) == len(want) and {(r.a, r.b): (r.shared, r.size_a, r.size_b) for r in rows} == want


def test_class_pairs_go_through_no_shuffle(spark):
    docs = spark.createDataFrame([(k, ["the", f"w{k}"]) for k in range(200)], "id long, ts array<string>")
    pairs = relations.class_pairs(relations.token_classes(docs, "id", "ts"), block=30)
    assert pairs.count() == 200 * 199 // 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    pairs_at = plan.index("FlatMapGroupsInArrow")
    assert "Exchange" not in plan[:pairs_at]


def test_best_partners_against_all_pairs(spark, monkeypatch):
    rng = random.Random(11)
    sets = {k: {"the"} | {f"w{min(int(rng.expovariate(0.3)), 30)}" for _ in range(rng.randint(0, 9))} for k in range(140)}
    sets |= {k: {"same", "title", "the"} for k in range(140, 230)} | {230: set(), 2**40: {"w1", "w2"}}
    docs = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()] + [(None, ["the"])], "id long, ts array<string>")
    classes = relations.token_classes(docs, "id", "ts")
    bounds = (350_000, 820_000)
    want = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b]:
                x = round(len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])), 6)
                want.setdefault((a, (x >= 0.35) + (x >= 0.82)), []).append((-x, b))
    want = {g: sorted(v)[:3] for g, v in want.items()}
    def by_range(rows):
        found = {}
        for a, b, shared, m, n in rows:
            x = round(shared / max(m, n), 6)
            assert a < b and (m, n) == (len(sets[a]), len(sets[b]))
            found.setdefault((a, (x >= 0.35) + (x >= 0.82)), []).append((-x, b))
        return {g: sorted(v)[:3] for g, v in found.items()}

    for width, block in ((65_536, 16_384), (50, 20)):
        assert by_range(overlaps.best_partners(classes, "id", 3, bounds, block=block, width=width).collect()) == want
    # One cell in small tiles and pieces.
    monkeypatch.setattr(overlaps, "TILE", 500)
    monkeypatch.setattr(overlaps, "PIECE", 2_000)
    held = {}
    for k, v in sets.items():
        held.setdefault(frozenset(v), []).append(k)
    held = [(sorted(ids), [hash(t) for t in sorted(v)]) for v, ids in held.items() if v]
    table = pa.table({"ids": [x for x, _ in held], "ts": [x for _, x in held]} | {c: [0] * len(held) for c in ("own", "p", "q")})
    assert by_range(zip(*overlaps.best_of_cell(table, 3, bounds).to_pydict().values(), strict=True)) == want


def test_blocks_meet_in_a_few_bytes_a_token(spark, monkeypatch):
    """What is shuffled once a block are numbers of tokens, neither hashes nor names of classes."""
    met, cells = [], overlaps.cells
    monkeypatch.setattr(overlaps, "cells", lambda sets, *key, block: met.append((sets, block)) or cells(sets, *key, block=block))
    rng = random.Random(6)
    docs = spark.createDataFrame([(k, sorted({f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(60)})) for k in range(200)], "id long, ts array<string>")
    classes = relations.token_classes(docs, "id", "ts")
    assert overlaps.best_partners(classes, "id", 5).count() and relations.class_pairs(classes).count()
    n = sum(len(r.ts) for r in docs.collect())
    assert [b >= 65_536 for _, b in met] == [True, True]
    for sets, _ in met:
        size = sets.select(F.sum(F.length("near") + 8 * F.size("far"))).first()[0]
        assert size < 2.5 * n and "class" not in sets.columns  # eight bytes a token before


def test_opposed_pairs_against_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    sets = [(k - 60, k % 3, {"the"} | {f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randint(0, 9))}) for k in range(120)]
    sets += [(k, 0, {"same", "title", "the", "of"}) for k in range(60, 130)] + [(200, 5, {"the", "of"}), (201, None, {"the"}), (None, 0, {"same", "title", "the", "of"}), (202, 0, set())]
    docs = spark.createDataFrame([((k, scope), sorted(ts)) for k, scope, ts in sets], "of struct<id: long, scope: long>, ts array<string>")
    classes = relations.token_classes(docs, "of", "ts").select("class", "ts", "of.*", F.expr("of.id % 2 = 0").alias("even"))
    want = {(a, b): len(x & y) for a, s, x in sets for b, t, y in sets if None not in (a, b, s, t) and a < b and s == t and a % 2 != b % 2 and len(x & y) >= 3}
    assert any(b < 0 for _, b in want)
    monkeypatch.setattr(overlaps, "TILE", 100)
    monkeypatch.setattr(overlaps, "BATCH", 50)
    for width, block in ((1024, 16_384), (7, 20)):
        pairs = overlaps.opposed_pairs(classes, "id", "scope", "even", 3, block=block, width=width)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
        rows = pairs.collect()
        assert len(rows) == len(want) and {(r.a, r.b): r.shared for r in rows} == want


def test_polarity_conflicts_meet_as_classes(spark):
    """A pair is a row of the result only: scopes aren't joined text by text."""
    plan = relation_plans.j19(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "array_intersect" not in plan


@pytest.mark.parametrize("words", (0, 3, 512))
def test_shared_counts_by_product_and_by_postings(monkeypatch, words):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(overlaps, "WORDS", words)
    monkeypatch.setattr(overlaps, "TILE", 200)
    sides = [[np.unique(np.minimum(rng.exponential(6, rng.integers(0, 12)).astype(np.int64), 40)) for _ in range(n)] for n in (50, 40)]
    upto = rng.integers(0, 41, 50)
    want = [(i, j, s) for i, x in enumerate(sides[0]) for j, y in enumerate(sides[1][: upto[i]]) if (s := len(np.intersect1d(x, y))) >= 2]
    flat = [(np.array([len(x) for x in side]), np.concatenate(side)) for side in sides]
    got = [z for i, j, s in overlaps.shared_counts(*flat, upto, 2) for z in zip(i.tolist(), j.tolist(), s.tolist(), strict=True)]
    assert got == want


def test_graph_paths_and_cycles(spark):
    n = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "node_id long, title string")
    e = spark.createDataFrame([(0, 1, "no"), (0, 2, "yes"), (1, 3, "yes"), (3, 1, "no"), (3, 4, "yes")], "from_node long, to_node long, condition string")
    assert [r.path for r in graphs.paths(n, e).orderBy("place").collect()] == [[0, 2], [0, 1, 3, 4]]
    assert {(r.code, r.id) for r in graphs.topology(n, e).collect()} == {("missing_branch", "1")}


def test_graphs_apart(spark):
    n = spark.createDataFrame([(g, k, f"n{k}") for g in (1, 2) for k in range(3)] + [(3, 0, "N0"), (3, 1, "n0")], "g long, node_id long, title string")
    e = spark.createDataFrame([(1, 0, 1, "no"), (1, 0, 2, "yes"), (2, 0, 1, "yes"), (2, 1, 0, "no"), (2, 1, 2, "no"), (2, 1, 2, "no"), (2, 2, 9, "yes")], "g long, from_node long, to_node long, condition string")
    by = ("g",)
    assert [(r.g, r.root, r.path, r.place) for r in graphs.paths(n, e, by=by).orderBy("g", "root", "place").collect()] == [(1, 0, [0, 2], 1), (1, 0, [0, 1], 2), (3, 0, [0], 1), (3, 1, [1], 1)]
    want = {(3, "duplicate_label", "n0"), (2, "unknown_endpoint", "9"), (2, "duplicate_edge", "1>2"), (3, "disconnected", "0"), (3, "disconnected", "1"), (2, "missing_branch", "0"), (2, "missing_branch", "2")}
    assert {(r.g, r.code, r.id) for r in graphs.topology(n, e, by).collect()} == want
    nodes, edges = graphs.compile_graph(n, e, by)
    assert nodes.where("node_id < 0").count() == 6
    assert {(r.g, r.from_node, r.to_node) for r in edges.where("condition in ('start', 'end')").collect()} == {(1, -1, 0), (1, 1, -2), (1, 2, -2), (3, -1, 0), (3, -1, 1), (3, 0, -2), (3, 1, -2)}
    assert graphs.paths(n.limit(0), e.limit(0), by=by).count() == 0


def test_graph_paths_alike_in_rows_and_by_joins(spark):
    rng = random.Random(3)
    n = spark.createDataFrame([(g, k, "") for g in range(20) for k in range(rng.randint(1, 7))] + [(None, 1, ""), (9, None, "")], "g long, node_id long, title string")
    e = spark.createDataFrame([(g, rng.randint(0, 6), rng.choice([*range(7), None]), rng.choice(["yes", "no"])) for g in range(20) for _ in range(rng.randint(0, 5))], "g long, from_node long, to_node long, condition string")
    rows = [sorted((r.g, r.root, r.place, r.path, [str(c) for c in r.conditions]) for r in graphs.paths(n, e, by=("g",), small=small).collect()) for small in ((64, 24), (4, 4), (0, 0))]
    assert len(rows[0]) > 20 and max(len(r[3]) for r in rows[0]) > 2 and rows[0] == rows[1] == rows[2]
    assert graphs.paths(n.where("g is not null"), e, by=("g",))._jdf.queryExecution().executedPlan().toString().count("Join") <= 2


def test_exact_search_asks_from_the_whole_table(spark, tmp_path):
    from corpusloom.plans import registry

    rng = random.Random(2)
    vecs = {k: [rng.gauss(0, 1) for _ in range(8)] for k in range(160)}
    spark.createDataFrame([(k, v, 0) for k, v in vecs.items()], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = registry.queries()["j4_exact_knn_all"](spark, str(tmp_path)).collect()
    norm = {k: sum(x * x for x in v) ** 0.5 for k, v in vecs.items()}
    for q in (0, 50, 100, 150):
        score = {k: sum(x * y for x, y in zip(v, vecs[q], strict=True)) / norm[k] / norm[q] for k, v in vecs.items()}
        assert [r.chunk_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])] == sorted(score, key=lambda k: (-round(score[k], 9), k))[:30]
    assert len(rows) == 4 * 30


def test_merge_scores_only_what_both_found(spark):
    k = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 1.0, 2)], "q long, d long, lexical_score double, rank int")
    v = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2)], "q long, d long, vector_score double, rank int")
    got = {r.d: round(r.fusion_score, 6) for r in retrieval.merge_sources(k, v, "q", "d").collect()}
    assert got == {1: 0.0, 2: round(1 / 62 + 1 / 61, 6), 3: 0.0}


def test_config_changes_rank(spark):
    assert ranking.ranking_config({"unit_scores": {"rule": 1.0}})["unit_scores"] == {**ranking.DEFAULTS["unit_scores"], "rule": 1.0}
    assert ranking.DEFAULTS["unit_scores"]["rule"] == 20.0


def test_normalisers(spark):
    row = spark.createDataFrame([("Đặt  HÀNG_Tại quầy?!",)], "x string").select(T.normalize_phrase(F.col("x")), T.normalize_text(F.col("x")), T.normalize_key(F.col("x")), T.normalize_match(F.col("x")), T.portal_normalize(F.col("x"))).first()
    assert tuple(row) == ("dat hang tai quay", "dat hang_tai quay?!", "dat_hang_tai_quay", "dat hang tai quay", "đặt hàng tại quầy")


def test_no_python_or_cartesian_in_core_plans(spark):
    from corpusloom.plans import registry

    for name in ("k24_hybrid_retrieve", "j3_lexical_bm25", "k20_reconcile", "a15_publish_readiness", "j16_click_attribution", "k3_chunk"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "Python" not in plan and "NestedLoop" not in plan, name


@pytest.mark.parametrize(("k", "block", "first"), [(1, 2, 1), (3, 4, 1), (3, 1, 2), (50, 8, 2), (5, 1000, 2)])
def test_block_maxima_give_the_exact_best(spark, k, block, first):
    rng = random.Random(k * block)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(vocab, weights=[1 / (i + 1) for i in range(40)], k=n))
    docs = spark.createDataFrame([(i, text(rng.randint(1, 30))) for i in range(60)] + [(100, ""), (101, None), (102, "w39 " * 50), (103, "w39 " * 50)], "d long, t string")
    asked = spark.createDataFrame([(i, text(rng.randint(1, 6))) for i in range(8)] + [(50, "unknown"), (51, ""), (52, "w39")], "q long, t string")
    every = {}
    for r in retrieval.bm25(asked, docs, "q", "t", "d", "t").collect():
        every.setdefault(r.q, []).append((-round(r.lexical_score, 9), r.d))
    expected = sorted((q, place + 1, d) for q, rows in every.items() for place, (_, d) in enumerate(sorted(rows)[:k]))
    found = retrieval.bm25_top(asked, docs, "q", "t", "d", "t", k, block=block, first=first).collect()
    assert sorted((r.q, r["rank"], r.d) for r in found) == expected


@pytest.mark.parametrize("block", [3, 4_000])
def test_similar_sets_are_all_pairs(spark, block):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(n)] for n in (1, 5, 12, 30, 30)]
    rows = [(9, "alpha beta gamma"), (9, "one two three four"), (9, "one two three four"), (3, "One  two three; four"), (4, None), (5, ""), (6, " ?! "), (None, "alpha beta gamma")]
    rows += [(100 + k, " ".join(w if rng.random() > 0.06 else rng.choice(words) for w in base[k % 5])) for k in range(90)]
    rows += [(300, "long " + " ".join(f"x{k}" for k in range(20_000))), (301, " ".join(f"x{k}" for k in range(18_000)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found, sets, reps = similarity.set_classes(docs, "doc_id", "text")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.class_id or -1, r.n_copies, r.n_links) for r in similarity.link_counts(docs, "doc_id", "text", found, similarity.similar_sets(sets, reps, 82, block, 1 << 10)).collect())
    bags = [(i, frozenset(re.findall(r"\w+", (t or "").lower()))) for i, t in rows]
    want = []
    for i, s in bags:
        same = [j for j, o in bags if o == s and j is not None]
        near = [j for j, o in bags if j is not None and o != s and o and 100 * len(s & o) >= 82 * max(len(s), len(o))]
        want.append((i is None, i or 0, min(same), len(same) - 1, len(near)) if s and i is not None else (i is None, i or 0, -1, 0, 0))
    assert got == sorted(want) and max(w[4] for w in want) > 5
    empty, none, no_reps = similarity.set_classes(docs.limit(0), "doc_id", "text")
    assert similarity.link_counts(docs.limit(0), "doc_id", "text", empty, similarity.similar_sets(none, no_reps)).count() == 0


@pytest.fixture(scope="module")
def near_copies(tmp_path_factory):
    """Documents in groups of near copies, some with one id for two near texts."""
    import pyarrow.parquet as pq

    rng = random.Random(12)
    words = [f"w{k}" for k in range(50)]
    base = [[rng.choice(words) for _ in range(n)] for n in (1, 6, 15, 30, 40)]
    texts = [" ".join(w if rng.random() > 0.05 else rng.choice(words) for w in base[k % 5]) for k in range(120)]
    rows = [(k % 100, t) for k, t in enumerate(texts)] + [(200, "É e one"), (201, "one e"), (202, ""), (None, texts[3]), (204, None), (205, " ?! "), (206, "é"), (207, "日本"), (208, "\u0301")]
    path = tmp_path_factory.mktemp("near")
    pq.write_table(pa.table({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows]}), path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["j18_similar_class_pairs", "j18_similar_documents", "k20_duplicate_documents"])
@pytest.mark.parametrize("target", [300, 16_000_000])
def test_similar_documents_by_blocks(spark, near_copies, monkeypatch, name, target):
    from corpusloom.plans import registry

    def in_blocks(*a):
        return blocks(*a[:3], target)

    blocks = similarity.size_blocks
    monkeypatch.setattr(similarity, "size_blocks", in_blocks)
    out = registry.queries()[name](spark, near_copies)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{near_copies}/documents.parquet' WHERE doc_id IS NOT NULL")
    want = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    shown = lambda rows: sorted(tuple(str(x) for x in r) for r in rows)
    got = out.select(*names).collect() if name != "j18_similar_documents" else out.select(*names).where("doc_id is not null").collect()
    assert len(got) > 50 and shown(got) == shown(want.fetchall())


def test_similar_class_pairs_go_through_no_shuffle(spark, near_copies):
    plan = relation_plans.j18_similar_pairs(spark, near_copies)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_duplicates_leave_a_task_as_the_best_ones(spark, near_copies):
    _, _, sets, reps = relation_plans._set_classes(spark, near_copies)
    every, best = similarity.similar_sets(sets, reps).count(), similarity.best_links(sets, reps, 2).count()
    assert best <= 2 * reps.count() < every


def test_size_blocks_meet_all_sizes_that_can_be_linked():
    rng = np.random.default_rng(2)
    sizes = np.unique(rng.integers(1, 400, 90))
    counts = rng.integers(1, 30, len(sizes))
    counts[20] = 5_000
    first, parts, low, blocks = similarity.size_blocks(sizes, counts, 82, 20_000)
    assert parts[20] > 1 and blocks == (first + parts).max() and (low <= first).all()
    for k, big in enumerate(sizes):
        for j, small in enumerate(sizes[: k + 1]):
            assert 100 * small < 82 * big or first[j] >= low[k]


def test_lexical_search_lists_every_pair_that_shares_a_term(spark, tmp_path):
    from corpusloom.plans import registry

    docs = [(k, "common word" if k < 300 else None if k == 300 else "nothing") for k in range(302)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "common"), (2, "absent")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = registry.queries()["j3_lexical_bm25"](spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.chunk_id) for r in rows) == [(1, k) for k in range(300)]
    mean = (300 * 2 + 1) / 302
    idf = math.log(1 + (302 - 300 + 0.5) / (300 + 0.5))
    assert {r.lexical_score for r in rows} == {round(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / mean)), 6)}


def test_expansions_take_no_text_along(spark):
    queries = spark.createDataFrame([(1, "go out of the red box"), (2, "of"), (3, ""), (4, "the box of"), (5, None), (1, "box")], "id int, n string")
    synonyms = spark.createDataFrame([(1, "of the"), (1, "out of the red"), (1, "thereof"), (2, "box"), (2, "case"), (3, ""), (3, "void"), (4, "the red box of"), (4, "x")], "group_id int, term string")
    out = ranking.expand_query(queries, "id", "n", synonyms)
    assert {r.id: r.expansions for r in out.collect()} == {1: ["case", "of the", "out of the red", "thereof"], 4: ["case"]}
    assert ranking.expand_query(queries, "id", "n", synonyms.limit(0)).count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 2 and "contains" not in " ".join(joins).lower()  # texts stay below the joins


def test_intents_take_texts_apart_once(spark):
    queries = spark.createDataFrame([(1, "The dog and der Hund"), (2, "und der"), (3, "x"), (4, None)], "id int, text string").select("id", T.normalize_phrase(F.col("text")).alias("n"))
    out = ranking.seed_intent(queries, "id", "n", {"english": ["the", "and", "of the"], "german": ["der", "und"]})
    assert {r.id: (r.intent, r.matches) for r in out.collect()} == {1: ("english", 2), 2: ("german", 2)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_sets_are_written_and_shuffled_in_a_few_bytes_a_token(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.4)) % 4000}" for _ in range(400))) for k in range(60)], "doc_id long, text string")
    _, sets, reps = similarity.set_classes(docs, "doc_id", "text")
    frequent = similarity.frequent_tokens(sets, 900)
    counts = similarity.bucket_counts(sets, 64)
    whole = {r.rep: set(r.ts) for r in sets.collect()}
    assert counts.tolist() == [sum(t % 64 == k for ts in whole.values() for t in ts) for k in range(64)] and len(frequent) == 900
    rows = similarity.coded_sets(sets, frequent).toArrow()
    near, far = (rows.column(k).combine_chunks() for k in ("near", "far"))
    row, t = similarity._tokens(near, far, frequent)
    back = {rep: set() for rep in whole}
    for k, x in zip(rows.column("rep").to_numpy()[row].tolist(), t.tolist(), strict=True):
        back[k].add(x)
    others = len(far.flatten())
    assert back == whole and 0 < others < len(t) // 2
    assert sum(len(x) for x in near.to_pylist()) < 2 * (len(t) - others)  # eight bytes a token before
    assert similarity.similar_sets(sets, reps, consume=True).count() >= 0
    with pytest.raises(Exception, match="(?i)path|file"):
        sets.collect()


def test_hashed_words_are_summed_before_they_are_shuffled(spark):
    docs = spark.createDataFrame([(1, "go up go down"), (1, "up"), (2, "?"), (3, None), (4, "one")], "id int, text string")
    out = retrieval.hashed_vectors(docs, "id", "text")
    got = {r.id: [round(x, 9) for x in r.v] for r in out.collect()}
    want = {}
    for i, words in ((1, ["go", "up", "go", "down", "up"]), (4, ["one"])):
        v = [0] * 64
        for w in words:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % 64] += 1 if int(h[8], 16) % 2 == 0 else -1
        want[i] = [round(x / math.sqrt(sum(y * y for y in v)), 9) for x in v]
    assert got == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2  # no grouping by words

"""Nested sections against a plain stack walk, boxes against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import ordering, sections, spatial


def walk(rows, levels):
    """Open headings of each block by a stack."""
    out, stack, doc = [], [], None
    for d, index, level, title in sorted(rows, key=lambda r: r[:2]):
        if d != doc:
            stack, doc = [], d
        if level is not None:
            level = min(max(level, 1), levels)
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, index, title))
        out.append((d, index, [(i, t) for _, i, t in stack]))
    return out


@pytest.mark.parametrize("width", [65_536, 5])
def test_open_sections_equal_a_stack(spark, monkeypatch, width):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([None, None, None, 0, 1, 2, 3, 4, 9]), f"t{rng.randrange(5)}") for d in range(4) for i in range(d * 17 + 3)]
    monkeypatch.setattr(sections, "running_max", lambda *a, **k: ordering.running_max(*a, width=width))
    df = sections.open_sections(spark.createDataFrame(rows, "doc int, i long, level int, title string"), "doc", "i", "level", "title", 4)
    assert sorted((r.doc, r.i, [(p["index"], p["title"]) for p in r.path]) for r in df.collect()) == walk(rows, 4)


BLOCKS = [
    (1, 0, 1, "heading", None, "Chính sách phản hồi"),
    (1, 1, None, "paragraph", None, "CS xin lỗi khách hàng qua email"),
    (1, 2, 2, "heading", None, "Chế tài"),
    (1, 3, None, "paragraph", None, "Tuyệt đối không cung cấp chế tài"),
    (1, 4, None, "list_item", "l1", "Nếu đã hoàn tiền thì báo qua chat"),
    (1, 5, None, "list_item", "l1", "Nếu chưa hoàn tiền: gọi hotline"),
    (1, 6, 1, "heading", None, "Khác"),
    (1, 7, None, "paragraph", None, "Bị chấm lỗi"),
    (1, 8, None, "paragraph", None, "chẳng có gì"),
    (1, 9, None, "paragraph", None, "  "),
    (2, 0, None, "paragraph", None, None),
    (2, 1, None, "paragraph", None, "Lưu ý: đọc kỹ"),
]


def test_units_groups_and_inherited_fields(spark):
    df = sections.sectioned_units(spark.createDataFrame(BLOCKS, "doc int, index long, level int, kind string, list_group string, text string"), "doc", T.normalize_match)
    rows = {(r.doc, r.unit_id): r for r in df.collect()}
    by_index = {i: rows[1, f"unit_{i}"] for i in (1, 3, 4, 5, 7)}
    assert {i: r.unit_type for i, r in by_index.items()} == {1: "wording_rule", 3: "compliance_rule", 4: "handling_rule", 5: "handling_rule", 7: "warning"}
    assert (1, "unit_8") not in rows and (1, "unit_9") not in rows and (2, "unit_0") not in rows
    assert (by_index[3].risk_level, by_index[3].risk_category) == ("critical", "prohibited_disclosure")
    assert (by_index[7].risk_level, by_index[7].channels) == ("high", "call,chat,email")  # of the document
    group = rows[1, by_index[4].parent_unit_id]
    assert by_index[4].parent_unit_id == by_index[5].parent_unit_id and (group.chunk_type, group.n_children) == ("grouped_parent", 2)
    inner = rows[1, group.parent_unit_id]
    assert (inner.section, inner.risk_level) == ("Chính sách phản hồi > Chế tài", "critical")
    assert rows[1, inner.parent_unit_id].section == "Chính sách phản hồi" and rows[1, rows[1, inner.parent_unit_id].parent_unit_id].parent_unit_id is None
    assert (by_index[4].condition, by_index[4].action) == (None, None)
    assert (rows[2, "unit_1"].parent_unit_id, rows[2, "full_sop"].risk_level) == ("full_sop", "medium")
    assert df.limit(0).count() == 0


def test_rule_words_go_through_the_shuffle_and_texts_do_not(spark, tmp_path, monkeypatch):
    import duckdb

    from corpusloom.plans import registry

    rng = random.Random(4)
    words = "la it The of De und mit avec été pour are die Elle est stupid idiote ist inoran the an en In, from que straße ça".split() + ["la.", "A", "(the", "der-die", "l\u0301a"]
    lines = lambda: [" ".join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 4, 5, 5, 8, 12]))) for _ in range(60)]
    texts = ["\n".join([*lines(), "la " + "filler Füller " * 400 + "stupid", "", "  it  ", "it", "it was " + "word " * 900, *lines()]) for _ in range(3)]
    spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    shuffled, placed = [], sections.open_sections
    monkeypatch.setattr(sections, "open_sections", lambda df, *a, **k: (shuffled.append(df), placed(df, *a, **k))[1])
    df = registry.queries()["k6_sectioned_policy_units"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()['k6_sectioned_policy_units']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert len(want) > 300 and sorted(got, key=repr) == sorted(want, key=repr)
    assert {r[3] for r in got} >= {"wording_rule", "example", "operational_note", "macro_script", "handling_rule", "warning", "compliance_rule"}
    assert shuffled[0].agg(F.max(F.length("plain"))).first()[0] < 200


def test_normalised_texts_with_and_without_accents(spark):
    texts = ["", " ", "Plain TEXT, 2 words!", "Été Đường", "e\u0301a \u212aelvin İst ß \uff29\uff34", "A\u0000b\tc\nd", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.trim(F.regexp_replace(F.lower(T.strip_accents(F.col("t"))), "[^a-z0-9]+", " "))
    rows = df.select(T.normalize_match(F.col("t")).alias("a"), whole.alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == ["", "", "plain text 2 words", "ete duong", "ea kelvin ist it", "a b c d", None]


def boxes(rng, n, far):
    out = []
    for i in range(n):
        x, y = rng.uniform(-far, far), rng.uniform(-far, far)
        w, h = rng.choice([1, 5, 40, 900]) * rng.random(), rng.choice([1, 5, 40, 900]) * rng.random()
        out.append((rng.choice("pq"), i, [x, y, x + w, y + h]))
    return out


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(2)
    a, b = boxes(rng, 60, 300), boxes(rng, 60, 300)
    bad = [("p", 900, None), ("p", 901, [1.0, 1.0, 1.0, 9.0]), ("p", 902, [float("nan"), 0.0, 1.0, 1.0]), (None, 903, [0.0, 0.0, 9.0, 9.0])]
    left, right = (spark.createDataFrame(x + bad, f"page string, {i} long, box array<double>") for x, i in ((a, "a"), (b, "b")))
    both = lambda p, q: max(0, min(p[2], q[2]) - max(p[0], q[0])) * max(0, min(p[3], q[3]) - max(p[1], q[1]))
    expected = sorted((p, i, j) for p, i, x in a for q, j, y in b if p == q and both(x, y) > 0)
    for cell in (4.0, 64.0, 5000.0):
        assert sorted((r.page, r.a, r.b) for r in spatial.overlapping(left, right, "page", "a", "b", cell).collect()) == expected
    gone = {i for p, i, x in a if any(p == q and both(x, y) >= 0.5 * (x[2] - x[0]) * (x[3] - x[1]) for q, _, y in b)}
    assert {r.a for r in spatial.uncovered(left, right.select("page", "box"), "page", "a", 0.5, 16.0).collect()} == {i for _, i, _ in a} - gone | {900, 901, 902, 903}
    assert spatial.overlapping(left.limit(0), right, "page", "a", "b").count() == 0


@pytest.mark.parametrize("flat", [True, False])
def test_nearest_equals_all_pairs(spark, flat):
    rng = random.Random(3)
    spot = lambda far: (rng.gauss(0, far), 0.0 if flat else rng.gauss(0, far))
    nodes = [(rng.choice("pq"), i, *spot(rng.choice([1, 50, 2000]))) for i in range(80)] + [("p", 500, 7.0, 0.0), ("p", 501, 9.0, 0.0)]
    points = [(rng.choice("pqr"), i, *spot(rng.choice([1, 50, 4000]))) for i in range(80)] + [("p", 90, 8.0, 0.0), ("p", 91, None, 0.0)]
    n, p = spark.createDataFrame(nodes, "page string, node long, x double, y double"), spark.createDataFrame(points, "page string, note long, x double, y double")
    expected = {}
    for page, i, x, y in points:
        near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for q, j, u, v in nodes if q == page) if x is not None else []
        if near:
            expected[i] = near[0][1]
    assert {r.note: r.node for r in spatial.nearest(p, n, "page", "note", "node").collect()} == expected
    assert spatial.nearest(p, n.where(F.lit(False)), "page", "note", "node").count() == 0
    assert spatial.nearest(p.where(F.lit(False)), n, "page", "note", "node").count() == 0


def test_half_covered_boxes_go_by_their_sides_as_in_the_sql(spark, tmp_path):
    import duckdb

    from corpusloom.plans import registry

    lines = [(2, 97, 1, 1, 6.0, 0.07, 0.05, "N"), (2, 194, 1, 2, 40.0, 0.04, 0.0, "R"), (2, 97, 2, 1, 5.0, 0.07, 0.07, "N"), (2, 194, 2, 2, 30.0, 0.07, 0.01, "R")]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(97, "red bolt"), (194, "blue gear")], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = registry.queries()["d60_layout_semantic_nodes"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()['d60_layout_semantic_nodes']})").fetchall()
    assert len(want) == 4 and sorted(map(tuple, df.collect())) == sorted(want)


def test_nodes_and_points_at_one_place_meet_once(spark):
    n = spark.createDataFrame([(1, k, float(k % 3), 0.0) for k in range(300)], "page int, node int, x double, y double")
    p = spark.createDataFrame([(1, k, 0.4 + k % 2, 0.0) for k in range(200)], "page int, note int, x double, y double")
    found = spatial.nearest(p, n, "page", "note", "node")
    assert {(r.note, r.node) for r in found.collect()} == {(k, k % 2) for k in range(200)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    met = [x for x in plan.splitlines() if "LeftOuter" in x]
    assert met and "note" not in " ".join(met) and "min(node" in plan

"""Workbook plans, layout elements, atomic units and display contexts on tiny frames."""

import random

from corpusloom.operators import display, enrichment, layout, workbook

KINDS = {"routers": ("rider_issue_router", "issues"), "index": ("general_sop_index", "core"), "tools": ("tool_directory", "tools")}
ROWS = [
    ("w", "Routers", 1, ["No", "Issue", "SOP"], ["7", "Lost bag", "Bags"]),
    ("w", "Index", 2, ["No", "Name", "SOP"], ["1", "Refunds", "link"]),
    ("w", "tools", 3, ["Name", "SOP"], ["https://a.org/x", "Bags"]),
    ("w", "Elsewhere", 4, ["A", "B"], [None, "  "]),
    ("w", None, 5, ["A"], ["Free text"]),
    (None, "Routers", 6, ["Issue"], ["Call late"]),
]
SHAPE = "workbook string, sheet string, row long, headers array<string>, values array<string>"


def test_plan_of_a_workbook(spark):
    plan = workbook.index_plan(spark.createDataFrame(ROWS, SHAPE), KINDS, actions={"call": ["call"]})
    got = {r.row: r for r in plan.collect()}
    assert sorted(got) == [1, 2, 3, 5, 6]
    assert (got[1].title, got[1].target_title, got[1].relation_type, got[1].bucket) == ("Lost bag", "Bags", "requires", "issue_router_units")
    assert (got[2].target_title, got[2].relation_type) == ("Refunds", "references")
    assert (got[3].title, got[3].target_title, got[3].url) == ("Bags", None, "https://a.org/x")
    assert (got[5].candidate_type, got[5].target_title, got[5].collection) == ("sop_reference", None, "core")
    assert [r.row for r in plan.where("action = 'call'").collect()] == [6]
    titles = spark.createDataFrame([("bags", 1), ("refunds", 2), ("Refunds", 3)], "title string, target_id long")
    found = {r.row: (r.target_id, r.status) for r in workbook.plan_relations(plan, titles).collect()}
    assert found == {1: (1, "resolved"), 2: (None, "unresolved")}


def test_units_of_a_plan_are_numbered_per_workbook(spark):
    plan = workbook.index_plan(spark.createDataFrame(ROWS, SHAPE), KINDS, actions={"call": ["call"]})
    rows = sorted(workbook.plan_units(plan).collect(), key=lambda r: (str(r.workbook), r.chunk_index))
    assert [(r.chunk_index, r.section) for r in rows if r.workbook is None] == [(0, "full_sop"), (1, "text_section"), (2, "issue_router_unit"), (3, "quick_action_rule")]
    assert [r.section for r in rows if r.workbook == "w"] == ["full_sop", "text_section", "text_section", "text_section", "issue_router_unit", "sop_reference", "sop_reference", "tool_link"]
    assert workbook.plan_units(plan.where("false")).count() == 0


def test_layout_elements_and_flows(spark):
    nodes = spark.createDataFrame([(1, 1, " ", None), (1, 2, "End", 0.9), (None, 3, "Lost", 0.5)], "g int, node_id long, title string, confidence double")
    edges = spark.createDataFrame([(1, 1, 1, 2, " YES", None, True), (1, 2, 1, 2, None, None, None), (1, 3, 1, 9, "", 0.6, False)], "g int, edge_id int, from_node long, to_node long, condition string, confidence double, has_source boolean")
    got = {(r.kind, r.element_id): r for r in layout.layout_elements(nodes, edges, "g").collect()}
    assert len(got) == 8
    assert (got["graph_node", "graph_node_1"].text, got["graph_node", "graph_node_1"].confidence) == ("1", 0.75)
    assert [(got["graph_edge", f"graph_edge_{i}"].text, got["graph_edge", f"graph_edge_{i}"].confidence) for i in (1, 2, 3)] == [("1 --yes--> 2", 0.72), ("1 --next--> 2", 0.45), ("1 --next--> 9", 0.6)]
    assert {k[1] for k in got if k[0] == "flows_to"} == {"flows_to_graph_edge_1", "flows_to_graph_edge_2"}
    assert got["flows_to", "flows_to_graph_edge_2"].missing_evidence


def test_atomic_units(spark):
    nodes = spark.createDataFrame([(1, 1, "start", "S", "", 0.5), (1, 2, "decision", "Paid in 5 phút?", None, 0.5), (1, 3, "action", "", "Trả lời trong 15 phút", 0.5), (1, 4, None, "Liên hệ khách", None, 0.5), (1, 5, "action", " ", None, 0.5), (1, 6, "action", "Other", "x" * 300, 0.5)], "g int, node_id int, node_type string, title string, content string, confidence double")
    notes = spark.createDataFrame([(1, 1, "audit_rule", None, None, 0.9), (1, 2, None, "N", "c", 0.5)], "g int, annotation_id int, kind string, title string, content string, confidence double")
    links = spark.createDataFrame([(1, 1, "Bags", None, 0.95), (1, 2, None, "seen", 0.1)], "g int, relation_id int, target_title string, evidence string, confidence double")
    got = {(r.retrieval_scope, r.source_key): r for r in layout.atomic_graph_units(nodes, notes, links, "g").collect()}
    assert {k[1]: r.unit_type for k, r in got.items() if k[0] == "unit"} == {"2": "decision_point", "3": "sla_rule", "4": "handoff_rule", "6": "workflow_step"}
    assert len(got["unit", "6"].content) == 300
    assert [(got["annotation", k].unit_type, got["annotation", k].confidence) for k in "12"] == [("warning", 0.78), ("operational_note", 0.5)]
    assert [(got["relation", k].content, got["relation", k].confidence) for k in "12"] == [("Related document: Bags", 0.9), ("seen", 0.1)]


def test_display_context(spark):
    body = "Đơn hàng: gọi lại.\n\nCall the rider, then wait ten minutes.\n\n" + "word, " * 20000
    sections = spark.createDataFrame([(1, 0, body)], "version_id int, section_id int, section_text string")
    contexts = spark.createDataFrame([(1, 1), (2, 1)], "version_id int, context_version_id int")
    texts = ["Call the rider", "call  RIDER", "rider THEN wait", "minutes waiting: call rider wait", "", None, "word " * 15000, "nothing here"]
    hits = [(i, 1, 0, x) for i, x in enumerate(texts)] + [(90, 2, 0, "a"), (91, 3, 0, "b"), (92, 1, 5, None), (93, None, 0, "c")]
    got = {r.hit_id: r for r in display.display_context(spark.createDataFrame(hits, "hit_id int, version_id int, section_id int, content string"), contexts, sections).collect()}
    assert len(got) == len(hits)
    assert [got[i].strategy for i in range(8)] == ["exact", "paragraph", "normalized", "paragraph", "unmatched", "unmatched", "normalized", "unmatched"]
    assert body[got[0].start_offset : got[0].end_offset] == "Call the rider"
    assert body[got[2].start_offset : got[2].end_offset] == "rider, then wait"
    assert body[got[3].start_offset : got[3].end_offset] == "Call the rider, then wait ten minutes."
    assert body[got[6].start_offset : got[6].end_offset].count("word") == 15000
    assert [(got[i].status, got[i].reason) for i in (90, 91, 92, 93)] == [("version_mismatch", "retrieval_version_does_not_match_display_context"), ("parent_missing", "display_context_not_loaded"), ("parent_missing", "section_parent_not_found"), ("parent_missing", "display_context_not_loaded")]
    assert got[91].fallback == "b" and got[92].fallback == "" and got[0].fallback == ""


def test_enrichment_by_id_code_and_words(spark):
    nodes = [(1, "a", "action", "Short"), (1, "b", "action", "2.1 Wait"), (1, "c", None, "call the rider again"), (1, "d", "end", None), (None, "e", "action", "call the rider again")]
    semantic = [(1, "a", "decision", "Much longer text"), (1, "a", "action", "x"), (1, "p", "decision", "2.1) Wait, then decide on it"), (1, "q", "sla_rule", "2.1) Wait"), (1, "r", "warning", "now call the rider again please"), (1, None, "end", "call the rider again")]
    got = enrichment.enrich_nodes(spark.createDataFrame(nodes, "g int, node_id string, node_type string, content string"), spark.createDataFrame(semantic, "g int, semantic_id string, semantic_type string, semantic_content string"), "g").collect()
    assert {r.node_id: (r.matched_by, r.semantic_id, r.node_type) for r in got} == {"a": ("id", "a", "decision"), "b": ("code", "q", "action"), "c": ("words", "r", "annotation"), "d": ("", None, "end"), "e": ("", None, "action")}
    assert {r.node_id: r.content for r in got}["a"] == "Much longer text"


def test_enrichment_by_words_misses_no_pair(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abcdefghij") * 2 for _ in range(rng.randint(0, 7)))
    nodes = [(rng.randint(0, 2), f"n{i:02}", "action", text()) for i in range(40)]
    semantic = [(rng.randint(0, 2), f"s{i:02}", "action", text()) for i in range(40)]
    want = {}
    for g, i, _, x in nodes:
        a = set(x.split())
        scored = [(-len(a & set(y.split())) / min(len(a), len(set(y.split()))), k) for h, k, _, y in semantic if h == g and a and y]
        want[i] = min((p for p in scored if p[0] <= -0.72), default=(0, None))[1]
    got = enrichment.enrich_nodes(spark.createDataFrame(nodes, "g int, node_id string, node_type string, content string"), spark.createDataFrame(semantic, "g int, semantic_id string, semantic_type string, semantic_content string"), "g").collect()
    assert {r.node_id: r.semantic_id for r in got} == want


def test_candidate_to_review(spark):
    rows = [(1, 1, "workflow_legacy", 5, 5, 0.9), (1, 2, "workflow_v3_graph_primary", 1, 9, 0.9), (1, 3, "workflow_v2_vision_primary", 2, 1, None), (1, 4, "workflow_v2_vision_primary", 2, 1, 0.0), (2, 5, "semantic_workflow_structuring", 9, 9, 1.0), (None, 6, None, 2, 1, None), (None, 7, None, None, 1, None)]
    got = enrichment.review_candidates(spark.createDataFrame(rows, "doc int, candidate_id int, flow string, nodes int, edges int, score double"), "doc").collect()
    assert {r.candidate_id for r in got if r.selected} == {3, 6}
    assert {r.candidate_id for r in got if r.reviewable} == {1, 3, 4, 6}
    assert {r.candidate_id: r.candidate_count for r in got} == {1: 4, 2: 4, 3: 4, 4: 4, 5: 1, 6: 2, 7: 2}


def test_semantic_candidates(spark):
    nodes = [(1, 1, None, "Call", None), (1, 2, "annotation", "Note", " (a1) "), (1, 3, "annotation", "", "(a1) wait"), (1, 4, "start", "Go", "Go"), (1, 5, "odd", " ", None), (1, 6, "macro_script", None, "x" * 300)]
    edges = [(1, 1, 3), (1, 3, 3), (2, 1, 6), (1, None, 6)]
    got = enrichment.semantic_candidates(spark.createDataFrame(nodes, "g int, semantic_id int, semantic_type string, title string, content string"), spark.createDataFrame(edges, "g int, from_node int, to_node int"), "g").collect()
    assert {r.semantic_id: (r.unit_type, len(r.heading), len(r.content), r.uncertain_edges) for r in got} == {1: ("candidate_action", 4, 4, 1), 3: ("candidate_annotation", 9, 9, 2), 6: ("macro_script", 180, 300, 1)}


def test_sections_are_normalised_once_for_all_their_hits(spark):
    hits = spark.createDataFrame([("1:0", 1, 0, "Red box"), ("1:1", 1, 0, "red - BOX"), ("1:2", 1, 0, "boxes green opens"), ("1:3", 1, 0, " ")], "hit_id string, version_id int, section_id int, content string")
    contexts = spark.createDataFrame([(1, 1)], "version_id int, context_version_id int")
    sections = spark.createDataFrame([(1, 0, "The Red box\n\nopens green boxes")], "version_id int, section_id int, section_text string")
    out = display.display_context(hits, contexts, sections)
    assert {r.hit_id: (r.strategy, r.start_offset, r.end_offset) for r in out.collect()} == {"1:0": ("exact", 4, 11), "1:1": ("normalized", 4, 11), "1:2": ("paragraph", 13, 30), "1:3": ("unmatched", None, None)}
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "translate(section_text" not in above


def test_nodes_are_enriched_alike_in_lists_and_by_joins(spark):
    rng = random.Random(5)
    name = lambda: " ".join(rng.choices(["red", "blue", "gear", "bolt", "ring", "rod"], k=rng.randint(0, 4)))
    kinds = ["decision", "action", "sla_rule", "warning", "", None]
    nodes = spark.createDataFrame([(g, str(k), rng.choice(kinds), f"{rng.randint(1, 9)}. {name()}") for g in range(6) for k in range(5)] + [(None, "1", "", "x"), (7, "1", "", "alone")], "g int, node_id string, node_type string, content string")
    found = [(g, rng.choice(["0", "1", "p1", "p2", "p3", None]), rng.choice(kinds), rng.choice([None, f"{rng.randint(1, 9)}) {name()}"])) for g in range(6) for _ in range(3 + 20 * (g == 3))]
    semantic = spark.createDataFrame(found, "g int, semantic_id string, semantic_type string, semantic_content string")
    rows = [sorted(map(repr, enrichment.enrich_nodes(nodes, semantic, "g", small=k).collect())) for k in (64, 10, 0)]
    assert len(rows[0]) == 32 and rows[0] == rows[1] == rows[2]
    assert {k: sum(f"matched_by='{k}'" in r for r in rows[0]) > 0 for k in ("id", "code", "words", "")} == dict.fromkeys(("id", "code", "words", ""), True)


def test_small_graphs_are_enriched_with_few_shuffles(spark):
    nodes = spark.createDataFrame([(1, "1", "action", "1. red gear")], "g int, node_id string, node_type string, content string")
    semantic = spark.createDataFrame([(1, "p", "warning", "2) red gear box")], "g int, semantic_id string, semantic_type string, semantic_content string")
    df = enrichment.enrich_nodes(nodes, semantic, "g")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 4
    assert [(r.matched_by, r.semantic_id, r.node_type, r.content) for r in df.collect()] == [("words", "p", "annotation", "2) red gear box")]

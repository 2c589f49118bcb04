"""Queries: workbooks, layouts and graphs as plans, elements and units; display contexts of hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import display as DC
from corpusloom.operators import enrichment as EN
from corpusloom.operators import graphs as GR
from corpusloom.operators import layout as L
from corpusloom.operators import workbook as W
from corpusloom.plans.registry import query
from corpusloom.plans.relations import GRAPH
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

# Parts as rows of index workbooks: a workbook per brand, a sheet per type; SMALL is a sheet of no known kind.
KINDS = {"economy": ("tool_directory", "tools"), "standard": ("cross_audience_issue_router", "issues"), "medium": ("general_sop_index", "core"), "promo": ("product_update_index", "updates"), "large": ("vip_overlay_policy", "vip")}
ACTIONS = {"copy_template": ["gear"], "call": ["bolt", "ring"]}
PLAN = r"""WITH r AS (SELECT p_brand AS workbook, p_type AS sheet, p_partkey + 1 AS row, p_size::VARCHAR AS size, p_name AS name, CASE WHEN p_name LIKE '%rod' THEN '' ELSE 'Supplier#' || lpad(p_partkey::VARCHAR, 9, '0') END AS sop,
    CASE WHEN p_name LIKE '%gizmo' THEN 'https://example.org/' || p_size ELSE '' END AS link FROM part),
  t AS (SELECT *, CASE sheet WHEN 'ECONOMY' THEN 'tool_link' WHEN 'STANDARD' THEN 'issue_router_unit' WHEN 'PROMO' THEN 'product_update_note' WHEN 'LARGE' THEN 'vip_overlay_rule' ELSE 'sop_reference' END AS candidate_type FROM r),
  plan AS (SELECT workbook, sheet, row, CASE candidate_type WHEN 'tool_link' THEN 'tool_links' WHEN 'sop_reference' THEN 'sop_references' ELSE 'issue_router_units' END AS bucket,
    CASE sheet WHEN 'ECONOMY' THEN 'tools' WHEN 'STANDARD' THEN 'issues' WHEN 'PROMO' THEN 'updates' WHEN 'LARGE' THEN 'vip' ELSE 'core' END AS collection, candidate_type, name AS title,
    'No: ' || size || chr(10) || 'Issue: ' || name || CASE WHEN sop <> '' THEN chr(10) || 'SOP: ' || sop ELSE '' END || CASE WHEN link <> '' THEN chr(10) || 'Link: ' || link ELSE '' END AS content,
    CASE WHEN candidate_type = 'tool_link' THEN NULL WHEN sop <> '' THEN sop WHEN sheet = 'MEDIUM' THEN name END AS target_title,
    nullif(link, '') AS url, CASE WHEN sheet <> 'STANDARD' THEN NULL WHEN name LIKE '%gear' THEN 'copy_template' WHEN name LIKE '%bolt' OR name LIKE '%ring' THEN 'call' END AS action FROM t)"""


def _plan(spark, d):
    p = C.table(spark, d, "part")
    ends = lambda word: F.col("p_name").endswith(word)
    sop = F.when(ends("rod"), "").otherwise(F.concat(F.lit("Supplier#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")))
    link = F.when(ends("gizmo"), F.concat(F.lit("https://example.org/"), F.col("p_size").cast("string")))
    rows = p.select(
        F.col("p_brand").alias("workbook"), F.col("p_type").alias("sheet"), (F.col("p_partkey") + 1).alias("row"), F.array(*map(F.lit, ["No", "Issue", "SOP", "Link"])).alias("headers"),
        F.array(F.col("p_size").cast("string"), "p_name", sop, link).alias("values"),
    )
    return W.index_plan(rows, KINDS, actions=ACTIONS)


@query("k7_index_workbook_plan", PLAN + """, s AS (SELECT s_name, s_suppkey AS id FROM supplier), rel AS (SELECT p.*, s.id FROM plan p LEFT JOIN s ON lower(s_name) = lower(target_title) WHERE target_title IS NOT NULL)
  SELECT bucket, workbook, row, title, candidate_type AS detail, url, NULL::BIGINT AS target_id FROM plan
  UNION ALL SELECT 'collections', workbook, min(row), collection, 'imported', NULL, NULL FROM plan GROUP BY workbook, collection
  UNION ALL SELECT 'action_templates', workbook, row, title, action, NULL, NULL FROM plan WHERE action IS NOT NULL
  UNION ALL SELECT CASE WHEN id IS NULL THEN 'unresolved_targets' ELSE 'relations' END, workbook, row, target_title, CASE WHEN candidate_type IN ('issue_router_unit', 'vip_overlay_rule') THEN 'requires' ELSE 'references' END, url, id FROM rel""")
def k7(spark, d):
    """Candidates, collections, actions and relations of all workbooks; a relation without a target is listed as unresolved."""
    p = _plan(spark, d)
    titles = C.table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.col("s_suppkey").alias("target_id"))
    row = lambda bucket, title, detail, url=F.lit(None), target=F.lit(None): (bucket.alias("bucket"), "workbook", "row", title.alias("title"), detail.alias("detail"), url.cast("string").alias("url"), target.cast("long").alias("target_id"))
    candidates = p.select(*row(F.col("bucket"), F.col("title"), F.col("candidate_type"), F.col("url")))
    collections = p.groupBy("workbook", "collection").agg(F.min("row").alias("row")).select(*row(F.lit("collections"), F.col("collection"), F.lit("imported")))
    actions = p.where("action is not null").select(*row(F.lit("action_templates"), F.col("title"), F.col("action")))
    r = W.plan_relations(p, titles)
    relations = r.select(*row(F.when(F.col("status") == "unresolved", "unresolved_targets").otherwise("relations"), F.col("target_title"), F.col("relation_type"), F.col("url"), F.col("target_id")))
    return candidates.unionByName(collections).unionByName(actions).unionByName(relations)


@query("d27_index_plan_units", PLAN + """, u AS (SELECT workbook, 0 AS b, 0 AS o, 'full_sop' AS section, workbook AS heading, workbook || chr(10) || 'Collections: ' || count(DISTINCT collection) || chr(10) || 'Issue router units: ' || count(*) FILTER (bucket = 'issue_router_units') || chr(10) || 'SOP references: ' || count(*) FILTER (bucket = 'sop_references') || chr(10) || 'Tool links: ' || count(*) FILTER (bucket = 'tool_links') || chr(10) || 'Actions: ' || count(action) AS content FROM plan GROUP BY workbook
  UNION ALL SELECT workbook, 1, min(row) * 2, 'text_section', collection, collection FROM plan GROUP BY workbook, collection
  UNION ALL SELECT workbook, CASE bucket WHEN 'issue_router_units' THEN 2 WHEN 'sop_references' THEN 3 ELSE 4 END, row * 2, candidate_type, title, content FROM plan
  UNION ALL SELECT workbook, 2, row * 2 + 1, 'quick_action_rule', action, action || ': ' || title FROM plan WHERE action IS NOT NULL)
  SELECT workbook, row_number() OVER (PARTITION BY workbook ORDER BY b, o) - 1 AS chunk_index, section, heading, content FROM u""")
def d27(spark, d):
    return W.plan_units(_plan(spark, d))


@query("d56_layout_elements", using("kb_edges", """, l AS (SELECT l_orderkey AS graph_id, l_linenumber AS edge_id, l_linenumber::BIGINT AS from_node, l_partkey % 7 + 1 AS to_node, CASE l_returnflag WHEN 'R' THEN 'yes' WHEN 'A' THEN 'no' ELSE 'next' END AS condition, l_linestatus = 'F' AS has_source FROM lineitem),
  e AS (SELECT *, CASE WHEN has_source THEN 0.72 ELSE 0.45 END::DOUBLE AS confidence, NOT has_source AS missing_evidence FROM l)
  SELECT graph_id, 'graph_node' AS kind, 'graph_node_' || node_id AS element_id, CASE WHEN trim(title) = '' THEN node_id::VARCHAR ELSE trim(title) END AS text, NULL AS source_id, NULL AS target_id, NULL AS condition, support / 100 AS confidence, false AS missing_evidence FROM kb_nodes
  UNION ALL SELECT graph_id, 'graph_edge', 'graph_edge_' || edge_id, from_node || ' --' || condition || '--> ' || to_node, NULL, NULL, condition, confidence, missing_evidence FROM e
  UNION ALL SELECT e.graph_id, 'flows_to', 'flows_to_graph_edge_' || edge_id, NULL, 'graph_node_' || from_node, 'graph_node_' || to_node, condition, confidence, missing_evidence FROM e SEMI JOIN kb_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.to_node"""))
def d56(spark, d):
    """Orders as diagram pages: every line is a box and draws an edge; open lines have no source for theirs."""
    nodes = C.graph_nodes(spark, d).withColumn("confidence", F.col("support") / 100)
    condition = F.when(F.col("l_returnflag") == "R", " YES").when(F.col("l_returnflag") == "A", "No ").otherwise("")
    edges = C.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("edge_id"), F.col("l_linenumber").cast("long").alias("from_node"), (F.col("l_partkey") % 7 + 1).alias("to_node"),
        condition.alias("condition"), F.lit(None).cast("double").alias("confidence"), (F.col("l_linestatus") == "F").alias("has_source"),
    )
    return L.layout_elements(nodes, edges, "graph_id")


@query("d52_atomic_graph_units", using("kb_degrees", """SELECT graph_id, 'unit' AS retrieval_scope, node_id::VARCHAR AS source_key, CASE WHEN out_degree > 1 THEN 'decision_point' WHEN title LIKE '%gear' THEN 'sla_rule' WHEN title LIKE '%bolt' THEN 'routing_rule' WHEN title LIKE '%ring' OR title LIKE '%rod' THEN 'handoff_rule' ELSE 'workflow_step' END AS unit_type, title, title AS content, support / 100 AS confidence FROM kb_degrees WHERE trim(title) <> '' AND (out_degree > 0 OR in_degree = 0)
  UNION ALL SELECT l_orderkey, 'annotation', l_linenumber::VARCHAR, CASE WHEN l_returnflag = 'R' THEN 'warning' ELSE 'operational_note' END, 'Workflow note', l_returnflag || l_linestatus, least(l_quantity / 50, 0.78) FROM lineitem
  UNION ALL SELECT l_orderkey, 'relation', l_linenumber::VARCHAR, 'related_document', coalesce(s_name, 'Related document'), 'Related document: ' || coalesce(s_name, 'Related document'), least(l_quantity / 50, 0.9) FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey"""))
def d52(spark, d):
    """Orders as graphs: a node with several exits decides, one with entries and no exit ends; lines are annotations too and relate to their supplier."""
    g = GR.degrees(C.graph_nodes(spark, d), C.graph_edges(spark, d), GRAPH)
    kind = F.when(F.col("out_degree") > 1, "decision").when((F.col("out_degree") == 0) & (F.col("in_degree") > 0), "end").otherwise("process")
    nodes = g.select("graph_id", "node_id", kind.alias("node_type"), "title", F.lit(None).cast("string").alias("content"), (F.col("support") / 100).alias("confidence"))
    lines = C.table(spark, d, "lineitem").withColumn("confidence", F.col("l_quantity") / 50)
    warned = F.when(F.col("l_returnflag") == "R", "audit_rule").otherwise("note")
    notes = lines.select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("annotation_id"), warned.alias("kind"), F.lit("").alias("title"), F.concat("l_returnflag", "l_linestatus").alias("content"), "confidence")
    s = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("target_title"))
    links = lines.join(s, "l_suppkey", "left").select(F.col("l_orderkey").alias("graph_id"), F.col("l_linenumber").alias("relation_id"), "target_title", F.lit("").alias("evidence"), "confidence")
    return L.atomic_graph_units(nodes, notes, links, "graph_id", r"\bgear\b", {"routing_rule": ["bolt"], "handoff_rule": ["ring", "rod"]})


@query("d25_display_context_build", using("kb_status kb_units", r""", x AS (SELECT s.version_id, CASE WHEN risk_level = 'high' THEN c.current ELSE s.version_id END AS context_version_id FROM kb_status s JOIN (SELECT document_id, max(version_id) AS current FROM kb_status WHERE status = 'published' GROUP BY 1) c USING (document_id) WHERE status <> 'draft'),
  n AS (SELECT version_id, chunk_index // 5 AS section_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM kb_units GROUP BY 1, 2),
  h AS (SELECT version_id, chunk_index, version_id || ':' || chunk_index AS hit_id, CASE WHEN chunk_index % 7 = 6 THEN chunk_index // 5 + 1000000 ELSE chunk_index // 5 END AS section_id, CASE chunk_index % 3 WHEN 0 THEN content WHEN 1 THEN replace(content, ' ', ' - ') ELSE array_to_string(list_reverse(string_split(content, ' ')), ' ') END AS content FROM kb_units),
  j AS (SELECT h.*, context_version_id, body, CASE WHEN context_version_id IS NULL THEN 'display_context_not_loaded' WHEN context_version_id <> h.version_id THEN 'retrieval_version_does_not_match_display_context' WHEN body IS NULL THEN 'section_parent_not_found' ELSE '' END AS reason, lower(regexp_replace(strip_accents(body), '\p{M}+', '', 'g')) AS plain,
    list_filter(string_split(trim(regexp_replace(lower(regexp_replace(strip_accents(h.content), '\p{M}+', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS words, string_split(body, chr(10) || chr(10)) AS ps FROM h LEFT JOIN x USING (version_id) LEFT JOIN n ON n.version_id = h.version_id AND n.section_id = h.section_id),
  k AS (SELECT *, list_distinct(list_filter(words, lambda w: length(w) > 2)) AS wanted, ' ' || trim(regexp_replace(plain, '[^a-z0-9]+', ' ', 'g')) || ' ' AS flat, array_to_string(words, ' ') AS needle FROM j),
  b AS (SELECT *, list_transform(ps, lambda p: len(list_intersect(wanted, string_split(trim(regexp_replace(lower(regexp_replace(strip_accents(p), '\p{M}+', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' ')))) AS shared FROM k),
  m AS (SELECT *, list_max(shared) AS best, list_position(shared, list_max(shared)) AS p, CASE WHEN reason <> '' THEN NULL WHEN trim(content) <> '' AND contains(body, content) THEN 'exact' WHEN len(words) > 0 AND contains(flat, needle) THEN 'normalized' WHEN len(wanted) > 0 AND list_max(shared) >= least(5, greatest(2, (len(wanted) + 1) // 2)) THEN 'paragraph' ELSE 'unmatched' END AS strategy FROM b),
  f AS (SELECT *, CASE WHEN strategy = 'normalized' THEN regexp_extract(plain, array_to_string(words, '[^a-z0-9]+')) END AS met FROM m),
  o AS (SELECT *, CASE strategy WHEN 'exact' THEN strpos(body, content) - 1 WHEN 'normalized' THEN CASE WHEN length(plain) = length(body) THEN strpos(plain, met) - 1 END WHEN 'paragraph' THEN CASE WHEN p > 1 THEN length(array_to_string(ps[1:p - 1], chr(10) || chr(10))) + 2 ELSE 0 END END AS start_offset FROM f)
  SELECT hit_id, CASE WHEN reason = '' THEN 'resolved' WHEN reason LIKE 'retr%' THEN 'version_mismatch' ELSE 'parent_missing' END AS status, reason, strategy, start_offset, start_offset + CASE strategy WHEN 'exact' THEN length(content) WHEN 'normalized' THEN length(met) ELSE length(ps[p]) END AS end_offset, CASE WHEN reason <> '' OR strategy = 'unmatched' THEN content ELSE '' END AS fallback FROM o"""))
def d25(spark, d):
    """Every unit as a hit, as it is, with dashes between its words or in reversed order, shown in sections of five; drafts have no context, approved versions of high risk that of the published one."""
    v = C.with_status(C.versions(spark, d).drop("text")).where("status <> 'draft'")
    current = v.where("status = 'published'").groupBy("document_id").agg(F.max("version_id").alias("current"))
    contexts = v.join(current, "document_id").select("version_id", F.when(F.col("risk_level") == "high", F.col("current")).otherwise(F.col("version_id")).alias("context_version_id"))
    u = C.units(spark, d).withColumn("section_id", F.floor(F.col("chunk_index") / 5))
    parts = u.groupBy("version_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
    sections = parts.select("version_id", "section_id", F.array_join(F.col("parts.content"), "\n\n").alias("section_text"))
    turned = F.when(F.col("chunk_index") % 3 == 0, F.col("content")).when(F.col("chunk_index") % 3 == 1, F.regexp_replace("content", " ", " - ")).otherwise(F.array_join(F.reverse(F.split("content", " ")), " "))
    hits = u.select("version_id", F.concat_ws(":", "version_id", "chunk_index").alias("hit_id"), F.when(F.col("chunk_index") % 7 == 6, F.col("section_id") + 1000000).otherwise(F.col("section_id")).alias("section_id"), turned.alias("content"))
    return DC.display_context(hits, contexts, sections)


@query("d29_node_enrichment", using("kb_nodes", r""", n AS (SELECT graph_id, node_id::VARCHAR AS node_id, CASE WHEN title LIKE '%gear' THEN 'decision' ELSE 'action' END AS node_type, support::INT || '. ' || title AS content, support::INT AS code, title AS words FROM kb_nodes),
  l AS (SELECT l_orderkey AS graph_id, CASE WHEN l_linestatus = 'F' THEN l_linenumber::VARCHAR ELSE 'p' || l_partkey END AS semantic_id, CASE WHEN p_size < 10 THEN 'decision' WHEN p_size < 30 THEN 'sla_rule' ELSE 'warning' END AS semantic_type, l_quantity::INT || ') ' || p_name || ' ' || lower(p_type) AS semantic_content, l_quantity::INT AS code, p_name || ' ' || lower(p_type) AS words FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'),
  s AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY graph_id, semantic_id ORDER BY length(semantic_content) DESC, semantic_content DESC, semantic_type DESC) = 1),
  p AS (SELECT n.graph_id, n.node_id, n.node_type, semantic_id, semantic_type, semantic_content, n.node_id = semantic_id AS same, n.code = s.code AS coded, len(list_intersect(list_distinct(string_split(n.words, ' ')), list_distinct(string_split(s.words, ' ')))) / least(len(list_distinct(string_split(n.words, ' '))), len(list_distinct(string_split(s.words, ' ')))) AS score FROM n JOIN s USING (graph_id)),
  m AS (SELECT *, CASE WHEN same THEN 'id' WHEN coded THEN 'code' ELSE 'words' END AS matched_by FROM p WHERE same OR coded OR score >= 0.72
    QUALIFY row_number() OVER (PARTITION BY graph_id, node_id ORDER BY CASE WHEN same THEN 0 WHEN coded THEN 1 ELSE 2 END, CASE WHEN coded AND NOT same THEN (NOT (node_type = semantic_type OR (node_type = 'action' AND semantic_type = 'sla_rule')))::INT ELSE 0 END, CASE WHEN coded AND NOT same THEN -length(semantic_content) ELSE -score END, semantic_id) = 1)
  SELECT n.graph_id, n.node_id, coalesce(matched_by, '') AS matched_by, semantic_id, CASE semantic_type WHEN 'decision' THEN 'decision' WHEN 'sla_rule' THEN 'action' WHEN 'warning' THEN 'annotation' ELSE n.node_type END AS node_type, CASE WHEN length(semantic_content) > length(content) THEN semantic_content ELSE content END AS content FROM n LEFT JOIN m ON m.graph_id = n.graph_id AND m.node_id = n.node_id"""))
def d29(spark, d):
    """Orders as graphs, read a second time from the lines that weren't returned: the quantity is the step code."""
    kind = F.when(F.col("title").endswith("gear"), "decision").otherwise("action")
    nodes = C.graph_nodes(spark, d).select("graph_id", F.col("node_id").cast("string").alias("node_id"), kind.alias("node_type"), F.concat(F.col("support").cast("int").cast("string"), F.lit(". "), "title").alias("content"))
    parts = C.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size")
    lines = C.table(spark, d, "lineitem").where("l_returnflag <> 'R'").join(parts, "l_partkey")
    key = F.when(F.col("l_linestatus") == "F", F.col("l_linenumber").cast("string")).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    found = F.when(F.col("p_size") < 10, "decision").when(F.col("p_size") < 30, "sla_rule").otherwise("warning")
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(") "), "p_name", F.lit(" "), F.lower("p_type"))
    semantic = lines.select(F.col("l_orderkey").alias("graph_id"), key.alias("semantic_id"), found.alias("semantic_type"), text.alias("semantic_content"))
    return EN.enrich_nodes(nodes, semantic, "graph_id")


@query("d61_review_candidate_marks", using("kb_edges", """, c AS (SELECT graph_id, count(*) AS nodes FROM kb_nodes GROUP BY 1), e AS (SELECT graph_id, count(*) AS edges FROM kb_edges GROUP BY 1),
  x AS (SELECT o_custkey AS document_id, o_orderkey AS candidate_id, CASE o_orderstatus WHEN 'O' THEN 'workflow_v3_graph_primary' WHEN 'F' THEN 'workflow_v2_vision_primary' ELSE 'semantic_workflow_structuring' END AS flow, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges, o_totalprice AS score FROM orders LEFT JOIN c ON c.graph_id = o_orderkey LEFT JOIN e ON e.graph_id = o_orderkey),
  y AS (SELECT *, flow NOT LIKE 'sem%' AND nodes >= 2 AND edges >= 1 AS reviewable FROM x)
  SELECT *, count(*) OVER (PARTITION BY document_id) AS candidate_count, reviewable AND row_number() OVER (PARTITION BY document_id ORDER BY reviewable DESC, CASE flow WHEN 'workflow_v3_graph_primary' THEN 0 ELSE 1 END, edges DESC, nodes DESC, score DESC, candidate_id) = 1 AS selected FROM y"""))
def d61(spark, d):
    """A customer's orders as readings of one document: the graph of the best one is marked for review."""
    n = C.graph_nodes(spark, d).groupBy("graph_id").agg(F.count("*").alias("nodes"))
    e = C.graph_edges(spark, d).groupBy("graph_id").agg(F.count("*").alias("edges"))
    flow = F.when(F.col("o_orderstatus") == "O", "workflow_v3_graph_primary").when(F.col("o_orderstatus") == "F", "workflow_v2_vision_primary").otherwise("semantic_workflow_structuring")
    c = C.table(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("candidate_id"), flow.alias("flow"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("graph_id"))
    c = c.join(n, "graph_id", "left").join(e, "graph_id", "left").fillna(0, ["nodes", "edges"]).drop("graph_id")
    return EN.review_candidates(c, "document_id")


@query("d33_semantic_candidates", using("kb_edges", """, t AS (SELECT *, CASE WHEN title LIKE '%gear' THEN 'decision' WHEN title LIKE '%bolt' THEN 'sla_rule' WHEN title LIKE '%rod' THEN 'annotation' WHEN title LIKE '%ring' THEN 'end' END AS semantic_type, CASE WHEN title LIKE '%rod' AND support < 20 THEN '(' || node_id || ')' ELSE '' END AS note FROM kb_nodes),
  u AS (SELECT graph_id, from_node, to_node FROM kb_edges GROUP BY 1, 2, 3 HAVING count(*) > 1), e AS (SELECT graph_id, from_node AS node_id FROM u UNION ALL SELECT graph_id, to_node FROM u WHERE from_node <> to_node)
  SELECT t.graph_id, t.node_id AS semantic_id, CASE semantic_type WHEN 'decision' THEN 'candidate_decision' WHEN 'sla_rule' THEN 'candidate_sla' WHEN 'annotation' THEN 'candidate_annotation' ELSE 'candidate_action' END AS unit_type, trim(title) AS heading, CASE WHEN note = '' THEN trim(title) ELSE note END AS content, (SELECT count(*) FROM e WHERE e.graph_id = t.graph_id AND e.node_id = t.node_id) AS uncertain_edges
  FROM t WHERE semantic_type IS DISTINCT FROM 'end' AND note = '' AND trim(title) <> ''"""))
def d33(spark, d):
    """Nodes of all order graphs; an edge drawn under both conditions is uncertain."""
    ends = lambda word: F.col("title").endswith(word)
    kind = F.when(ends("gear"), "decision").when(ends("bolt"), "sla_rule").when(ends("rod"), "annotation").when(ends("ring"), "end")
    mark = F.when(ends("rod") & (F.col("support") < 20), F.concat(F.lit("("), F.col("node_id").cast("string"), F.lit(")")))
    nodes = C.graph_nodes(spark, d).select("graph_id", F.col("node_id").alias("semantic_id"), kind.alias("semantic_type"), "title", mark.alias("content"))
    uncertain = C.graph_edges(spark, d).groupBy("graph_id", "from_node", "to_node").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return EN.semantic_candidates(nodes, uncertain, "graph_id")

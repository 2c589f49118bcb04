"""Queries: further data operators over the corpus and graph views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graphs as GR
from corpusloom.operators import ordering
from corpusloom.operators import ranking as K
from corpusloom.plans.registry import query
from corpusloom.plans.relations import GRAPH
from corpusloom.plans.retrieval import KNN_SQL, j4
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C


@query("d55_layout_graph", "WITH c AS (SELECT c_custkey AS connector, c_custkey // 10 AS page, c_acctbal::DOUBLE AS x1, (c_custkey % 97)::DOUBLE AS y1, c_acctbal::DOUBLE / 2 AS x2, (c_custkey % 89)::DOUBLE AS y2 FROM customer), s AS (SELECT o_orderkey AS shape, o_custkey // 10 AS page, o_totalprice::DOUBLE / 30 AS x, (o_orderkey % 101)::DOUBLE AS y FROM orders), m AS (SELECT connector, shape, round((x1 - x) ** 2 + (y1 - y) ** 2, 9) AS da, round((x2 - x) ** 2 + (y2 - y) ** 2, 9) AS db FROM c JOIN s USING (page)), n AS (SELECT connector, arg_min(shape, (da, shape)) AS from_shape, arg_min(shape, (db, shape)) AS to_shape FROM m GROUP BY 1) SELECT * FROM n WHERE from_shape <> to_shape")
def d55(spark, d):
    page = lambda c: F.floor(F.col(c) / 10).alias("page")
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("connector"), page("c_custkey"), F.col("c_acctbal").cast("double").alias("x1"), (F.col("c_custkey") % 97).cast("double").alias("y1"), (F.col("c_acctbal").cast("double") / 2).alias("x2"), (F.col("c_custkey") % 89).cast("double").alias("y2"))
    s = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("shape"), page("o_custkey"), (F.col("o_totalprice").cast("double") / 30).alias("x"), (F.col("o_orderkey") % 101).cast("double").alias("y"))
    return GR.layout_edges(c, s, "page")


@query("k31_node_merge", "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_size, lower(p_brand)) AS merged_into, p_name FROM part")
def k31(spark, d):
    n = C.table(spark, d, "part").select("p_partkey", "p_size", F.lower("p_brand").alias("k"), "p_name")
    return GR.merge_nodes(n, "p_size", "k", "p_partkey", "p_name")


@query("d62_graph_payload_rows", using("kb_edges", "SELECT graph_id, from_node, to_node, CASE WHEN condition = 'yes' THEN 'yes' ELSE '' END AS condition FROM kb_edges"))
def d62(spark, d):
    e = C.graph_edges(spark, d).withColumn("condition", F.when(F.col("condition") == "yes", "yes"))
    p = e.groupBy("graph_id").agg(F.to_json(F.struct(F.collect_list(F.struct("from_node", "to_node", "condition")).alias("edges"))).alias("j"))
    return GR.payload_rows(p, "graph_id", "j")


@query("d31_semantic_edges", using("kb_edges", "SELECT graph_id * 10 + from_node AS from_node, graph_id * 10 + to_node AS to_node, condition, count(*) OVER (PARTITION BY graph_id, from_node, to_node) = 1 AS confirmed FROM kb_edges"))
def d31(spark, d):
    e = C.graph_edges(spark, d).withColumn("condition", F.when(F.col("condition") == "yes", " Y ").otherwise("False"))
    # Both conditions on the way between two nodes contradict each other: at most two rows a window.
    e = e.withColumn("confirmed", F.count("*").over(Window.partitionBy("graph_id", "from_node", "to_node")) == 1)
    ids = C.graph_nodes(spark, d).select("graph_id", "node_id", (F.col("graph_id") * 10 + F.col("node_id")).alias("new_id"))
    a, b = (ids.select("graph_id", F.col("node_id").alias(f"{c}_node"), F.col("new_id").alias(f"{c}_new")) for c in ("from", "to"))
    return e.join(a, ["graph_id", "from_node"]).join(b, ["graph_id", "to_node"]).select(F.col("from_new").alias("from_node"), F.col("to_new").alias("to_node"), GR.condition_name(F.col("condition")).alias("condition"), "confirmed")


@query("d32_semantic_graph_checks", using("kb_degrees", "SELECT graph_id, node_id, CASE WHEN in_degree = 0 AND out_degree = 0 THEN 'orphan' WHEN out_degree = 1 THEN 'missing_branch' ELSE 'ok' END AS state FROM kb_degrees"))
def d32(spark, d):
    g = GR.degrees(C.graph_nodes(spark, d), C.graph_edges(spark, d), GRAPH)
    return g.select("graph_id", "node_id", F.when((F.col("in_degree") == 0) & (F.col("out_degree") == 0), "orphan").when(F.col("out_degree") == 1, "missing_branch").otherwise("ok").alias("state"))


@query("d30_semantic_typing", using("kb_nodes", "SELECT graph_id, node_id, CASE WHEN title LIKE '%gear%' THEN 'decision' WHEN length(title) > 8 THEN 'process' ELSE 'note' END AS node_type FROM kb_nodes"))
def d30(spark, d):
    return C.graph_nodes(spark, d).select("graph_id", "node_id", F.when(F.contains("title", F.lit("gear")), "decision").when(F.length("title") > 8, "process").otherwise("note").alias("node_type"))


@query("d53_node_typing", using("kb_degrees", "SELECT graph_id, node_id, CASE WHEN in_degree = 0 THEN 'start' WHEN out_degree = 0 THEN 'end' ELSE 'decision' END AS node_type FROM kb_degrees"))
def d53(spark, d):
    g = GR.degrees(C.graph_nodes(spark, d), C.graph_edges(spark, d), GRAPH)
    return g.select("graph_id", "node_id", F.when(F.col("in_degree") == 0, "start").when(F.col("out_degree") == 0, "end").otherwise("decision").alias("node_type"))


@query("d5_graph_review_failures", using("kb_degrees", ", u AS (SELECT DISTINCT graph_id, from_node AS node_id FROM kb_edges GROUP BY graph_id, from_node, to_node HAVING count(*) > 1) SELECT g.graph_id, g.node_id, array_to_string(list_filter([CASE WHEN out_degree = 1 THEN 'validation_error' END, CASE WHEN u.node_id IS NOT NULL THEN 'uncertain_edge' END, CASE WHEN support < 5 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS failures FROM kb_degrees g LEFT JOIN u ON u.graph_id = g.graph_id AND u.node_id = g.node_id"))
def d5(spark, d):
    e = C.graph_edges(spark, d)
    key = ["graph_id", "node_id"]
    unsure = e.groupBy("graph_id", F.col("from_node").alias("node_id"), "to_node").count().where("count > 1").select(*key, F.lit(True).alias("unsure")).distinct()
    g = GR.degrees(C.graph_nodes(spark, d), e, GRAPH).join(unsure, key, "left")
    codes = F.array_compact(F.array(F.when(F.col("out_degree") == 1, F.lit("validation_error")), F.when(F.col("unsure"), F.lit("uncertain_edge")), F.when(F.col("support") < 5, F.lit("low_confidence"))))
    return g.select(*key, F.array_join(codes, ",").alias("failures"))


@query("d6_summary_only_source_text", using("kb_units", "SELECT version_id, chunk_index FROM kb_units WHERE length(content) < 40 AND NOT regexp_matches(content, '(^|[^0-9])[0-9]{1,3}(\\.[0-9]{1,3})?[.)]?\\s')"))
def d6(spark, d):
    return C.units(spark, d).where((F.length("content") < 40) & ~F.col("content").rlike(r"(^|[^0-9])[0-9]{1,3}(\.[0-9]{1,3})?[.)]?\s")).select("version_id", "chunk_index")


@query("d8_degraded_unconverted", using("kb_versions", "SELECT version_id FROM kb_versions WHERE review_status = 'rejected' AND version_id % 3 <> 0"))
def d8(spark, d):
    return C.versions(spark, d).where("review_status = 'rejected' and version_id % 3 <> 0").select("version_id")


@query("d10_version_listing", using("kb_status", "SELECT version_id, document_id || ' v' || version_number AS display, CASE status WHEN 'published' THEN 0 WHEN 'draft' THEN 1 ELSE 2 END AS sort_key FROM kb_status"))
def d10(spark, d):
    v = C.with_status(C.versions(spark, d))
    return v.select("version_id", F.concat("document_id", F.lit(" v"), F.col("version_number").cast("string")).alias("display"), F.when(F.col("status") == "published", 0).when(F.col("status") == "draft", 1).otherwise(2).alias("sort_key"))


@query("d11_relations_of_collection", "SELECT r_name AS collection, count(*) AS relations FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def d11(spark, d):
    t = lambda n: C.table(spark, d, n)
    n = t("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(t("nation"), "n_nationkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum("n").alias("relations"))
    return n.join(t("region"), "r_regionkey").select(F.col("r_name").alias("collection"), "relations")


@query("d13_synonym_governance", using("kb_nodes", "SELECT graph_id AS group_id, string_agg(DISTINCT lower(title), ',' ORDER BY lower(title)) AS terms, CASE WHEN count(DISTINCT lower(title)) > 1 THEN 'active' ELSE 'archived' END AS status FROM kb_nodes GROUP BY 1"))
def d13(spark, d):
    g = C.graph_nodes(spark, d).groupBy(F.col("graph_id").alias("group_id")).agg(F.array_sort(F.collect_set(T.normalize_phrase(F.col("title")))).alias("terms"))
    return g.select("group_id", F.array_join("terms", ",").alias("terms"), F.when(F.size("terms") > 1, "active").otherwise("archived").alias("status"))


@query("d17_units_to_chunks", using("kb_units", "SELECT version_id || ':' || chunk_index AS chunk_id, content, CASE WHEN version_id % 2 = 0 THEN 'line ' || (chunk_index + 1) ELSE 'paragraph ' || chunk_index END AS locator FROM kb_units"))
def d17(spark, d):
    k = F.col("chunk_index")
    return C.units(spark, d).select(F.concat_ws(":", "version_id", "chunk_index").alias("chunk_id"), "content", F.when(F.col("version_id") % 2 == 0, F.concat(F.lit("line "), (k + 1).cast("string"))).otherwise(F.concat(F.lit("paragraph "), k.cast("string"))).alias("locator"))


@query("d1_unit_rows", using("kb_units", "SELECT version_id, chunk_index, left(content, 200) AS preview, length(content) AS n_chars FROM kb_units"))
def d1(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", F.substring("content", 1, 200).alias("preview"), F.length("content").alias("n_chars"))


@query("d46_unit_normalise", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'rule' WHEN p_type LIKE '%BRASS%' THEN 'note' ELSE 'section' END AS unit_type, trim(left(p_name, 12)) AS title FROM part")
def d46(spark, d):
    kind = F.when(F.contains("p_type", F.lit("STEEL")), "rule").when(F.contains("p_type", F.lit("BRASS")), "note").otherwise("section")
    return C.table(spark, d, "part").select("p_partkey", kind.alias("unit_type"), F.trim(F.substring("p_name", 1, 12)).alias("title"))


@query("d43_metadata_from_corpus", using("kb_units", ", w AS (SELECT version_id, sum(contains(lower(content), 'the')::INT) AS en, sum(contains(lower(content), 'der')::INT) AS de, sum(contains(lower(content), 'que')::INT) AS es FROM kb_units GROUP BY 1) SELECT version_id, CASE WHEN en >= de AND en >= es AND en > 0 THEN 'en' WHEN de >= es AND de > 0 THEN 'de' WHEN es > 0 THEN 'es' ELSE 'none' END AS suggestion FROM w"))
def d43(spark, d):
    has = lambda w: F.count_if(F.contains(F.lower("content"), F.lit(w)))
    w = C.units(spark, d).groupBy("version_id").agg(has("the").alias("en"), has("der").alias("de"), has("que").alias("es"))
    return w.select("version_id", F.when((F.col("en") >= F.col("de")) & (F.col("en") >= F.col("es")) & (F.col("en") > 0), "en").when((F.col("de") >= F.col("es")) & (F.col("de") > 0), "de").when(F.col("es") > 0, "es").otherwise("none").alias("suggestion"))


@query("d45_layout_sections", "SELECT page_id, len(regexp_extract_all(html, '<div class=\"([^\"]*)\"', 1)) AS boxes, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<div class=\"([^\"]*)\"', 1))), ',') AS labels FROM pages")
def d45(spark, d):
    found = F.regexp_extract_all("html", F.lit('<div class="([^"]*)"'), 1)
    return C.table(spark, d, "pages").select("page_id", F.size(found).alias("boxes"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("labels"))


@query("d50_expansion_seeds", "WITH " + KNN_SQL[1:] + " SELECT query_id, chunk_id FROM r WHERE rank <= 3 AND vector_score >= 0.3")
def d50(spark, d):
    return j4(spark, d).where("rank <= 3 and vector_score >= 0.3").select("query_id", "chunk_id")


@query("d22_result_contract", "WITH " + KNN_SQL[1:] + " SELECT query_id, rank, 'doc ' || chunk_id || ' #' || rank AS citation FROM r WHERE rank <= 5")
def d22(spark, d):
    return j4(spark, d).where("rank <= 5").select("query_id", "rank", F.concat(F.lit("doc "), F.col("chunk_id").cast("string"), F.lit(" #"), F.col("rank").cast("string")).alias("citation"))


@query("d23_source_anchor", using("kb_units", "SELECT version_id, chunk_index, coalesce(CASE WHEN chunk_index % 3 = 0 THEN 'row:' || chunk_index END, CASE WHEN version_id % 2 = 0 THEN 'page:' || version_id END, 'line:' || chunk_index) AS anchor FROM kb_units"))
def d23(spark, d):
    k, v = F.col("chunk_index"), F.col("version_id")
    return C.units(spark, d).select("version_id", "chunk_index", F.coalesce(F.when(k % 3 == 0, F.concat(F.lit("row:"), k.cast("string"))), F.when(v % 2 == 0, F.concat(F.lit("page:"), v.cast("string"))), F.concat(F.lit("line:"), k.cast("string"))).alias("anchor"))


@query("d41_attempt_summary", "SELECT l_returnflag AS attempt_status, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS open FROM lineitem GROUP BY 1")
def d41(spark, d):
    return C.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("attempt_status")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("open"))


@query("d34_lifecycle_marks", using("kb_versions", "SELECT version_id, risk_level = 'high' AS blocked, CASE WHEN review_status = 'approved' THEN 'structured' ELSE 'degraded' END AS extraction, CASE WHEN risk_level = 'high' THEN 'high_risk' WHEN review_status = 'rejected' THEN 'rejected' ELSE '' END AS reason FROM kb_versions"))
def d34(spark, d):
    return C.versions(spark, d).select("version_id", (F.col("risk_level") == "high").alias("blocked"), F.when(F.col("review_status") == "approved", "structured").otherwise("degraded").alias("extraction"), F.when(F.col("risk_level") == "high", "high_risk").when(F.col("review_status") == "rejected", "rejected").otherwise("").alias("reason"))


@query("d35_display_defaults", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE '' END, ''), p_type, 'section') AS section FROM part")
def d35(spark, d):
    return C.table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(""), F.lit("")), F.col("p_type"), F.lit("section")).alias("section"))


@query("a26_reconcile_report", using("kb_units", ", g AS (SELECT md5(content) AS f, count(*) AS n, count(DISTINCT version_id) AS v FROM kb_units GROUP BY 1) SELECT count(*) FILTER (n > 1) AS duplicate_claims, count(*) FILTER (v > 1) AS across_versions, CAST(sum(n) AS BIGINT) AS units FROM g"))
def a26(spark, d):
    g = C.units(spark, d).groupBy(F.md5("content").alias("f")).agg(F.count("*").alias("n"), F.countDistinct("version_id").alias("v"))
    return g.agg(F.count_if(F.col("n") > 1).alias("duplicate_claims"), F.count_if(F.col("v") > 1).alias("across_versions"), F.sum("n").alias("units"))


@query("a40_migration_run_summary", "SELECT label AS job, count(*) AS processed, (count(*) + 24) // 25 AS batches, CASE WHEN count(*) > 50 THEN 'limit' ELSE 'done' END AS stop_reason FROM embeddings GROUP BY 1")
def a40(spark, d):
    g = C.vectors(spark, d).groupBy(F.col("label").alias("job")).agg(F.count("*").alias("processed"))
    return g.select("job", "processed", F.ceil(F.col("processed") / 25).alias("batches"), F.when(F.col("processed") > 50, "limit").otherwise("done").alias("stop_reason"))


@query("j9_chunk_relation_expansion", "WITH " + KNN_SQL[1:] + ", h AS (SELECT query_id, chunk_id FROM r WHERE rank <= 4), x AS (SELECT DISTINCT query_id, (chunk_id * 11 + 1) // 20 AS chunk_id FROM h WHERE chunk_id % 2 = 0) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = x.query_id AND h.chunk_id = x.chunk_id)")
def j9(spark, d):
    from corpusloom.operators import relations as R

    v = C.vectors(spark, d)
    edges = v.select(F.col("vec_id").alias("source_id"), F.floor((F.col("vec_id") * 11 + 1) / 20).alias("target_id"), F.when(F.col("vec_id") % 2 == 0, "approved").otherwise("suggested").alias("status"))
    return R.expand(j4(spark, d).where("rank <= 4").select("query_id", "chunk_id"), edges, "query_id", "chunk_id", 1 << 30).select("query_id", "chunk_id")


@query("k14_materialize_collections", using("kb_status", "SELECT vertical AS slug, count(DISTINCT document_id) AS items, min(version_id) AS first_version FROM kb_status WHERE review_status = 'approved' GROUP BY 1"))
def k14(spark, d):
    return C.with_status(C.versions(spark, d)).where("review_status = 'approved'").groupBy(F.col("vertical").alias("slug")).agg(F.countDistinct("document_id").alias("items"), F.min("version_id").alias("first_version"))


@query("k23_unsupported_scenario", "WITH " + KNN_SQL[1:] + " SELECT query_id, CASE WHEN max(vector_score) FILTER (chunk_id <> query_id) >= 0.45 THEN 'supported' ELSE 'unsupported_or_ambiguous' END AS status, coalesce(max(vector_score) FILTER (chunk_id <> query_id) < 0.4, TRUE) AS low FROM r WHERE rank <= 30 GROUP BY 1")
def k23(spark, d):
    g = j4(spark, d).groupBy("query_id").agg(F.max(F.when(F.col("chunk_id") != F.col("query_id"), F.col("vector_score"))).alias("top"))
    return g.select("query_id", F.when(F.col("top") >= 0.45, "supported").otherwise("unsupported_or_ambiguous").alias("status"), F.coalesce(F.col("top") < 0.4, F.lit(True)).alias("low"))


@query("k25_multi_stage_retrieve", "WITH " + KNN_SQL[1:] + ", a AS (SELECT query_id, chunk_id, 0 AS stage, 'direct' AS role, rank FROM r WHERE rank <= 5 UNION ALL SELECT query_id, chunk_id, 1, 'index', rank FROM r WHERE rank <= 12 AND chunk_id % 2 = 0 UNION ALL SELECT query_id, (chunk_id * 11 + 1) // 20, 2, 'relation', rank FROM r WHERE rank <= 3), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY stage, rank) AS k FROM a) SELECT query_id, chunk_id, role, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank, chunk_id) AS place FROM f WHERE k = 1")
def k25(spark, d):
    r = j4(spark, d).select("query_id", "chunk_id", F.col("rank").alias("r"))
    stage = lambda df, n, role: df.withColumns({"stage": F.lit(n), "role": F.lit(role)})
    related = r.where("r <= 3").withColumn("chunk_id", F.floor((F.col("chunk_id") * 11 + 1) / 20))
    every = stage(r.where("r <= 5"), 0, "direct").unionByName(stage(r.where("r <= 12 and chunk_id % 2 = 0"), 1, "index")).unionByName(stage(related, 2, "relation"))
    first = ordering.keep_first(every, ["query_id", "chunk_id"], F.col("stage"), F.col("r"))
    return first.select("query_id", "chunk_id", "role", F.row_number().over(Window.partitionBy("query_id").orderBy("stage", "r", "chunk_id")).alias("place"))


@query("k32_text_block_grouping", "WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS y, CASE WHEN l_quantity::DOUBLE - lag(l_quantity::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) <= 6 THEN 0 ELSE 1 END AS brk FROM lineitem), s AS (SELECT *, sum(brk) OVER (PARTITION BY l_orderkey ORDER BY y, l_linenumber ROWS UNBOUNDED PRECEDING) AS grp FROM g) SELECT l_orderkey, CAST(grp AS BIGINT) AS grp, count(*) AS boxes, max(y) - min(y) AS height FROM s GROUP BY ALL")
def k32(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("y", "l_linenumber")
    b = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("y"))
    brk = F.when(F.col("y") - F.lag("y").over(w) <= 6, 0).otherwise(1)
    s = b.withColumn("brk", brk).withColumn("grp", F.sum("brk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("l_orderkey", "grp").agg(F.count("*").alias("boxes"), (F.max("y") - F.min("y")).alias("height"))


@query("x3_relevance_plugin", "SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN 10 * 0.45 + (label / 10.0) * 100 * 0.55 ELSE 10 END, 6)::DOUBLE AS final_score FROM embeddings")
def x3(spark, d):
    v = C.vectors(spark, d).select("vec_id", "label")
    relevance = v.where("vec_id % 2 = 0").select("vec_id", (F.col("label") / 10).alias("relevance"))
    return v.join(relevance, "vec_id", "left").select("vec_id", F.round(K.blend(F.lit(10.0), F.col("relevance"), F.lit("other")), 6).alias("final_score"))


@query("c7_answer_scope", using("kb_units", ", s AS (SELECT version_id, chunk_index, regexp_extract_all(lower(content), '[\\p{L}]+') AS t FROM kb_units) SELECT version_id, chunk_index, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: x IN ('of', 'and', 'le', 'la') AND NOT list_contains(t, 'the')))), ',') AS asked FROM s"))
def c7(spark, d):
    t = F.regexp_extract_all(F.lower("content"), F.lit(r"[\p{L}]+"), 0)
    asked = F.array_intersect(t, F.array(*map(F.lit, ("of", "and", "le", "la"))))
    return C.units(spark, d).select("version_id", "chunk_index", F.array_join(F.array_sort(F.when(F.array_contains(t, "the"), F.array().cast("array<string>")).otherwise(asked)), ",").alias("asked"))


@query("c8_declared_semantics", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(p_type), ' '), lambda x: x IN ('steel', 'brass', 'small', 'large', 'promo')))), ',') AS declared FROM part")
def c8(spark, d):
    vocabulary = F.array(*map(F.lit, ("steel", "brass", "small", "large", "promo")))
    return C.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(F.split(F.lower("p_type"), " "), vocabulary)), ",").alias("declared"))

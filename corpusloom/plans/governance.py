"""Queries: sources, gates, versions, publication, governance reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import governance as G
from corpusloom.operators import ordering
from corpusloom.plans.registry import query
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C


def _status(spark, d):
    return C.with_status(C.versions(spark, d))


@query("s1_load_corpus", using("kb_status", "SELECT version_id, document_id, version_number, review_status, risk_level, vertical, status FROM kb_status"))
def s1(spark, d):
    return _status(spark, d).select("version_id", "document_id", "version_number", "review_status", "risk_level", "vertical", "status")


@query("s2_text_lines", using("kb_lines", "SELECT version_id AS doc_id, chunk_index + 1 AS line_start, trim(raw) AS text FROM kb_lines WHERE trim(raw) <> ''"))
def s2(spark, d):
    return C.units(spark, d).select(F.col("version_id").alias("doc_id"), (F.col("chunk_index") + 1).cast("long").alias("line_start"), F.col("content").alias("text"))


@query("s3_page_lines", "WITH p AS (SELECT doc_id, unnest(range(1, len(string_split(text, '. ')) + 1)) AS page, unnest(string_split(text, '. ')) AS body FROM documents), l AS (SELECT doc_id, page, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line, unnest(string_split(body, chr(10))) AS text FROM p) SELECT doc_id, page, line, trim(text) AS text FROM l WHERE trim(text) <> ''")
def s3(spark, d):
    pages = C.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("page", "body"))
    lines = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.posexplode(F.split("body", "\n")).alias("line", "text"))
    return lines.select("doc_id", "page", (F.col("line") + 1).alias("line"), F.trim("text").alias("text")).where("text <> ''")


@query("s4_sheet_rows", "SELECT p_partkey AS row_number, array_to_string(list_filter([p_name::VARCHAR, p_brand::VARCHAR, p_size::VARCHAR], lambda x: trim(x) <> ''), '|') AS cells FROM part")
def s4(spark, d):
    values = F.array(*(F.col(c).cast("string") for c in ("p_name", "p_brand", "p_size")))
    return C.table(spark, d, "part").select(F.col("p_partkey").alias("row_number"), F.array_join(F.filter(values, lambda x: F.trim(x) != ""), "|").alias("cells"))


@query("s5_content_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def s5(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("s6_append_versions", "WITH e AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_number FROM documents WHERE doc_id % 2 = 0), m AS (SELECT source, max(version_number) AS m FROM e GROUP BY 1), n AS (SELECT doc_id, d.source, coalesce(m, 0) + row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS version_number FROM documents d LEFT JOIN m ON m.source = d.source WHERE doc_id % 2 = 1) SELECT * FROM e UNION ALL SELECT * FROM n")
def s6(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", "source")
    return G.append_versions(ordering.position(docs.where("doc_id % 2 = 0"), ["source"], "doc_id", "version_number"), docs.where("doc_id % 2 = 1"), "source", "doc_id", "version_number")


@query("s7_replace_version_units", using("kb_units", "SELECT version_id, chunk_index, CASE WHEN version_id % 5 = 0 THEN 'v2 ' || content ELSE content END AS content FROM kb_units"))
def s7(spark, d):
    u = C.units(spark, d)
    return G.replace_units(u, u.where("version_id % 5 = 0").withColumn("content", F.concat(F.lit("v2 "), "content")), "version_id")


@query("s8_upsert", "WITH t AS (SELECT c_custkey AS k, c_name AS name, c_acctbal::DOUBLE AS balance FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE lower(c_name) END AS name, 100.0::DOUBLE AS balance FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(t.k, s.k) AS k, CASE WHEN trim(s.name) <> '' THEN s.name ELSE t.name END AS name, round(greatest(t.balance, s.balance), 4) AS balance FROM t FULL OUTER JOIN s ON t.k = s.k")
def s8(spark, d):
    c = C.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("balance"))
    s = c.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, " ").otherwise(F.lower("name")).alias("name"), F.lit(100.0).alias("balance"))
    return G.upsert(c.where("k % 3 <> 0"), s, ["k"], {"name": "keep_if_blank", "balance": "greatest"}).withColumn("balance", F.round("balance", 4))


@query("s9_search_documents", using("kb_status kb_units", "SELECT u.version_id || ':' || chunk_index AS chunk_id, document_id, content, vertical, coalesce(nullif(risk_level, ''), 'unknown') AS risk_level, CASE risk_level WHEN 'high' THEN 3 WHEN 'low' THEN 1 ELSE 0 END AS risk_priority FROM kb_units u JOIN kb_status v USING (version_id) WHERE review_status = 'approved'"))
def s9(spark, d):
    v = _status(spark, d).where("review_status = 'approved'").select("version_id", "document_id", "vertical", "risk_level")
    return C.units(spark, d).join(v, "version_id").select(F.concat_ws(":", "version_id", "chunk_index").alias("chunk_id"), "document_id", "content", "vertical", F.when(F.col("risk_level") == "", "unknown").otherwise(F.col("risk_level")).alias("risk_level"), F.when(F.col("risk_level") == "high", 3).when(F.col("risk_level") == "low", 1).otherwise(0).alias("risk_priority"))


@query("s10_vector_payload", "SELECT vec_id, label, array_to_string(list_distinct(['l' || label::VARCHAR, 'm' || (vec_id % 3)::VARCHAR, 'l' || (vec_id % 10)::VARCHAR]).list_sort(), ',') AS tags FROM embeddings")
def s10(spark, d):
    tags = F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")), F.concat(F.lit("l"), (F.col("vec_id") % 10).cast("string")))
    return C.vectors(spark, d).select("vec_id", "label", F.array_join(F.array_sort(F.array_distinct(tags)), ",").alias("tags"))


@query("s13_synonym_map", using("kb_nodes", ", t AS (SELECT DISTINCT graph_id AS group_id, lower(title) AS term FROM kb_nodes) SELECT a.group_id, a.term, string_agg(b.term, ',' ORDER BY b.term) AS synonyms FROM t a JOIN t b ON a.group_id = b.group_id AND a.term <> b.term GROUP BY 1, 2"))
def s13(spark, d):
    t = C.graph_nodes(spark, d).select(F.col("graph_id").alias("group_id"), F.lower("title").alias("term")).distinct()
    return t.join(t.select("group_id", F.col("term").alias("other")), "group_id").where("term <> other").groupBy("group_id", "term").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("synonyms"))


@query("s14_heading_fill", using("kb_units", "SELECT version_id, chunk_index, last_value(CASE WHEN length(content) < 40 THEN content END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM kb_units"))
def s14(spark, d):
    return ordering.fill_forward(C.units(spark, d), ["version_id"], ["chunk_index"], F.when(F.length("content") < 40, F.col("content")), "heading").select("version_id", "chunk_index", "heading")


@query("f1_production_gate", using("kb_status", "SELECT version_id, document_id FROM kb_status WHERE status = 'published' AND review_status = 'approved' AND risk_level <> 'high'"))
def f1(spark, d):
    return G.production_gate(_status(spark, d)).select("version_id", "document_id")


@query("f2_facet_filter", using("kb_status", "SELECT version_id FROM kb_status WHERE vertical IN ('de', 'fr') AND risk_level IN ('high', 'low')"))
def f2(spark, d):
    return G.facet_filter(_status(spark, d), {"vertical": ["de", "fr"], "status": [], "risk_level": ["high", "low"]}).select("version_id")


@query("f3_compiled_page_filter", using("kb_status", "SELECT version_id, 'overview' AS page_type FROM kb_status WHERE vertical IN ('en') AND n_chars > 500"))
def f3(spark, d):
    pages = _status(spark, d).withColumn("page_type", F.when(F.col("n_chars") > 500, "overview").otherwise("stub"))
    return G.facet_filter(pages, {"vertical": ["en"], "page_type": ["overview"]}).select("version_id", "page_type")


@query("f4_payload_filter", using("kb_status", "SELECT version_id FROM kb_status WHERE review_status = 'approved' AND NOT (risk_level = 'high') AND NOT (vertical = 'es')"))
def f4(spark, d):
    return G.payload_filter(_status(spark, d), [F.col("review_status") == "approved"], [F.col("risk_level") == "high", F.col("vertical") == "es"]).select("version_id")


@query("f5_keyword_index_filter", using("kb_status", "SELECT version_id FROM kb_status WHERE (status = 'published' OR status = 'archived') AND (vertical = 'en' OR vertical = 'de')"))
def f5(spark, d):
    return G.facet_filter(_status(spark, d), {"status": ["published", "archived"], "vertical": ["en", "de"]}).select("version_id")


@query("f6_contains_any_or_empty", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_name, ' '), ['green', 'blue', 'red']) OR p_partkey % 10 = 0")
def f6(spark, d):
    wanted = F.when(F.col("p_partkey") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("green"), F.lit("blue"), F.lit("red")))
    return C.table(spark, d, "part").where(G.contains_any_or_empty(F.split("p_name", " "), wanted)).select("p_partkey")


@query("f10_mode_visibility", using("kb_status", "SELECT version_id, status FROM kb_status WHERE status = 'published' AND review_status NOT IN ('needs_review', 'rejected')"))
def f10(spark, d):
    return _status(spark, d).where((F.col("status") == "published") & ~F.col("review_status").isin("needs_review", "rejected")).select("version_id", "status")


@query("f11_query_guard", "SELECT conv_id, turn, CASE length(trim(text)) WHEN 0 THEN 'empty' WHEN 1 THEN 'reject' WHEN 2 THEN 'no_semantic' ELSE 'ok' END AS guard FROM conversations WHERE role = 'user'")
def f11(spark, d):
    n = F.length(F.trim("content"))
    return C.messages(spark, d).where("role = 'user'").select(F.col("session_id").alias("conv_id"), F.col("seq").alias("turn"), F.when(n == 0, "empty").when(n == 1, "reject").when(n == 2, "no_semantic").otherwise("ok").alias("guard"))


@query("f15_bulk_review_blocked", using("kb_versions", "SELECT document_id, bool_or(risk_level = 'high') AS blocked FROM kb_versions GROUP BY 1"))
def f15(spark, d):
    return C.versions(spark, d).groupBy("document_id").agg(F.bool_or(F.col("risk_level") == "high").alias("blocked"))


@query("f17_high_risk", using("kb_versions kb_units", "SELECT u.version_id, chunk_index FROM kb_units u JOIN kb_versions v USING (version_id) WHERE risk_level = 'high' OR regexp_matches(lower(content), '(^|[^\\p{L}])(idiot|scum|trash)($|[^\\p{L}])')"))
def f17(spark, d):
    v = C.versions(spark, d).select("version_id", "risk_level")
    return C.units(spark, d).join(v, "version_id").where((F.col("risk_level") == "high") | F.lower("content").rlike(r"(^|[^\p{L}])(idiot|scum|trash)($|[^\p{L}])")).select("version_id", "chunk_index")


@query("j1_chunk_document_version", using("kb_status kb_units", "SELECT document_id, status, count(*) AS units, sum(length(content))::BIGINT AS chars FROM kb_units JOIN kb_status USING (version_id) GROUP BY ALL"))
def j1(spark, d):
    return C.units(spark, d).join(_status(spark, d).select("version_id", "document_id", "status"), "version_id").groupBy("document_id", "status").agg(F.count("*").alias("units"), F.sum(F.length("content")).alias("chars"))


@query("j2_latest_version", using("kb_versions", "SELECT document_id, version_id, version_number, review_status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_number DESC) AS r FROM kb_versions) WHERE r = 1"))
def j2(spark, d):
    return ordering.latest(C.versions(spark, d).select("document_id", "version_id", "version_number", "review_status"), ["document_id"], F.col("version_number"))


@query("a6_collection_summary", "SELECT r_name AS collection, count(DISTINCT n_nationkey) AS items, count(DISTINCT CASE WHEN c_acctbal < 0 THEN c_custkey END) AS high_risk, count(DISTINCT CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS unresolved FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a6(spark, d):
    t = lambda n: C.table(spark, d, n)
    orders = t("orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("open"))
    people = t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("risky"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"))
    items = t("nation").join(people, F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_regionkey").agg(F.count("*").alias("items"), F.coalesce(F.sum("risky"), F.lit(0)).alias("high_risk"), F.coalesce(F.sum("open"), F.lit(0)).alias("unresolved"))
    return t("region").join(items, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("collection"), "items", "high_risk", "unresolved")


@query("a7_facet_values", using("kb_status", "SELECT facet, value FROM (SELECT DISTINCT 'vertical' AS facet, vertical AS value FROM kb_status UNION SELECT 'status', status FROM kb_status UNION SELECT 'risk_level', risk_level FROM kb_status UNION SELECT 'review_status', review_status FROM kb_status) WHERE value <> ''"))
def a7(spark, d):
    v = _status(spark, d)
    return v.select(F.inline(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("vertical", "status", "risk_level", "review_status"))))).where("value <> ''").distinct()


@query("a15_publish_readiness", using("kb_versions kb_units", ", a AS (SELECT version_id, count(*) AS units, count(*) FILTER (length(content) > 400) AS long_units, count(DISTINCT content) AS different FROM kb_units GROUP BY 1), j AS (SELECT v.version_id, review_status, risk_level, coalesce(units, 0) AS units, coalesce(long_units, 0) AS long_units, coalesce(different, 0) AS different FROM kb_versions v LEFT JOIN a ON a.version_id = v.version_id) SELECT version_id, units, array_to_string(list_filter([CASE WHEN units < 1 THEN 'no_units' END, CASE WHEN long_units > 0 THEN 'oversize_units' END, CASE WHEN different < units THEN 'duplicate_units' END, CASE WHEN review_status <> 'approved' THEN 'not_approved' END, CASE WHEN risk_level = 'high' THEN 'high_risk' END], lambda x: x IS NOT NULL), ',') AS failures FROM j"))
def a15(spark, d):
    return G.publish_readiness(C.units(spark, d), C.versions(spark, d).select("version_id", "review_status", "risk_level"))


@query("a16_governance_failures", using("kb_versions", ", w AS (SELECT *, DATE '2024-01-01' + CAST(version_id % 400 AS INT) AS reviewed FROM kb_versions) SELECT version_id, code FROM (SELECT version_id, 'risk_missing' AS code FROM w WHERE risk_level = '' UNION ALL SELECT version_id, 'review_missing' FROM w WHERE review_status = 'needs_review' UNION ALL SELECT version_id, 'review_overdue' FROM w WHERE date_diff('day', reviewed, DATE '2025-01-01') > 180)"))
def a16(spark, d):
    v = C.versions(spark, d).withColumn("last_reviewed_at", F.date_add(F.lit("2024-01-01"), (F.col("version_id") % 400).cast("int")))
    return G.governance_failures(v, "2025-01-01", 180)


@query("a28_document_health", using("kb_status", "SELECT version_id, greatest(28, least(100, 92 - CASE WHEN review_status <> 'approved' THEN 18 ELSE 0 END - CASE WHEN risk_level = 'high' THEN 14 ELSE 0 END - CASE WHEN status <> 'published' THEN 10 ELSE 0 END - CASE WHEN version_id % 7 = 0 THEN 12 ELSE 0 END)) AS health FROM kb_status"))
def a28(spark, d):
    return _status(spark, d).select("version_id", G.health_score(F.col("review_status"), F.col("risk_level"), F.col("status"), F.col("version_id") % 7 == 0).alias("health"))


@query("a29_dashboard_counts", using("kb_status", "SELECT count(*) AS documents, count(*) FILTER (status = 'published') AS published, count(*) FILTER (review_status = 'needs_review') AS review, count(*) FILTER (risk_level = 'high') AS high_risk, count(*) FILTER (review_status <> 'approved') AS unapproved FROM kb_status"))
def a29(spark, d):
    return _status(spark, d).agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "published").alias("published"), F.count_if(F.col("review_status") == "needs_review").alias("review"), F.count_if(F.col("risk_level") == "high").alias("high_risk"), F.count_if(F.col("review_status") != "approved").alias("unapproved"))


@query("a35_row_counts", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events")
def a35(spark, d):
    every = None
    for t in ("documents", "pages", "labels", "events"):
        n = C.table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        every = n if every is None else every.unionByName(n)
    return every


@query("k13_compiled_pages", using("kb_status kb_units", "SELECT version_id, CASE WHEN length(content) < 40 THEN 'short' ELSE 'body' END AS page_type, count(*) AS units, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS content_md5 FROM kb_units JOIN kb_status USING (version_id) WHERE review_status = 'approved' GROUP BY ALL"))
def k13(spark, d):
    u = C.units(spark, d).join(C.versions(spark, d).where("review_status = 'approved'").select("version_id"), "version_id", "left_semi")
    kind = F.when(F.length("content") < 40, "short").otherwise("body")
    grouped = u.groupBy("version_id", kind.alias("page_type")).agg(F.count("*").alias("units"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m"))
    return grouped.select("version_id", "page_type", "units", F.md5(F.array_join(F.col("m.content"), "\n")).alias("content_md5"))


@query("k15_publish", using("kb_status", ", q AS (SELECT document_id, max(version_number) AS n FROM kb_status WHERE version_id % 11 = 0 GROUP BY 1) SELECT v.version_id, v.document_id, CASE WHEN q.n = v.version_number THEN 'published' WHEN q.n IS NOT NULL AND status = 'published' THEN 'archived' ELSE status END AS status FROM kb_status v LEFT JOIN q ON q.document_id = v.document_id"))
def k15(spark, d):
    v = _status(spark, d).select("version_id", "document_id", "version_number", "status")
    return G.publish(v, v.where("version_id % 11 = 0").select("version_id")).select("version_id", "document_id", "status")


@query("k16_mark_indexing", using("kb_status", "SELECT version_id, CASE WHEN status <> 'published' THEN status WHEN version_id % 3 = 0 THEN 'published_ready' WHEN version_id % 3 = 1 THEN 'published_indexing_failed' ELSE 'published_indexing_pending' END AS publish_state FROM kb_status"))
def k16(spark, d):
    v = _status(spark, d).select("version_id", "status")
    return G.mark_indexing(v, v.where("version_id % 3 < 2").select("version_id", (F.col("version_id") % 3 == 0).alias("ok"))).select("version_id", "publish_state")


@query("k17_promote_candidates", using("kb_versions", "SELECT version_id, CASE WHEN review_status = 'approved' AND risk_level <> 'high' THEN 'rule' WHEN review_status = 'approved' THEN 'restricted_rule' ELSE 'candidate_rule' END AS unit_type FROM kb_versions"))
def k17(spark, d):
    approved = F.col("review_status") == "approved"
    return C.versions(spark, d).select("version_id", F.when(approved & (F.col("risk_level") != "high"), "rule").when(approved, "restricted_rule").otherwise("candidate_rule").alias("unit_type"))


@query("u1_union_distinct", using("kb_versions", "SELECT vertical AS value FROM kb_versions UNION SELECT review_status FROM kb_versions"))
def u1(spark, d):
    v = C.versions(spark, d)
    return v.select(F.col("vertical").alias("value")).union(v.select("review_status")).distinct()


@query("u3_distinct_on", "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def u3(spark, d):
    docs = C.table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return ordering.latest(docs, ["source"], F.struct("n_chars", -F.col("doc_id")))


@query("u5_exclude_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def u5(spark, d):
    return C.table(spark, d, "documents").select("doc_id").join(C.table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("u6_insert_if_absent", "SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, 0 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def u6(spark, d):
    labels = C.table(spark, d, "labels").select("doc_id", "quality")
    return labels.unionByName(u5(spark, d).withColumn("quality", F.lit(0)))


@query("o5_listing_order", using("kb_versions", "SELECT version_id, row_number() OVER (ORDER BY CASE review_status WHEN 'needs_review' THEN 0 WHEN 'rejected' THEN 1 ELSE 2 END, n_chars DESC NULLS LAST, version_id) AS place FROM kb_versions QUALIFY place <= 50"))
def o5(spark, d):
    order = (F.when(F.col("review_status") == "needs_review", 0).when(F.col("review_status") == "rejected", 1).otherwise(2), F.col("n_chars").desc_nulls_last(), F.col("version_id"))
    first = C.versions(spark, d).select("version_id", "review_status", "n_chars").orderBy(*order).limit(50)
    return ordering.top_k(first.withColumn("g", F.lit(0)), ["g"], 50, *order, rank="place").select("version_id", "place")

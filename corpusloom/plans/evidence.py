"""Queries: locators, evidence gates, validators, further scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, ordering
from corpusloom.operators import evidence as E
from corpusloom.operators import ranking as K
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import TOKENS
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

KINDS = ("policy_table", "kb_index_workbook", "workflow_diagram", "policy_rule", "other")
LI = """li AS (SELECT l_orderkey, l_linenumber, l_orderkey || ':' || l_linenumber AS id, (l_orderkey + l_linenumber) % 7 AS m, ['policy_table', 'kb_index_workbook', 'workflow_diagram', 'policy_rule', 'other'][1 + (l_orderkey % 5)::INT] AS kind FROM lineitem)"""


def _li(spark, d):
    """Line items as units with one locator each, of a class by m."""
    m = (F.col("l_orderkey") + F.col("l_linenumber")) % 7
    n = F.col("l_linenumber")
    at = lambda *k, v=n: F.when(F.col("m").isin(*k), v)
    box = F.array(F.lit(0.0), F.lit(0.0), n.cast("double"), F.when(F.col("l_linenumber") == 4, 0.0).otherwise(5.0))
    base = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").withColumn("m", m)
    one = E.ref(page=at(0, 1, 5), bbox=F.when(F.col("m") == 0, box), sheet=F.when(F.col("m") == 2, F.lit("s")), row_start=at(2), table_index=at(3), row_index=at(3), paragraph_index=at(4), line_start=at(5), block_id=F.when(F.col("m").isin(4, 6), F.lit("b")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return base.select("l_orderkey", "l_linenumber", "m", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), kind.alias("kind"), F.array(one).alias("refs"))


QUALITY = "CASE m WHEN 0 THEN 'bbox' WHEN 1 THEN 'page_only' WHEN 2 THEN 'sheet_row' WHEN 3 THEN 'table_row' WHEN 4 THEN 'paragraph_only' WHEN 5 THEN 'line_span' ELSE 'structured' END"


@query("a34_source_ref_quality", f"WITH {LI} SELECT id, {QUALITY} AS quality FROM li")
def a34(spark, d):
    return _li(spark, d).select("id", E.ref_quality(F.col("refs")).alias("quality"))


@query("d21_ref_quality_for_ranking", f"WITH {LI} SELECT id, CASE m WHEN 3 THEN 'table_row' WHEN 0 THEN 'bbox' WHEN 4 THEN 'block_id' WHEN 6 THEN 'block_id' ELSE 'none' END AS quality FROM li")
def d21(spark, d):
    return _li(spark, d).select("id", E.ranking_ref_quality(F.col("refs")).alias("quality"))


@query("f8_has_page_bbox", f"WITH {LI} SELECT id FROM li WHERE m = 0 AND l_linenumber <> 4")
def f8(spark, d):
    return _li(spark, d).where(E.has_page_bbox(F.col("refs"))).select("id")


@query("f16_required_source_ref", f"WITH {LI} SELECT id, CASE kind WHEN 'policy_table' THEN m IN (2, 3) WHEN 'kb_index_workbook' THEN m = 2 WHEN 'workflow_diagram' THEN m IN (0, 1, 5) WHEN 'policy_rule' THEN m IN (0, 1, 3, 4, 5) ELSE TRUE END AS ok FROM li")
def f16(spark, d):
    return _li(spark, d).select("id", E.required_ref(F.col("kind"), F.col("refs")).alias("ok"))


@query("f7_indexable", f"WITH {LI} SELECT id FROM li WHERE kind <> 'kb_index_workbook' AND l_linenumber <> 3 AND l_orderkey % 2 = 0 AND (kind <> 'workflow_diagram' OR (m = 0 AND l_linenumber <> 4))")
def f7(spark, d):
    unit = F.when(F.col("kind") == "kb_index_workbook", "candidate_rule").otherwise(F.col("kind"))
    review = F.when(F.col("l_linenumber") == 3, "needs_review").otherwise("approved")
    extraction = F.when(F.col("l_orderkey") % 2 == 0, "structured").otherwise("degraded")
    return _li(spark, d).where(E.indexable(unit, review, extraction, F.lit(None).cast("boolean"), F.col("refs"), ("workflow_diagram",))).select("id")


@query("f14_effective_heading", using("kb_units", f", h AS (SELECT version_id, chunk_index, content, CASE chunk_index % 4 WHEN 0 THEN '1.2.' WHEN 1 THEN left(content, 12) WHEN 2 THEN 'Row' ELSE 'Terms of use' END AS h FROM kb_units) SELECT version_id, chunk_index, CASE WHEN chunk_index % 4 = 0 THEN '' WHEN chunk_index % 4 = 1 AND length(trim(h)) > 7 THEN '' WHEN chunk_index % 4 = 2 THEN '' ELSE h END AS heading FROM h WHERE chunk_index % 4 <> 1 OR length(trim(h)) > 7"))
def f14(spark, d):
    k = F.col("chunk_index") % 4
    u = C.units(spark, d).withColumn("h", F.when(k == 0, "1.2.").when(k == 1, F.substring("content", 1, 12)).when(k == 2, "Row").otherwise("Terms of use"))
    return u.where((k != 1) | (F.length(F.trim("h")) > 7)).select("version_id", "chunk_index", E.effective_heading(F.col("h"), F.col("content"), ("row", "yes", "no")).alias("heading"))


@query("a17_unresolved_relation_gate", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority LIKE '1%') AS blocking FROM orders GROUP BY 1")
def a17(spark, d):
    return C.table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").startswith("1")).alias("blocking"))


@query("a19_compilation_plan", f"WITH {LI} SELECT l_orderkey, kind, count(*) AS units, count(*) FILTER (m = 6) AS missing_evidence, count(*) FILTER (m = 6) = 0 AS passes FROM li GROUP BY ALL")
def a19(spark, d):
    q = E.ref_quality(F.col("refs"))
    g = _li(spark, d).withColumn("q", q).groupBy("l_orderkey", "kind").agg(F.count("*").alias("units"), F.count_if(F.col("q") == "structured").alias("missing_evidence"))
    return g.withColumn("passes", F.col("missing_evidence") == 0)


@query("a22_policy_table_blockers", f"WITH {LI} SELECT l_orderkey, max(l_linenumber) - count(*) AS missing_rows, count(*) FILTER (m NOT IN (2, 3)) AS without_locator FROM li GROUP BY 1")
def a22(spark, d):
    ok = E.required_ref(F.lit("policy_table"), F.col("refs"))
    return _li(spark, d).groupBy("l_orderkey").agg((F.max("l_linenumber") - F.count("*")).alias("missing_rows"), F.count_if(~ok).alias("without_locator"))


@query("a32_adjudicate", f"WITH {LI} SELECT l_orderkey, coalesce(string_agg(id, ',' ORDER BY id) FILTER (m >= 5), '') AS low_confidence FROM li GROUP BY 1")
def a32(spark, d):
    return _li(spark, d).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("m") >= 5, F.col("id")))), ",").alias("low_confidence"))


@query("d42_evidence_quality_by_document", f"WITH {LI}, q AS (SELECT l_orderkey, CASE {QUALITY} WHEN 'bbox' THEN 1 WHEN 'sheet_row' THEN 2 WHEN 'table_row' THEN 3 WHEN 'paragraph_only' THEN 4 WHEN 'line_span' THEN 5 WHEN 'page_only' THEN 6 ELSE 7 END AS p, {QUALITY} AS q FROM li) SELECT l_orderkey, arg_max(q, p) AS worst, arg_min(q, p) AS best FROM q GROUP BY 1")
def d42(spark, d):
    return E.worst_quality(_li(spark, d).select("l_orderkey", E.ref_quality(F.col("refs")).alias("q")), "l_orderkey", "q")


@query("k12_evidence_validators", f"WITH {LI} SELECT code, id FROM (SELECT 'no_locator' AS code, id FROM li WHERE m = 6 UNION ALL SELECT 'sheet_without_row', id FROM li WHERE FALSE UNION ALL SELECT 'flat_box', id FROM li WHERE m = 0 AND l_linenumber = 4)")
def k12(spark, d):
    q = E.ref_quality(F.col("refs"))
    return E.violations(_li(spark, d), F.col("id"), {"no_locator": q == "structured", "sheet_without_row": E._any(F.col("refs"), lambda r: r["sheet"].isNotNull() & r["row_start"].isNull()), "flat_box": (q == "bbox") & ~E.has_page_bbox(F.col("refs"))})


@query("k11_semantic_units", f"WITH {LI} SELECT id, 'u-' || kind AS unit_type, CASE WHEN m = 6 THEN 'blocked' ELSE 'ok' END AS state FROM li")
def k11(spark, d):
    return _li(spark, d).select("id", F.concat(F.lit("u-"), "kind").alias("unit_type"), F.when(E.ref_quality(F.col("refs")) == "structured", "blocked").otherwise("ok").alias("state"))


@query("j17_chunk_element_match", using("kb_units", ", c AS (SELECT version_id, chunk_index // 5 AS chunk_id, min(chunk_index) AS s, max(chunk_index) AS e FROM kb_units GROUP BY ALL) SELECT c.version_id, chunk_id, u.chunk_index AS element_id, 1 AS tier FROM c JOIN kb_units u ON u.version_id = c.version_id AND u.chunk_index BETWEEN s AND e"))
def j17(spark, d):
    u = C.units(spark, d)
    chunks = u.groupBy("version_id", F.floor(F.col("chunk_index") / 5).alias("chunk_id")).agg(F.min("chunk_index").alias("line_start"), F.max("chunk_index").alias("line_end"), F.first("content").alias("content"))
    return E.match_elements(chunks, u.select("version_id", F.col("chunk_index").alias("element_id"), F.col("chunk_index").alias("line"), F.col("content").alias("text")), "version_id")


@query("f18_display_layer", using("kb_units", "SELECT version_id, chunk_index, chunk_index = 0 AS is_document_layer, length(content) < 25 AS is_evidence FROM kb_units"))
def f18(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", (F.col("chunk_index") == 0).alias("is_document_layer"), (F.length("content") < 25).alias("is_evidence"))


@query("f12_derived_filters", using("kb_versions", "SELECT version_id, CASE WHEN version_id % 3 = 0 THEN 'own' WHEN version_id % 2 = 0 AND (version_id % 10) / 10.0 >= 0.65 THEN vertical END AS scope FROM kb_versions"))
def f12(spark, d):
    q = C.versions(spark, d).select("version_id", F.when(F.col("version_id") % 2 == 0, "ai_chat").otherwise("portal").alias("mode"), ((F.col("version_id") % 10) / 10).alias("confidence"), F.when(F.col("version_id") % 3 == 0, "own").alias("filter_scope"), F.col("vertical").alias("understood_scope"), F.lit(None).cast("string").alias("filter_visibility"), F.lit("x").alias("understood_visibility"))
    return K.derived_filters(q, "mode", "confidence").select("version_id", "scope")


NORM = f"array_to_string({TOKENS}, ' ')"


@query("m9_structural_boost", using("kb_units", f", n AS (SELECT version_id, chunk_index, {NORM} AS h, 'the license version of' AS q FROM kb_units), w AS (SELECT *, len(list_filter(['license', 'version'], lambda t: contains(h, t))) AS k FROM n) SELECT version_id, chunk_index, round(0.75 * k + CASE WHEN h <> '' AND (contains(q, h) OR contains(h, q)) THEN 2 ELSE 0 END, 4)::DOUBLE AS boost FROM w"))
def m9(spark, d):
    u = C.units(spark, d).withColumn("h", T.normalize_phrase(F.col("content")))
    return u.select("version_id", "chunk_index", F.round(K.structural_boost(F.lit("the license version of"), F.lit(""), F.col("h"), F.lit("")), 4).alias("boost"))


@query("m10_intent_boost", using("kb_units", f", n AS (SELECT version_id, chunk_index, list_distinct({TOKENS}) AS ts, {NORM} AS n FROM kb_units), k AS (SELECT *, len(list_intersect(ts, ['of', 'the', 'and'])) AS t, CASE WHEN version_id % 2 = 0 THEN 1 ELSE 0 END AS m FROM n) SELECT version_id, chunk_index, round(least(m * 0.018::DOUBLE, 0.12) + least(t * 0.006::DOUBLE, 0.05) + CASE WHEN chunk_index % 2 = 0 AND m > 0 THEN 0.025 ELSE 0 END + CASE WHEN chunk_index % 2 = 0 AND t > 0 THEN least(t / 3 * 0.12, 0.18) ELSE 0 END + CASE WHEN contains(n, 'of the and') THEN 0.18 ELSE 0 END, 5) AS boost FROM k"))
def m10(spark, d):
    q = F.array(*map(F.lit, ("of", "the", "and")))
    meta = F.when(F.col("version_id") % 2 == 0, F.array(F.lit("and"), F.lit("zz"))).otherwise(F.array(F.lit("zz")))
    u = C.units(spark, d)
    b = K.intent_boost(q, meta, F.array_distinct(T.tokens(F.col("content"))), F.lit("of the and"), T.normalize_phrase(F.col("content")), F.when(F.col("chunk_index") % 2 == 0, "rule").otherwise("text"), ["rule"])
    return u.select("version_id", "chunk_index", F.round(b, 5).alias("boost"))


@query("m16_portal_score", using("kb_units", f", n AS (SELECT version_id, chunk_index, {NORM} AS n FROM kb_units), k AS (SELECT *, contains(n, 'the')::INT + contains(n, 'thing')::INT AS f FROM n) SELECT version_id, chunk_index, round((chunk_index % 10) / 10.0 * 100 + 10 * f + CASE WHEN f = 2 THEN 35 ELSE 0 END + CASE WHEN contains(n, 'the thing') THEN 25 ELSE 0 END, 4)::DOUBLE AS score FROM k"))
def m16(spark, d):
    q = F.array(F.lit("the"), F.lit("thing"))
    return C.units(spark, d).select("version_id", "chunk_index", F.round(K.portal_score((F.col("chunk_index") % 10) / 10, q, T.normalize_phrase(F.col("content")), F.lit("the thing")), 4).alias("score"))


@query("m7_preview_score", using("kb_units", f", n AS (SELECT version_id, chunk_index, {NORM} AS n FROM kb_units), t AS (SELECT *, left(n, 20) AS t FROM n) SELECT version_id, chunk_index, round((CASE WHEN contains(t, 'the') THEN 12 ELSE 0 END + CASE WHEN contains(n, 'the') THEN 5 ELSE 0 END + 2.8 * (contains(t, 'the')::INT) + 0.8 * (contains(n, 'the')::INT) + CASE WHEN version_id % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE, 4) AS score FROM t"))
def m7(spark, d):
    n = T.normalize_phrase(F.col("content"))
    return C.units(spark, d).select("version_id", "chunk_index", F.round(K.preview_score(F.substring(n, 1, 20), F.lit(""), n, F.lit("the"), F.array(F.lit("the")), F.col("version_id") % 2 == 0), 4).alias("score"))


@query("o6_preview_top", using("kb_units", f", n AS (SELECT version_id, chunk_index, {NORM} AS n FROM kb_units), s AS (SELECT version_id, chunk_index, len(n) - len(replace(n, 'the', '')) AS score FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY score DESC, chunk_index) AS place FROM s WHERE score > 1) SELECT version_id, chunk_index, place FROM r WHERE place <= 6"))
def o6(spark, d):
    n = T.normalize_phrase(F.col("content"))
    s = C.units(spark, d).withColumn("score", F.length(n) - F.length(F.replace(n, F.lit("the"), F.lit("")))).where("score > 1")
    return ordering.top_k(s, ["version_id"], 6, F.col("score").desc(), F.col("chunk_index"), rank="place").select("version_id", "chunk_index", "place")


@query("m14_policy_applicability", "SELECT vec_id, round(greatest(0, least(1, 0.5 * abs(embedding[1]::DOUBLE) + 0.3 * abs(embedding[2]::DOUBLE) + 0.9 * abs(embedding[3]::DOUBLE) - 0.32 * (label % 2))), 5)::DOUBLE AS score FROM embeddings")
def m14(spark, d):
    parts = {k: F.abs(F.col("v")[i]) for i, k in enumerate("abc")}
    return C.vectors(spark, d).select("vec_id", F.round(K.policy_applicability(parts, {"a": 0.5, "b": 0.3, "c": 0.9}, F.col("label") % 2), 5).alias("score"))


@query("m13_chat_score", using("kb_units", f", n AS (SELECT version_id, chunk_index, list_distinct(list_filter({TOKENS}, lambda t: t IN ('the', 'of', 'der', 'la'))) AS ts, (chunk_index % 10) / 10.0::DOUBLE AS a FROM kb_units), k AS (SELECT *, len(list_intersect(ts, ['the', 'of'])) AS own, list_contains(ts, 'the')::INT AS ch, list_contains(ts, 'la')::INT AS fc, list_contains(ts, 'der')::INT AS ex FROM n) SELECT version_id, chunk_index, round(greatest(0, 0.52 * greatest(0, 0.5 + 0.025 * own + 0.02 * ch + CASE WHEN a >= 0.58 THEN least(0.16, a * 0.14) ELSE 0 END - CASE WHEN fc = 1 AND ch = 0 THEN 0.09 ELSE 0 END - 0.07 * ex - CASE WHEN a < 0.32 THEN 0.1 ELSE 0 END) + 0.48 * a), 5)::DOUBLE AS score FROM k"))
def m13(spark, d):
    ts = F.array_distinct(F.filter(T.tokens(F.col("content")), lambda t: t.isin("the", "of", "der", "la")))
    s = K.chat_score(F.lit(0.5), F.array(F.lit("the"), F.lit("of")), ts, ["the", "la"], ["der"], (F.col("chunk_index") % 10) / 10)
    return C.units(spark, d).select("version_id", "chunk_index", F.round(s, 5).alias("score"))


@query("d20_validated_understanding", using("kb_versions", "SELECT version_id, CASE WHEN vertical IN ('en', 'de') THEN vertical ELSE 'generic' END AS scope FROM kb_versions"))
def d20(spark, d):
    return C.versions(spark, d).select("version_id", K.validated(F.col("vertical"), ["en", "de"], F.lit("generic")).alias("scope"))


@query("d19_heading_level", using("kb_units", "SELECT version_id, chunk_index, CASE WHEN length(content) < 20 THEN 1 WHEN regexp_matches(content, '^[IVX]+\\.') THEN 1 WHEN regexp_matches(content, '^\\d+\\.\\d+') THEN 2 WHEN length(content) < 60 THEN 3 END AS level FROM kb_units"))
def d19(spark, d):
    n = F.length("content")
    return C.units(spark, d).select("version_id", "chunk_index", F.when(n < 20, 1).when(F.col("content").rlike(r"^[IVX]+\."), 1).when(F.col("content").rlike(r"^\d+\.\d+"), 2).when(n < 60, 3).alias("level"))


@query("d18_inline_bullets", using("kb_units", "SELECT version_id, chunk_index, unnest(range(0, len(string_split(content, ' | ')))) AS part, trim(unnest(string_split(content, ' | '))) AS content FROM kb_units"))
def d18(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", F.posexplode(F.split("content", r" \| ")).alias("part", "c")).select("version_id", "chunk_index", "part", F.trim("c").alias("content"))


@query("d24_table_row_context", f"WITH {LI} SELECT a.id, count(*) AS siblings FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.id <> b.id WHERE a.m = 3 GROUP BY 1")
def d24(spark, d):
    a = _li(spark, d)
    return a.where("m = 3").select("id", "l_orderkey").join(a.select("l_orderkey", F.col("id").alias("other")), "l_orderkey").where("id <> other").groupBy("id").agg(F.count("*").alias("siblings"))


@query("d26_trace_payload", f"WITH {LI} SELECT l_orderkey, '[' || string_agg(l_linenumber, ',' ORDER BY l_linenumber) || ']' AS trace FROM li GROUP BY 1")
def d26(spark, d):
    return _li(spark, d).groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list("l_linenumber"))).alias("trace"))


@query("d59_note_attachment", using("kb_units", ", f AS (SELECT *, content LIKE '%|%' AS is_table FROM kb_units) SELECT version_id, chunk_index, last_value(CASE WHEN is_table THEN chunk_index END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS table_index FROM f"))
def d59(spark, d):
    return ordering.fill_forward(C.units(spark, d), ["version_id"], ["chunk_index"], F.when(F.contains("content", F.lit("|")), F.col("chunk_index")), "table_index", before_only=True).select("version_id", "chunk_index", "table_index")


@query("d63_section_parents", using("kb_units", "SELECT version_id, chunk_index // 4 AS section, left(string_agg(content, ' ' ORDER BY chunk_index), 120) AS preview, min(chunk_index) AS first_line, max(chunk_index) AS last_line FROM kb_units GROUP BY ALL"))
def d63(spark, d):
    g = C.units(spark, d).groupBy("version_id", F.floor(F.col("chunk_index") / 4).alias("section")).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m"), F.min("chunk_index").alias("first_line"), F.max("chunk_index").alias("last_line"))
    return g.select("version_id", "section", F.substring(F.array_join("m.content", " "), 1, 120).alias("preview"), "first_line", "last_line")


@query("d44_sheet_ref_repair", using("kb_units", ", h AS (SELECT *, last_value(CASE WHEN length(content) < 40 THEN chunk_index END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS h FROM kb_units) SELECT version_id, chunk_index, h AS sheet_line, chunk_index - h AS row_in_sheet FROM h WHERE h IS NOT NULL"))
def d44(spark, d):
    h = ordering.fill_forward(C.units(spark, d), ["version_id"], ["chunk_index"], F.when(F.length("content") < 40, F.col("chunk_index")), "sheet_line")
    return h.where("sheet_line is not null").select("version_id", "chunk_index", "sheet_line", (F.col("chunk_index") - F.col("sheet_line")).alias("row_in_sheet"))


@query("k21_semantic_dedupe")
def k21(spark, d):
    """Units of one version of which a shorter one's tokens are contained in a longer one; the longest stays."""
    u = C.units(spark, d).where(F.length("content") >= 28).select("version_id", "chunk_index", F.array_distinct(T.tokens(F.col("content"))).alias("ts"))
    a, b = u.withColumnsRenamed({"chunk_index": "a", "ts": "ta"}), u.withColumnsRenamed({"chunk_index": "b", "ts": "tb"})
    near = a.join(b, "version_id").where((F.col("a") != F.col("b")) & ((F.size("ta") < F.size("tb")) | ((F.size("ta") == F.size("tb")) & (F.col("a") > F.col("b")))) & (F.size(F.array_intersect("ta", "tb")) >= 0.86 * F.size("ta")))
    return near.groupBy("version_id", "a").agg(F.min("b").alias("kept_by")).withColumnRenamed("a", "chunk_index")


@query("k36_degraded_units", using("kb_units", "SELECT version_id, CASE WHEN length(content) > 300 THEN 'degraded_section' WHEN content LIKE '%|%' THEN 'degraded_row' ELSE 'degraded_line' END AS unit_type, count(*) AS n FROM kb_units GROUP BY ALL"))
def k36(spark, d):
    kind = F.when(F.length("content") > 300, "degraded_section").when(F.contains("content", F.lit("|")), "degraded_row").otherwise("degraded_line")
    return C.units(spark, d).groupBy("version_id", kind.alias("unit_type")).agg(F.count("*").alias("n"))


@query("k35_prepare_corpus")
def k35(spark, d):
    """The ingestion chain: lines, units, chunks and a gate per version."""
    docs = C.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), "text")
    units = chunking.logical_units(docs, "version_id", "text")
    chunks = chunking.chunk(units, "version_id", ["paragraph", "sentence"], "content")
    n = units.groupBy("version_id").agg(F.count("*").alias("units"), F.count_if(F.col("unit_type") == "note").alias("notes"))
    c = chunks.groupBy("version_id").agg(F.count("*").alias("chunks"), F.max("tokens").alias("largest"))
    return n.join(c, "version_id", "left").withColumn("ready", (F.col("chunks") > 0) & (F.col("units") > 0))


@query("d39_locators", using("kb_units", "SELECT version_id, chunk_index // 5 AS block, min(chunk_index) + 1 AS line_start, max(chunk_index) + 1 AS line_end FROM kb_units GROUP BY ALL"))
def d39(spark, d):
    return C.units(spark, d).groupBy("version_id", F.floor(F.col("chunk_index") / 5).alias("block")).agg((F.min("chunk_index") + 1).alias("line_start"), (F.max("chunk_index") + 1).alias("line_end"))


@query("d36_unit_refinement", using("kb_units", "SELECT version_id, chunk_index, CASE WHEN content LIKE '%|%' THEN 'table' ELSE 'text' END AS tag, length(content) >= 20 AS dedupe_eligible FROM kb_units"))
def d36(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", F.when(F.contains("content", F.lit("|")), "table").otherwise("text").alias("tag"), (F.length("content") >= 20).alias("dedupe_eligible"))


@query("d37_refinement_guard", using("kb_units", ", r AS (SELECT * FROM kb_units WHERE length(content) >= 10), a AS (SELECT version_id, count(*) AS before_n FROM kb_units GROUP BY 1), b AS (SELECT version_id, count(*) AS after_n, count(*) - count(DISTINCT content) AS repeated FROM r GROUP BY 1) SELECT a.version_id, before_n, coalesce(after_n, 0) AS after_n, coalesce(after_n, 0) >= 0.9 * before_n AND coalesce(repeated, 0) = 0 AS ok FROM a LEFT JOIN b ON a.version_id = b.version_id"))
def d37(spark, d):
    u = C.units(spark, d)
    after = u.where(F.length("content") >= 10).groupBy("version_id").agg(F.count("*").alias("after_n"), (F.count("*") - F.countDistinct("content")).alias("repeated"))
    j = u.groupBy("version_id").agg(F.count("*").alias("before_n")).join(after, "version_id", "left").fillna(0, ["after_n", "repeated"])
    return j.select("version_id", "before_n", "after_n", ((F.col("after_n") >= 0.9 * F.col("before_n")) & (F.col("repeated") == 0)).alias("ok"))


@query("d57_taxonomy_frame", "SELECT 'english' AS intent, unnest(['the', 'of the', 'and']) AS phrase UNION ALL SELECT 'german', unnest(['der', 'und', 'die']) UNION ALL SELECT r_name, lower(r_name) FROM region")
def d57(spark, d):
    fixed = K.rules_frame(spark, {"english": ["the", "of the", "and"], "german": ["der", "und", "die"]}).select("intent", "phrase")
    return fixed.unionByName(C.table(spark, d, "region").select(F.col("r_name").alias("intent"), F.lower("r_name").alias("phrase")))


@query("u2_ordered_distinct", using("kb_units", f"SELECT version_id, chunk_index, len(list_distinct({TOKENS})) AS n FROM kb_units"))
def u2(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", F.size(F.array_distinct(T.tokens(F.col("content")))).alias("n"))


@query("x1_sql_normalisers", using("kb_units", f"SELECT version_id, chunk_index, {NORM} AS value FROM kb_units"))
def x1(spark, d):
    T.register(spark)
    return C.units(spark, d).select("version_id", "chunk_index", F.expr("normalize_phrase(content)").alias("value"))


@query("o3_chat_order", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 3, round(embedding[1]::DOUBLE, 9) DESC, vec_id) AS place FROM embeddings")
def o3(spark, d):
    v = C.vectors(spark, d)
    return v.select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.col("vec_id") % 3, F.round(F.col("v")[0], 9).desc(), "vec_id")).alias("place"))


@query("c29_metadata_merge", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'override' END, event_type) AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def c29(spark, d):
    base = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    more = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("kind"), F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_zip_with(base, more, lambda k, a, b: F.coalesce(b, a))
    return C.table(spark, d, "events").select("event_id", merged["kind"].alias("kind"), merged["k"].cast("int").alias("k"))


@query("c28_flatten_metadata", "SELECT event_id, array_to_string(list_sort(['event_type', event_type, 'k', json_extract_string(props, '$.k')]), ' ') AS terms FROM events")
def c28(spark, d):
    m = F.map_concat(F.create_map(F.lit("event_type"), F.col("event_type")), F.from_json("props", "map<string,string>"))
    return C.table(spark, d, "events").select("event_id", F.array_join(F.array_sort(F.concat(F.map_keys(m), F.map_values(m))), " ").alias("terms"))


@query("d2_unpack_artifacts", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, coalesce(json_extract_string(props, '$.note'), 'none') AS note FROM events")
def d2(spark, d):
    p = F.from_json("props", "k int, note string")
    return C.table(spark, d, "events").select("event_id", p["k"].alias("k"), F.coalesce(p["note"], F.lit("none")).alias("note"))


@query("d3_status_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'O' THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus = 'O' THEN 2 ELSE 1 END AS attempts FROM orders")
def d3(spark, d):
    o = C.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    asked = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("F").alias("new"))
    hit = F.col("new").isNotNull() & (F.col("o_orderstatus") == "O")
    return o.join(asked, "o_orderkey", "left").select("o_orderkey", F.when(hit, F.col("new")).otherwise(F.col("o_orderstatus")).alias("status"), F.when(hit, 2).otherwise(1).alias("attempts"))


@query("d4_nested_view", "SELECT o_orderkey, count(l_linenumber) AS n, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def d4(spark, d):
    lines = C.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ",").alias("lines"))
    return C.table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey", "left").fillna(0, ["n"])

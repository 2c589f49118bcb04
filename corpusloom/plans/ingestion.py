"""Queries: units, chunks, evidence elements, quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking as K
from corpusloom.operators import ordering
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import TOKENS
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

SENT = "list_filter(list_transform(string_split(regexp_replace({x}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda y: trim(y)), lambda y: y <> '')"
LOGICAL = f""", p AS (SELECT version_id, chunk_index, {SENT.format(x='raw')} AS s FROM kb_lines WHERE trim(raw) <> ''), u AS (SELECT version_id, chunk_index AS paragraph, unnest(range(0, len(s))) AS sentence, unnest(s) AS content FROM p)"""
KIND = "CASE WHEN regexp_matches(lower(content), '^(note|nota|hinweis|remarque)($|[^\\p{L}])') THEN 'note' WHEN regexp_matches(content, '^\\s*(?:[-*•+]|\\d+[.)]|[a-z][.)])\\s+\\S') THEN 'bullet' WHEN regexp_matches(lower(content), '(^|[^\\p{L}])(if|when|unless|quand|wenn)($|[^\\p{L}])') THEN 'condition' ELSE 'section' END"


def _logical(spark, d):
    return K.logical_units(C.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), "text"), "version_id", "text")


@query("k1_logical_units", using("kb_lines", LOGICAL + f" SELECT version_id, paragraph, sentence, content, {KIND} AS unit_type FROM u"))
def k1(spark, d):
    return _logical(spark, d)


@query("c15_infer_unit_type", using("kb_lines", LOGICAL + f", k AS (SELECT version_id, {KIND} AS unit_type FROM u) SELECT version_id, unit_type, count(*) AS n FROM k GROUP BY ALL"))
def c15(spark, d):
    return _logical(spark, d).groupBy("version_id", "unit_type").agg(F.count("*").alias("n"))


@query("k2_repair_units")
def k2(spark, d):
    u = C.units(spark, d).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m"))
    return u.select("version_id", F.posexplode(K.repair(F.col("m.content"), r"(,|\b(and|or|und|et|y|the|of))$")).alias("unit", "content"))


@query("k3_chunk")
def k3(spark, d):
    return K.chunk(_logical(spark, d), "version_id", ["paragraph", "sentence"], "content")


@query("k8_document_layer", "SELECT doc_id AS version_id, -1 AS chunk_index, left(text, 30000) AS content FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k8(spark, d):
    docs = C.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), "text")
    have = C.table(spark, d, "labels").select(F.col("doc_id").alias("version_id"))
    return docs.join(have, "version_id", "left_anti").select("version_id", F.lit(-1).alias("chunk_index"), F.substring("text", 1, 30_000).alias("content"))


@query("w5_title_dedupe", using("kb_units", ", n AS (SELECT version_id, chunk_index, content, row_number() OVER (PARTITION BY version_id, lower(content) ORDER BY chunk_index) AS n FROM kb_units) SELECT version_id, chunk_index, CASE WHEN n > 1 THEN content || ' (' || n || ')' ELSE content END AS title FROM n"))
def w5(spark, d):
    n = F.row_number().over(Window.partitionBy("version_id", F.lower("content")).orderBy("chunk_index"))
    return C.units(spark, d).withColumn("n", n).select("version_id", "chunk_index", F.when(F.col("n") > 1, F.concat("content", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("content")).alias("title"))


@query("w6_attach_notes", using("kb_units", ", f AS (SELECT *, length(content) < 25 AS note FROM kb_units) SELECT version_id, chunk_index, CASE WHEN note THEN last_value(CASE WHEN NOT note THEN chunk_index END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent FROM f"))
def w6(spark, d):
    note = F.length("content") < 25
    filled = ordering.fill_forward(C.units(spark, d), ["version_id"], ["chunk_index"], F.when(~note, F.col("chunk_index")), "before", before_only=True)
    return filled.select("version_id", "chunk_index", F.when(note, F.col("before")).alias("parent"))


@query("w7_section_path", using("kb_units", ", l AS (SELECT *, CASE WHEN length(content) < 60 THEN 1 + length(content) % 3 END AS lvl FROM kb_units), g AS (SELECT *, count(CASE WHEN lvl <= 1 THEN 1 END) OVER w AS g1, count(CASE WHEN lvl <= 2 THEN 1 END) OVER w AS g2, count(CASE WHEN lvl <= 3 THEN 1 END) OVER w AS g3 FROM l WINDOW w AS (PARTITION BY version_id ORDER BY chunk_index)), h AS (SELECT *, max(CASE WHEN lvl = 1 THEN content END) OVER (PARTITION BY version_id, g1) AS h1, max(CASE WHEN lvl = 2 THEN content END) OVER (PARTITION BY version_id, g2) AS h2, max(CASE WHEN lvl = 3 THEN content END) OVER (PARTITION BY version_id, g3) AS h3 FROM g) SELECT version_id, chunk_index, concat_ws(' > ', h1, h2, h3) AS section_path FROM h"))
def w7(spark, d):
    u = C.units(spark, d).withColumn("lvl", F.when(F.length("content") < 60, 1 + F.length("content") % 3))
    return K.section_path(u, ["version_id"], ["chunk_index"], "lvl", "content").select("version_id", "chunk_index", "section_path")


@query("w8_precedes", using("kb_units", "SELECT version_id, chunk_index, lead(chunk_index) OVER (PARTITION BY version_id ORDER BY chunk_index) AS next_index FROM kb_units"))
def w8(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", F.lead("chunk_index").over(Window.partitionBy("version_id").orderBy("chunk_index")).alias("next_index"))


@query("w9_paragraph_groups", using("kb_units", ", b AS (SELECT *, CASE WHEN chunk_index = 0 OR length(content) < 40 THEN 1 ELSE 0 END AS brk FROM kb_units), s AS (SELECT *, sum(brk) OVER (PARTITION BY version_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS grp FROM b) SELECT version_id, CAST(grp AS BIGINT) AS grp, count(*) AS units, CAST(sum(length(content)) AS BIGINT) AS chars FROM s GROUP BY ALL"))
def w9(spark, d):
    brk = F.when((F.col("chunk_index") == 0) | (F.length("content") < 40), 1).otherwise(0)
    g = F.sum(brk).over(Window.partitionBy("version_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0))
    return C.units(spark, d).withColumn("grp", g).groupBy("version_id", "grp").agg(F.count("*").alias("units"), F.sum(F.length("content")).alias("chars"))


@query("w10_header_fill", "WITH c AS (SELECT p_partkey, unnest(range(0, 3)) AS pos, unnest([CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 = 0 THEN p_type END, NULL]) AS header FROM part) SELECT p_partkey, pos, last_value(header IGNORE NULLS) OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM c")
def w10(spark, d):
    cells = F.array(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), F.lit(None).cast("string"))
    c = C.table(spark, d, "part").select("p_partkey", F.posexplode(cells).alias("pos", "h"))
    return ordering.fill_forward(c, ["p_partkey"], ["pos"], F.col("h"), "header").select("p_partkey", "pos", "header")


@query("c22_row_sentence", "SELECT p_partkey, concat_ws('; ', 'name: ' || p_name, 'brand: ' || p_brand, 'size: ' || p_size) AS sentence FROM part")
def c22(spark, d):
    headers, values = F.array(*map(F.lit, ("name", "brand", "size"))), F.array(*(F.col(c).cast("string") for c in ("p_name", "p_brand", "p_size")))
    return C.table(spark, d, "part").select("p_partkey", F.array_join(F.zip_with(headers, values, lambda h, v: F.concat(h, F.lit(": "), v)), "; ").alias("sentence"))


@query("k10_cells", "SELECT p_partkey, unnest(range(0, 3)) AS col, unnest([chr(65) || p_partkey, chr(66) || p_partkey, chr(67) || p_partkey]) AS ref, unnest([p_name, p_brand, p_size::VARCHAR]) AS value FROM part")
def k10(spark, d):
    c = C.table(spark, d, "part").select("p_partkey", F.posexplode(F.array(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"))).alias("col", "value"))
    return c.select("p_partkey", "col", K.cell_name(F.col("col"), F.col("p_partkey")).alias("ref"), "value")


@query("k9_evidence_elements")
def k9(spark, d):
    e = K.html_elements(C.table(spark, d, "pages"), "page_id", "html")
    return e.select("page_id", "position", "kind", "text", F.sha2("text", 256).alias("excerpt_hash"))


@query("a31_observe_document", using("kb_lines", LOGICAL + f", k AS (SELECT version_id, {KIND} AS unit_type FROM u) SELECT unit_type, count(*) AS n, count(DISTINCT version_id) AS versions FROM k GROUP BY 1"))
def a31(spark, d):
    return _logical(spark, d).groupBy("unit_type").agg(F.count("*").alias("n"), F.countDistinct("version_id").alias("versions"))


@query("a33_evidence_hash", using("kb_units", "SELECT version_id, sha256(string_agg(id, ',' ORDER BY id)) AS evidence_hash FROM (SELECT DISTINCT version_id, version_id || ':' || chunk_index AS id FROM kb_units) GROUP BY 1"))
def a33(spark, d):
    return C.units(spark, d).groupBy("version_id").agg(F.collect_list(F.concat_ws(":", "version_id", "chunk_index")).alias("ids")).select("version_id", K.evidence_hash(F.col("ids")).alias("evidence_hash"))


@query("a10_content_dedupe", using("kb_units", "SELECT md5(content) AS fingerprint, count(*) AS copies, count(DISTINCT version_id) AS versions, min(version_id) AS first_version FROM kb_units GROUP BY 1 HAVING count(*) > 1"))
def a10(spark, d):
    return C.units(spark, d).groupBy(F.md5("content").alias("fingerprint")).agg(F.count("*").alias("copies"), F.countDistinct("version_id").alias("versions"), F.min("version_id").alias("first_version")).where("copies > 1")


@query("a9_reduce_claims", using("kb_units", "SELECT left(lower(content), 12) AS title, count(*) AS dup_count, max(length(content)) AS longest, array_to_string(list_slice(list_sort(list(DISTINCT version_id)), 1, 5), ',') AS ids FROM kb_units GROUP BY 1"))
def a9(spark, d):
    g = C.units(spark, d).groupBy(F.substring(F.lower("content"), 1, 12).alias("title")).agg(F.count("*").alias("dup_count"), F.max(F.length("content")).alias("longest"), F.slice(F.array_sort(F.collect_set("version_id")), 1, 5).alias("ids"))
    return g.withColumn("ids", F.array_join("ids", ","))


CLAIMS = f", c AS (SELECT version_id, content, {KIND} AS unit_type FROM kb_units), k AS (SELECT version_id, content, unit_type, md5(array_to_string(list_prepend(unit_type, {TOKENS}), ' ')) AS claim FROM c)"


@query("a9_claims", using("kb_units", CLAIMS + " SELECT claim, unit_type, count(*) AS dup_count, max(length(content)) AS longest, count(DISTINCT version_id) AS versions FROM k GROUP BY ALL"))
def a9_claims(spark, d):
    return K.claim_counts(K.claims(C.units(spark, d), "content"), "version_id", "content")


@query("a9_claim_members", using("kb_units", CLAIMS + " SELECT DISTINCT claim, version_id FROM k"))
def a9_members(spark, d):
    return K.claims(C.units(spark, d), "content").select("claim", "version_id").distinct()


@query("a11_rule_groups", using("kb_units", ", g AS (SELECT version_id, length(content) // 100 AS grp, count(*) AS members, min(chunk_index) AS first_index FROM kb_units GROUP BY ALL) SELECT * FROM g WHERE members >= 2"))
def a11(spark, d):
    return C.units(spark, d).groupBy("version_id", F.floor(F.length("content") / 100).alias("grp")).agg(F.count("*").alias("members"), F.min("chunk_index").alias("first_index")).where("members >= 2")


@query("a12_rule_conflicts", using("kb_units", "SELECT left(content, 8) AS case_key, count(DISTINCT length(content)) AS thresholds FROM kb_units GROUP BY 1 HAVING count(DISTINCT length(content)) > 1 OR (bool_or(content LIKE '%.') AND bool_or(content NOT LIKE '%.'))"))
def a12(spark, d):
    ends = F.col("content").endswith(".")
    g = C.units(spark, d).groupBy(F.substring("content", 1, 8).alias("case_key")).agg(F.countDistinct(F.length("content")).alias("thresholds"), F.bool_or(ends).alias("t"), F.bool_or(~ends).alias("f"))
    return g.where("thresholds > 1 or (t and f)").select("case_key", "thresholds")


@query("a18_map_coverage", using("kb_units", "SELECT version_id, count(*) AS elements, count(*) FILTER (chunk_index % 3 = 0) AS mapped, count(*) FILTER (chunk_index % 3 <> 0) AS unmapped FROM kb_units GROUP BY 1"))
def a18(spark, d):
    u = C.units(spark, d).select("version_id", "chunk_index")
    mapped = u.where("chunk_index % 3 = 0").withColumn("m", F.lit(1))
    return u.join(mapped, ["version_id", "chunk_index"], "left").groupBy("version_id").agg(F.count("*").alias("elements"), F.count("m").alias("mapped"), F.count_if(F.col("m").isNull()).alias("unmapped"))


@query("a20_verification_report", using("kb_units", ", a AS (SELECT version_id, count(*) FILTER (length(content) > 400) AS blockers, count(*) FILTER (length(content) < 10) AS warnings FROM kb_units GROUP BY 1) SELECT *, greatest(0, 100 - 20 * blockers - 5 * warnings) AS score FROM a"))
def a20(spark, d):
    a = C.units(spark, d).groupBy("version_id").agg(F.count_if(F.length("content") > 400).alias("blockers"), F.count_if(F.length("content") < 10).alias("warnings"))
    return a.withColumn("score", F.greatest(F.lit(0), 100 - 20 * F.col("blockers") - 5 * F.col("warnings")))


@query("a21_extraction_checks", using("kb_units", "SELECT version_id, bool_and(length(content) > 0) AS all_text, bool_or(content LIKE '%:%') AS has_colon, bool_and(length(content) <= 2000) AS bounded, count(DISTINCT content) = count(*) AS unique_units FROM kb_units GROUP BY 1"))
def a21(spark, d):
    return C.units(spark, d).groupBy("version_id").agg(F.bool_and(F.length("content") > 0).alias("all_text"), F.bool_or(F.contains("content", F.lit(":"))).alias("has_colon"), F.bool_and(F.length("content") <= 2000).alias("bounded"), (F.countDistinct("content") == F.count("*")).alias("unique_units"))


@query("a23_refinement_coverage", using("kb_units", ", a AS (SELECT version_id, count(DISTINCT left(content, 1)) AS types, count(*) FILTER (content NOT LIKE '%.') AS missing FROM kb_units GROUP BY 1) SELECT version_id, types, missing, greatest(0, 100 - 15 * missing) AS score FROM a"))
def a23(spark, d):
    a = C.units(spark, d).groupBy("version_id").agg(F.countDistinct(F.substring("content", 1, 1)).alias("types"), F.count_if(~F.col("content").endswith(".")).alias("missing"))
    return a.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.col("missing")))


@query("a30_quality_audit", using("kb_units", ", a AS (SELECT version_id, count(*) FILTER (length(content) > 1500) AS fatal, count(*) FILTER (length(content) BETWEEN 801 AND 1500) AS critical, count(*) FILTER (length(content) BETWEEN 401 AND 800) AS major, count(*) FILTER (length(content) < 10) AS minor FROM kb_units GROUP BY 1), s AS (SELECT *, greatest(0, 100 - 6 * fatal - 16 * critical - 9 * major - 4 * minor) AS score FROM a) SELECT version_id, score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS level FROM s"))
def a30(spark, d):
    n = F.length("content")
    a = C.units(spark, d).groupBy("version_id").agg(F.count_if(n > 1500).alias("f"), F.count_if(n.between(801, 1500)).alias("c"), F.count_if(n.between(401, 800)).alias("m"), F.count_if(n < 10).alias("l"))
    s = a.withColumn("score", F.greatest(F.lit(0), 100 - 6 * F.col("f") - 16 * F.col("c") - 9 * F.col("m") - 4 * F.col("l")))
    return s.select("version_id", "score", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 40, "fair").otherwise("poor").alias("level"))


@query("d16_reindex", using("kb_units", "SELECT version_id, chunk_index, row_number() OVER (PARTITION BY version_id ORDER BY chunk_index) - 1 AS dense_index FROM kb_units"))
def d16(spark, d):
    return C.units(spark, d).select("version_id", "chunk_index", (F.row_number().over(Window.partitionBy("version_id").orderBy("chunk_index")) - 1).alias("dense_index"))


@query("d40_block_checks", using("kb_units", ", l AS (SELECT *, lag(chunk_index) OVER (PARTITION BY version_id ORDER BY chunk_index) AS p FROM kb_units) SELECT version_id, bool_and(p IS NULL OR p < chunk_index) AS ordered, bool_and(p IS NULL OR p = chunk_index - 1) AS gapless FROM l GROUP BY 1"))
def d40(spark, d):
    u = C.units(spark, d).withColumn("p", F.lag("chunk_index").over(Window.partitionBy("version_id").orderBy("chunk_index")))
    return u.groupBy("version_id").agg(F.bool_and(F.col("p").isNull() | (F.col("p") < F.col("chunk_index"))).alias("ordered"), F.bool_and(F.col("p").isNull() | (F.col("p") == F.col("chunk_index") - 1)).alias("gapless"))


@query("d28_policy_document_layer", using("kb_units", "SELECT version_id, md5(string_agg(content, chr(10) ORDER BY chunk_index)) AS layer_md5 FROM kb_units GROUP BY 1"))
def d28(spark, d):
    g = C.units(spark, d).groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m"))
    return g.select("version_id", F.md5(F.array_join("m.content", "\n")).alias("layer_md5"))


@query("d38_ref_union", using("kb_units", "SELECT md5(content) AS fingerprint, array_to_string(list_sort(list(DISTINCT version_id || ':' || chunk_index)), ',') AS refs FROM kb_units GROUP BY 1 HAVING count(*) > 1"))
def d38(spark, d):
    g = C.units(spark, d).groupBy(F.md5("content").alias("fingerprint")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "version_id", "chunk_index"))).alias("refs"), F.count("*").alias("n"))
    return g.where("n > 1").select("fingerprint", F.array_join("refs", ",").alias("refs"))


@query("k4_sheet_chunks", "SELECT p_partkey AS row_number, concat_ws('; ', 'name: ' || p_name, 'brand: ' || p_brand, 'type: ' || p_type, 'size: ' || p_size) AS content FROM part WHERE p_size > 0")
def k4(spark, d):
    pairs = F.concat_ws("; ", *(F.concat(F.lit(f"{n}: "), F.col(f"p_{n}").cast("string")) for n in ("name", "brand", "type", "size")))
    return C.table(spark, d, "part").where("p_size > 0").select(F.col("p_partkey").alias("row_number"), pairs.alias("content"))


@query("k5_policy_rows", "SELECT p_partkey, p_type AS service, CASE WHEN p_size >= 25 THEN 'at_least' ELSE 'below' END AS direction, p_size AS threshold FROM part")
def k5(spark, d):
    return C.table(spark, d, "part").select("p_partkey", F.col("p_type").alias("service"), F.when(F.col("p_size") >= 25, "at_least").otherwise("below").alias("direction"), F.col("p_size").alias("threshold"))


@query("c20_effective_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def c20(spark, d):
    text = F.concat(F.lit("effective from "), F.date_format("o_orderdate", "d/M/yyyy"))
    part = lambda k: F.regexp_extract(text, r"effective from (\d{1,2})/(\d{1,2})/(\d{4})", k)
    return C.table(spark, d, "orders").select("o_orderkey", F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")).alias("iso"))


@query("c21_next_review_due", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_months(CAST(3 * (1 + o_orderkey % 4) AS INT)), '%Y-%m-%d') AS due FROM orders")
def c21(spark, d):
    return C.table(spark, d, "orders").select("o_orderkey", F.date_format(F.add_months(F.col("o_orderdate").cast("date"), (3 * (1 + F.col("o_orderkey") % 4)).cast("int")), "yyyy-MM-dd").alias("due"))


@query("c27_merge_ranges", "WITH r AS (SELECT DISTINCT l_orderkey, l_quantity::DOUBLE AS s, l_quantity::DOUBLE + 5 AS e FROM lineitem), o AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r), i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM o) SELECT l_orderkey, min(s) AS s, max(e) AS e FROM i GROUP BY l_orderkey, isl")
def c27(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("s", "e")
    r = C.table(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("s"), (F.col("l_quantity").cast("double") + 5).alias("e")).distinct()
    o = r.withColumn("m", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    i = o.withColumn("isl", F.sum(F.when(F.col("m").isNull() | (F.col("s") > F.col("m")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("l_orderkey", "isl").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("isl")

"""Queries: understanding, scores, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import highlight
from corpusloom.operators import ranking as K
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import TOKENS
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

#: Fixture vocabulary: frequent tokens of the test documents.
RULES = {"english": ["the", "of the", "and"], "german": ["der", "und", "die"], "french": ["le", "de la", "et"], "spanish": ["el", "que", "los"]}
NORM = f"array_to_string({TOKENS}, ' ')"


def _hits(p: str) -> str:
    return f"contains(' ' || n || ' ', ' {p} ')::INT"


COUNTS = ", ".join(f"{' + '.join(_hits(p) for p in ps)} AS {k}, greatest({', '.join(f'{_hits(p)} * {len(p)}' for p in ps)}) AS l_{k}" for k, ps in RULES.items())
UNITS = f", q AS (SELECT version_id, chunk_index, {NORM} AS n FROM kb_units), m AS (SELECT *, {COUNTS} FROM q)"


def _queries(spark, d):
    return C.units(spark, d).select(F.struct("version_id", "chunk_index").alias("id"), T.normalize_phrase(F.col("content")).alias("n"))


@query("c4_seed_intent", using("kb_units", UNITS + ", u AS (" + " UNION ALL ".join(f"SELECT version_id, chunk_index, '{k}' AS intent, {k} AS matches, l_{k} AS longest, {i} AS o FROM m" for i, k in enumerate(RULES)) + ") SELECT version_id, chunk_index, intent, matches FROM (SELECT *, row_number() OVER (PARTITION BY version_id, chunk_index ORDER BY matches DESC, longest DESC, o) AS r FROM u) WHERE r = 1 AND matches > 0"))
def c4(spark, d):
    return K.seed_intent(_queries(spark, d), "id", "n", RULES).select("id.version_id", "id.chunk_index", "intent", "matches")


@query("c6_query_intent_terms", using("kb_units", UNITS + ", u AS (" + " UNION ALL ".join(f"SELECT version_id, chunk_index, '{k}' AS intent FROM m WHERE {k} > 0" for k in RULES) + ") SELECT q.version_id, q.chunk_index, coalesce(string_agg(intent, ',' ORDER BY intent), '') AS intents FROM q LEFT JOIN u ON u.version_id = q.version_id AND u.chunk_index = q.chunk_index GROUP BY ALL"))
def c6(spark, d):
    return K.intent_terms(_queries(spark, d), "id", "n", RULES).select("id.version_id", "id.chunk_index", F.array_join("intents", ",").alias("intents"))




def _synonyms(spark, d):
    n = C.table(spark, d, "nation").select(F.col("n_regionkey").alias("group_id"), F.lower("n_name").alias("term"))
    extra = spark.sql("SELECT * FROM VALUES (0, 'the'), (1, 'der'), (2, 'le'), (3, 'el'), (4, 'of the') AS v(group_id, term)")  # of known size, so that joins with the terms are broadcast
    return n.unionByName(extra.withColumn("group_id", F.col("group_id").cast(n.schema["group_id"].dataType)))


@query("c2_expand_query", using("kb_units", f", q AS (SELECT version_id, {NORM} AS n FROM kb_units), syn AS (SELECT n_regionkey AS group_id, lower(n_name) AS term FROM nation UNION ALL SELECT * FROM (VALUES (0, 'the'), (1, 'der'), (2, 'le'), (3, 'el'), (4, 'of the')))"
    ", h AS (SELECT DISTINCT version_id, group_id, term AS held FROM q JOIN syn ON contains(' ' || n || ' ', ' ' || term || ' ')) SELECT version_id, string_agg(DISTINCT term, ',' ORDER BY term) AS expansions FROM h JOIN syn USING (group_id) WHERE term <> held GROUP BY 1"))
def c2(spark, d):
    q = C.units(spark, d).select("version_id", T.normalize_phrase(F.col("content")).alias("n"))
    return K.expand_query(q, "version_id", "n", _synonyms(spark, d)).select("version_id", F.array_join("expansions", ",").alias("expansions"))


@query("j23_synonym_match", using("kb_units", f", q AS (SELECT version_id, chunk_index, {NORM} AS n FROM kb_units) SELECT version_id, chunk_index, term FROM q JOIN (VALUES ('the'), ('der'), ('of the'), ('que')) s(term) ON contains(' ' || n || ' ', ' ' || term || ' ')"))
def j23(spark, d):
    q = C.units(spark, d).select("version_id", "chunk_index", T.normalize_phrase(F.col("content")).alias("n"))
    held = F.filter(F.array(*map(F.lit, ("the", "der", "of the", "que"))), lambda t: T.phrase_in(F.col("n"), t))
    return q.select("version_id", "chunk_index", F.explode(held).alias("term"))


@query("c5_query_understanding", using("kb_units", f", q AS (SELECT version_id, chunk_index, ' ' || {NORM} || ' ' AS n FROM kb_units) SELECT version_id, chunk_index, CASE WHEN contains(n, ' idiot ') OR contains(n, ' scum ') THEN 'high' WHEN contains(n, ' the ') THEN 'medium' ELSE 'low' END AS risk, CASE WHEN contains(n, ' der ') THEN 'internal' WHEN contains(n, ' le ') THEN 'partner' ELSE 'generic' END AS scope FROM q"))
def c5(spark, d):
    q = C.units(spark, d).select("version_id", "chunk_index", T.normalize_phrase(F.col("content")).alias("n"))
    has = lambda *w: T.contains_any(F.col("n"), list(w))
    return q.select("version_id", "chunk_index", F.when(has("idiot", "scum"), "high").when(has("the"), "medium").otherwise("low").alias("risk"), F.when(has("der"), "internal").when(has("le"), "partner").otherwise("generic").alias("scope"))


SCORE = f""", u AS (SELECT version_id, chunk_index, {TOKENS} AS ts, {NORM} AS n, CASE WHEN length(content) > 300 THEN 'section' WHEN length(content) > 80 THEN 'rule' WHEN length(content) > 40 THEN 'procedure' ELSE 'document' END AS unit, version_id % 3 = 0 AS approved, version_id % 5 = 0 AS risky FROM kb_units),
s AS (SELECT version_id, chunk_index, unit, CASE unit WHEN 'rule' THEN 20.0::DOUBLE WHEN 'procedure' THEN 16.0 WHEN 'section' THEN 8.0 ELSE -60.0 END AS score_unit, CASE WHEN contains(' ' || n || ' ', ' of the ') THEN 12.0::DOUBLE ELSE 0 END AS score_phrase, len(list_intersect(list_distinct(ts), ['of', 'the'])) * 1.5::DOUBLE AS score_tokens, CASE WHEN approved THEN 4.0::DOUBLE ELSE 0 END AS score_review, CASE WHEN risky THEN -5.0::DOUBLE ELSE 0 END AS score_risk FROM u),
b AS (SELECT *, score_unit + score_phrase + score_tokens + score_review + score_risk AS business_score FROM s)"""


def _scored(spark, d, config=None):
    n = F.length("content")
    unit = F.when(n > 300, "section").when(n > 80, "rule").when(n > 40, "procedure").otherwise("document")
    u = C.units(spark, d).withColumns({"ts": T.tokens(F.col("content")), "n": T.normalize_phrase(F.col("content")), "unit": unit, "q": F.lit("of the"), "qts": F.array(F.lit("of"), F.lit("the"))})
    return K.business_score(u, "qts", "ts", "q", "n", "unit", F.col("version_id") % 3 == 0, F.col("version_id") % 5 == 0, config)


@query("m11_business_score", using("kb_units", SCORE + " SELECT * EXCLUDE (unit) FROM b"))
def m11(spark, d):
    return _scored(spark, d).select("version_id", "chunk_index", "score_unit", "score_phrase", "score_tokens", "score_review", "score_risk", "business_score")


@query("x4_ranking_config", using("kb_units", SCORE + " SELECT version_id, chunk_index, business_score - score_unit + CASE unit WHEN 'rule' THEN 1.0 ELSE score_unit END AS business_score FROM b"))
def x4(spark, d):
    return _scored(spark, d, {"unit_scores": {"rule": 1.0}}).select("version_id", "chunk_index", "business_score")


@query("m12_relevance_blend", using("kb_units", SCORE + ", r AS (SELECT *, CASE WHEN chunk_index % 2 = 0 THEN (chunk_index % 10) / 10.0::DOUBLE END AS rel, CASE unit WHEN 'rule' THEN 0.75::DOUBLE WHEN 'procedure' THEN 0.55 ELSE 0.45 END AS w FROM b) SELECT version_id, chunk_index, round(CASE WHEN rel IS NULL THEN business_score ELSE business_score * w + rel * 100 * (1 - w) END, 6) AS final_score FROM r"))
def m12(spark, d):
    rel = F.when(F.col("chunk_index") % 2 == 0, (F.col("chunk_index") % 10) / 10)
    return _scored(spark, d).select("version_id", "chunk_index", F.round(K.blend(F.col("business_score"), rel, F.col("unit")), 6).alias("final_score"))


@query("m17_rerank_gate", using("kb_units", SCORE + ", g AS (SELECT version_id, count(*) AS n, max(business_score) AS top, max(business_score) - coalesce(list_sort(list(business_score), 'DESC')[2], 0) AS gap FROM b GROUP BY 1) SELECT version_id, CASE WHEN n < 2 THEN 'too_few' WHEN top <= 0 THEN 'no_positive_score' WHEN gap >= 20 THEN 'clear_winner' ELSE 'use' END AS gate FROM g"))
def m17(spark, d):
    g = _scored(spark, d).groupBy("version_id").agg(F.count("*").alias("n"), F.max("business_score").alias("top"), F.sort_array(F.collect_list("business_score"), asc=False).alias("s"))
    return g.select("version_id", K.rerank_gate(F.col("n"), F.col("top") - F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)), F.col("top")).alias("gate"))


@query("w3_policy_exists", using("kb_units", SCORE + " SELECT version_id, chunk_index, bool_or(unit = 'rule') OVER (PARTITION BY version_id) AS policy_exists FROM b"))
def w3(spark, d):
    from pyspark.sql import Window

    return _scored(spark, d).select("version_id", "chunk_index", F.bool_or(F.col("unit") == "rule").over(Window.partitionBy("version_id")).alias("policy_exists"))


@query("m6_keyword_field_score", f"WITH t AS (SELECT p_partkey, {TOKENS.replace('content', 'p_name')} AS ts, list_distinct([lower(p_type), lower(p_brand)]) AS tags, p_size FROM part), q AS (SELECT *, len(list_intersect(list_distinct(ts), ['green', 'blue', 'steel', 'small'])) AS k FROM t) SELECT p_partkey, round(least(1.0, (CASE WHEN k > 0 THEN 6.0 ELSE 0 END + CASE WHEN list_has_any(tags, ['green', 'blue', 'steel', 'small']) THEN 5.0 ELSE 0 END + 1.5 * k + p_size / 1500) / 12)::DOUBLE, 6) AS score FROM q")
def m6(spark, d):
    q = F.array(*map(F.lit, ("green", "blue", "steel", "small")))
    return C.table(spark, d, "part").select("p_partkey", F.round(K.keyword_field_score(F.col("p_name"), F.array(F.lower("p_type"), F.lower("p_brand")), q, F.col("p_size")), 6).alias("score"))


@query("m15_evidence_confidence", "SELECT label, round(least(0.94::DOUBLE, 0.2::DOUBLE + least(count(*) * 0.08::DOUBLE, 0.32::DOUBLE) + least(max(embedding[1])::DOUBLE * 0.4, 0.4::DOUBLE) + CASE WHEN bool_or(vec_id < 20) THEN 0.1::DOUBLE ELSE 0 END), 5) AS confidence FROM embeddings GROUP BY 1")
def m15(spark, d):
    g = C.vectors(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.max(F.col("v")[0]).alias("best"), F.bool_or(F.col("vec_id") < 20).alias("a"))
    return g.select("label", F.round(K.evidence_confidence(F.col("n"), F.col("best"), F.col("a")), 5).alias("confidence"))


@query("c14_classify_document", "SELECT doc_id, CASE WHEN lower(left(text, 5000)) LIKE '%license%' THEN 'license' WHEN left(text, 5000) LIKE '%|%' THEN 'table' WHEN regexp_matches(left(text, 5000), '[%$&#*]{3}') THEN 'noise' WHEN length(text) < 200 THEN 'note' ELSE 'prose' END AS kind FROM documents")
def c14(spark, d):
    head = F.substring("text", 1, 5000)
    return C.table(spark, d, "documents").select("doc_id", F.when(F.contains(F.lower(head), F.lit("license")), "license").when(F.contains(head, F.lit("|")), "table").when(head.rlike(r"[%$&#*]{3}"), "noise").when(F.length("text") < 200, "note").otherwise("prose").alias("kind"))


@query("c16_search_label", using("kb_units", f"SELECT version_id, chunk_index, CASE WHEN length(content) < 8 OR regexp_matches(content, '^[^\\p{{L}}]*$') THEN 'Unit ' || chunk_index ELSE array_to_string(list_slice({TOKENS}, 1, 6), ' ') END AS label FROM kb_units"))
def c16(spark, d):
    bad = (F.length("content") < 8) | F.col("content").rlike(r"^[^\p{L}]*$")
    return C.units(spark, d).select("version_id", "chunk_index", F.when(bad, F.concat(F.lit("Unit "), F.col("chunk_index").cast("string"))).otherwise(F.array_join(F.slice(T.tokens(F.col("content")), 1, 6), " ")).alias("label"))


@query("c17_infer_tags", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN lower(p_name) LIKE '%green%' THEN 'green' END, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'steel' END, CASE WHEN p_size > 25 THEN 'large' END], lambda x: x IS NOT NULL), ',') AS tags FROM part")
def c17(spark, d):
    tags = F.array_compact(F.array(F.when(F.contains(F.lower("p_name"), F.lit("green")), F.lit("green")), F.when(F.contains(F.lower("p_type"), F.lit("steel")), F.lit("steel")), F.when(F.col("p_size") > 25, F.lit("large"))))
    return C.table(spark, d, "part").select("p_partkey", F.array_join(tags, ",").alias("tags"))


@query("c18_infer_risk", using("kb_units", "SELECT version_id, chunk_index, CASE WHEN regexp_matches(lower(content), 'idiot|scum|moron') THEN 'high' WHEN regexp_matches(lower(content), 'stupid|trash|loser') THEN 'medium' ELSE 'low' END AS risk FROM kb_units"))
def c18(spark, d):
    low = F.lower("content")
    return C.units(spark, d).select("version_id", "chunk_index", F.when(low.rlike("idiot|scum|moron"), "high").when(low.rlike("stupid|trash|loser"), "medium").otherwise("low").alias("risk"))


@query("c19_threshold", "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS threshold, CASE WHEN value >= 50 THEN 'at_least' ELSE 'below' END AS direction FROM events")
def c19(spark, d):
    return C.table(spark, d, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("threshold"), F.when(F.col("value") >= 50, "at_least").otherwise("below").alias("direction"))


@query("c9_exact_phrases", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all('\"' || replace(text, '. ', '.\" \"') || '\"', '\"([^\"]+)\"', 1))), '|') AS phrases FROM benchmark")
def c9(spark, d):
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit(". "), F.lit('." "')), F.lit('"'))
    return C.table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(quoted, F.lit('"([^"]+)"'), 1))), "|").alias("phrases"))


@query("c10_structured_values", "SELECT event_id, trim(regexp_extract(x, ':(.*)$', 1)) AS value FROM (SELECT event_id, unnest(string_split(replace(replace(props, '{', ''), '}', ''), ';')) AS x FROM events) WHERE x LIKE '%:%'")
def c10(spark, d):
    parts = F.filter(F.split(F.regexp_replace("props", "[{}]", ""), ";"), lambda x: F.contains(x, F.lit(":")))
    return C.table(spark, d, "events").select("event_id", F.explode(F.transform(parts, lambda x: F.trim(F.regexp_extract(x, ":(.*)$", 1)))).alias("value"))


@query("c26_highlight_range", "SELECT doc_id, item_id, strpos(d.text, b.text) AS start_at, length(b.text) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def c26(spark, d):
    """Benchmark passages that occur literally: an equi-join on a run of inner words, then the exact test."""
    b = C.table(spark, d, "benchmark").select("item_id", F.col("text").alias("b"), T.tokens(F.col("text")).alias("ts"))
    g = max(1, min(6, (b.agg(F.min(F.size("ts"))).first()[0] or 3) - 2))
    keys = b.where(F.size("ts") > 2).select("item_id", F.xxhash64(F.slice("ts", 2, g)).alias("k"))
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    ts = docs.select("doc_id", T.tokens(F.col("text")).alias("ts")).where(F.size("ts") >= g)
    runs = ts.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ts") - g + 1), lambda p: F.xxhash64(F.slice("ts", p, F.lit(g)))))).alias("k"))
    hit = runs.join(keys, "k").select("doc_id", "item_id").distinct()
    return hit.join(docs, "doc_id").join(b.select("item_id", "b"), "item_id").where(F.contains("text", F.col("b"))).select("doc_id", "item_id", F.expr("instr(text, b)").cast("long").alias("start_at"), F.length("b").cast("long").alias("n"))


@query("c26_highlight_alignment")
def c26_alignment(spark, d):
    """The best place of every benchmark passage in every document that has one: exact, normalised or within a tenth of its words."""
    return highlight.highlights(C.table(spark, d, "documents"), C.table(spark, d, "benchmark"))


@query("c31_answer_pruning", using("kb_lines", ", s AS (SELECT version_id, chunk_index, list_filter(string_split(raw, '. '), lambda x: NOT contains(lower(x), 'the')) AS s FROM kb_lines) SELECT version_id, chunk_index, array_to_string(s, '. ') AS pruned FROM s"))
def c31(spark, d):
    lines = C.table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "raw"))
    return lines.select("version_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(F.filter(F.split("raw", r"\. "), lambda x: ~F.contains(F.lower(x), F.lit("the"))), ". ").alias("pruned"))


@query("c32_metadata_signals", using("kb_units", "SELECT version_id, bool_or(contains(lower(content), 'licensed')) AS license_signal, bool_or(contains(content, '@')) AS contact_signal FROM kb_units GROUP BY 1"))
def c32(spark, d):
    return C.units(spark, d).groupBy("version_id").agg(F.bool_or(F.contains(F.lower("content"), F.lit("licensed"))).alias("license_signal"), F.bool_or(F.contains("content", F.lit("@"))).alias("contact_signal"))


@query("c30_phone_lookup_rewrite", "SELECT c_custkey, unnest([c_name, 'phone ' || c_name, 'contact ' || c_name]) AS rewritten FROM customer")
def c30(spark, d):
    q = F.regexp_replace(F.concat(F.lit("hotline number "), F.col("c_name")), "^(hotline|phone) number ", "")
    return C.table(spark, d, "customer").select("c_custkey", F.explode(F.array(q, F.concat(F.lit("phone "), q), F.concat(F.lit("contact "), q))).alias("rewritten"))


@query("d49_context_limit_by_intent", using("kb_units", UNITS + " SELECT version_id, chunk_index, CASE WHEN english > 0 THEN 8 WHEN german > 0 THEN 5 ELSE 3 END AS k FROM m"))
def d49(spark, d):
    has = lambda k: T.contains_any(F.col("n"), RULES[k])
    return _queries(spark, d).select("id.version_id", "id.chunk_index", F.when(has("english"), 8).when(has("german"), 5).otherwise(3).alias("k"))


@query("d51_visible_step_codes", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '\\d+'))), ',') AS codes FROM pages")
def d51(spark, d):
    return C.table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("url", F.lit(r"\d+"), 0))), ",").alias("codes"))


@query("o8_facet_priority", using("kb_status", "SELECT version_id, CASE risk_level WHEN 'high' THEN 4 WHEN 'low' THEN 1 ELSE 0 END + CASE status WHEN 'published' THEN 5 WHEN 'archived' THEN 1 ELSE -2 END AS priority FROM kb_status"))
def o8(spark, d):
    v = C.with_status(C.versions(spark, d))
    p = K.lookup({"high": 4, "low": 1}, F.col("risk_level"), 0) + K.lookup({"published": 5, "archived": 1}, F.col("status"), -2)
    return v.select("version_id", p.cast("int").alias("priority"))

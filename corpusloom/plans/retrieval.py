"""Queries: normalisers, text functions, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.operators import ordering, retrieval
from corpusloom.plans.registry import query
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C
from corpusloom.sources.scratch import written

#: DuckDB twins of the normalisers, for a column x.
STRIP = "regexp_replace(replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D'), '\\p{{M}}+', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


TOKENS = "regexp_extract_all(" + strip("lower(content)") + ", '[\\p{L}\\p{N}]+')"
NORMALISERS = {
    "n1_strip_accents": (T.strip_accents, strip("content")),
    "n3_normalize_phrase": (T.normalize_phrase, f"array_to_string({TOKENS}, ' ')"),
    "n4_normalize_text": (T.normalize_text, f"trim(regexp_replace(lower({strip('content')}), '\\s+', ' ', 'g'))"),
    "n5_normalize_key": (T.normalize_key, f"regexp_replace(regexp_replace(trim(regexp_replace(lower({strip('content')}), '\\s+', ' ', 'g')), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g')"),
    "n6_normalize_match": (T.normalize_match, f"trim(regexp_replace(lower({strip('content')}), '[^a-z0-9]+', ' ', 'g'))"),
    "n7_label_text": (lambda c: T.normalize_match(c, keep="?"), f"trim(regexp_replace(lower({strip('content')}), '[^a-z0-9?]+', ' ', 'g'))"),
    "n8_portal_normalize": (T.portal_normalize, "trim(regexp_replace(lower(content), '[^\\p{L}\\p{N}]+', ' ', 'g'))"),
}
for _name, (_fn, _sql) in NORMALISERS.items():
    query(_name, using("kb_units", f"SELECT version_id, chunk_index, {_sql} AS value FROM kb_units"))(lambda spark, d, fn=_fn: C.units(spark, d).select("version_id", "chunk_index", fn(F.col("content")).alias("value")))


@query("n2_tokenize", using("kb_units", f"SELECT version_id, chunk_index, array_to_string({TOKENS}, '|') AS tokens, len({TOKENS}) AS n_tokens FROM kb_units"))
def n2(spark, d):
    t = T.tokens(F.col("content"))
    return C.units(spark, d).select("version_id", "chunk_index", F.array_join(t, "|").alias("tokens"), F.size(t).cast("long").alias("n_tokens"))


@query("n9_normalize_whitespace", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS value FROM documents")
def n9(spark, d):
    return C.table(spark, d, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("value"))


@query("c1_phrase_in_query", using("kb_units", f"SELECT version_id, chunk_index FROM kb_units WHERE contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' of the ')"))
def c1(spark, d):
    return C.units(spark, d).where(T.phrase_in(T.normalize_phrase(F.col("content")), F.lit("of the"))).select("version_id", "chunk_index")


@query("c3_or_query_terms", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({TOKENS.replace('content', 'text')}, lambda t: length(t) >= 2))), ' ') AS terms FROM benchmark")
def c3(spark, d):
    return C.table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.or_terms(F.col("text"))), " ").alias("terms"))


@query("c11_split_sentences", "SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) AS n_sentences FROM documents")
def c11(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("c12_detect_heading", using("kb_units", ", h AS (SELECT version_id, chunk_index, content || ':' AS h FROM kb_units) SELECT version_id, chunk_index FROM h WHERE length(h) <= 120 AND NOT regexp_matches(h, '^\\d+[.)]\\s') AND (regexp_matches(h, '^#{1,6}\\s+\\S') OR (regexp_matches(h, '^[\\p{Lu}\\p{N} _/-]{3,}:?$') AND regexp_matches(h, '\\p{Lu}')) OR (h LIKE '%:' AND len(regexp_split_to_array(h, '\\s+')) <= 8))"))
def c12(spark, d):
    return C.units(spark, d).where(T.is_heading(F.concat("content", F.lit(":")))).select("version_id", "chunk_index")


@query("c13_regex_predicates", using("kb_units", "SELECT version_id, chunk_index, regexp_matches(lower(content), '(^|[^\\p{L}])(if|when|unless|quand|wenn)($|[^\\p{L}])') AS has_condition, regexp_matches(lower(content), '(^|[^\\p{L}])(must|should|do|faire|muss)($|[^\\p{L}])') AS has_action, regexp_matches(lower(content), '^(note|nota|hinweis|remarque)($|[^\\p{L}])') AS is_note FROM kb_units"))
def c13(spark, d):
    low = F.lower("content")
    return C.units(spark, d).select("version_id", "chunk_index", low.rlike(r"(^|[^\p{L}])(if|when|unless|quand|wenn)($|[^\p{L}])").alias("has_condition"), low.rlike(r"(^|[^\p{L}])(must|should|do|faire|muss)($|[^\p{L}])").alias("has_action"), low.rlike(r"^(note|nota|hinweis|remarque)($|[^\p{L}])").alias("is_note"))


@query("c23_urls", "SELECT page_id, u AS url, position AS place FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS u, unnest(range(0, len(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)))) AS position FROM pages)")
def c23(spark, d):
    return C.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("place", "url"))


BM25_SQL = """, post AS (SELECT doc_id, term, count(*) AS tf FROM kb_tokens GROUP BY ALL), len AS (SELECT doc_id, count(*) AS length FROM kb_tokens GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, term FROM kb_query_tokens WHERE length(term) >= 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(length) FROM len) * 1.0 / (SELECT count(*) FROM documents) AS mean),
s AS (SELECT query_id, post.doc_id AS chunk_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM asked JOIN post USING (term) JOIN df USING (term) JOIN len ON len.doc_id = post.doc_id CROSS JOIN n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM s)"""
M8_TOP = 30


@query("j3_lexical_bm25", using("kb_tokens kb_query_tokens", BM25_SQL + " SELECT query_id, chunk_id, round(s, 6) AS lexical_score FROM s"))
def j3(spark, d):
    """Every document that shares a term with a benchmark passage."""
    q, c = _benchmark_queries(spark, d)
    return retrieval.bm25(q, c, "query_id", "text", "chunk_id", "text").select("query_id", "chunk_id", F.round("lexical_score", 6).alias("lexical_score"))


@query("m8_lexical_rank", using("kb_tokens kb_query_tokens", BM25_SQL + f" SELECT query_id, chunk_id, round(s, 6) AS lexical_score, rank AS place FROM r WHERE rank <= {M8_TOP}"))
def m8(spark, d):
    """The first thirty places by lexical score of each benchmark passage."""
    q, c = _benchmark_queries(spark, d)
    return retrieval.bm25_top(q, c, "query_id", "text", "chunk_id", "text", M8_TOP).select("query_id", "chunk_id", F.round("lexical_score", 6).alias("lexical_score"), F.col("rank").alias("place"))


KNN_SQL = """, s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS vector_score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, chunk_id) AS rank FROM s)"""


@query("j4_exact_knn", "WITH " + KNN_SQL[1:] + " SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, rank FROM r WHERE rank <= 30")
def j4(spark, d):
    v = C.vectors(spark, d)
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return retrieval.knn(q, v.select(F.col("vec_id").alias("chunk_id"), "v"), "query_id", "chunk_id", 30).select("query_id", "chunk_id", F.round("vector_score", 6).alias("vector_score"), "rank")


@query("j4_exact_knn_all", "WITH " + KNN_SQL[1:] + " SELECT query_id, chunk_id, round(vector_score, 6) AS vector_score, rank FROM r WHERE rank <= 30")
def j4_all(spark, d):
    return j4(spark, d)


@query("m1_cosine_within_label", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def m1(spark, d):
    v = C.vectors(spark, d)
    a, b = v.select(F.col("vec_id").alias("a"), F.col("v").alias("va")), v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "a").select("a", "b", F.round(V.cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


HASHED = """, h AS (SELECT {k} AS id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS slot, CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS x FROM {t}),
w AS (SELECT id, slot, sum(x) AS x FROM h GROUP BY ALL), z AS (SELECT id, sqrt(sum(x * x)) AS n FROM w GROUP BY ALL)"""


@query("m2_hashed_embedding", using("kb_tokens", HASHED.format(k="doc_id", t="kb_tokens") + " SELECT w.id AS doc_id, slot, round(x / n, 6) AS x FROM w JOIN z USING (id) WHERE x <> 0"))
def m2(spark, d):
    v = retrieval.hashed_vectors(C.table(spark, d, "documents"), "doc_id", "text")
    return v.select("doc_id", F.posexplode("v").alias("slot", "x")).where("x <> 0").select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


@query("m3_reciprocal_rank_fusion", "WITH " + KNN_SQL[1:] + """, near AS (SELECT query_id, chunk_id, rank FROM r WHERE rank <= 30), late AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS rank FROM near)
SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS rrf FROM (SELECT * FROM near UNION ALL SELECT * FROM late) GROUP BY ALL""")
def m3(spark, d):
    near = j4(spark, d).select("query_id", "chunk_id", "rank")
    late = ordering.top_k(near.drop("rank"), ["query_id"], 30, F.col("chunk_id").desc())
    return retrieval.reciprocal_rank_fusion([near, late], "query_id", "chunk_id").select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"))


@query("m4_overlap_jaccard_containment", f"""WITH t AS (SELECT item_id, list_distinct({TOKENS.replace('content', 'text')}) AS t FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / greatest(len(a.t), len(b.t)), 6) AS overlap, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard, round(len(list_intersect(a.t, b.t)) / least(len(a.t), len(b.t)), 6) AS containment FROM t a JOIN t b ON b.item_id = a.item_id + 1""")
def m4(spark, d):
    t = C.table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("t"))
    p = t.select(F.col("item_id").alias("a"), F.col("t").alias("x")).join(t.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("t").alias("y")), "a")
    return p.select("a", "b", *(F.round(f(F.col("x"), F.col("y")), 6).alias(n) for n, f in (("overlap", T.overlap), ("jaccard", T.jaccard), ("containment", T.containment))))


BOX = "[l_quantity::DOUBLE, l_discount::DOUBLE * 100, l_quantity::DOUBLE + 10, l_discount::DOUBLE * 100 + 1 + l_tax::DOUBLE * 100]"


@query("m5_box_geometry", f"""WITH b AS (SELECT l_orderkey, l_linenumber, {BOX} AS b FROM lineitem), p AS (SELECT x.l_orderkey, x.l_linenumber, x.b AS p, y.b AS q FROM b x JOIN b y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1),
i AS (SELECT *, greatest(least(p[3], q[3]) - greatest(p[1], q[1]), 0) * greatest(least(p[4], q[4]) - greatest(p[2], q[2]), 0) AS i, (p[3] - p[1]) * (p[4] - p[2]) + (q[3] - q[1]) * (q[4] - q[2]) AS s FROM p)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s - i > 0 THEN i / (s - i) ELSE 0 END, 6) AS iou, round(sqrt(power((p[1] + p[3] - q[1] - q[3]) / 2, 2) + power((p[2] + p[4] - q[2] - q[4]) / 2, 2)), 6) AS distance FROM i""")
def m5(spark, d):
    q, disc, tax = (F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax"))
    b = C.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(q, disc * 100, q + 10, disc * 100 + 1 + tax * 100).alias("p"))
    nxt = b.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("p").alias("q"))
    return b.join(nxt, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(V.iou(F.col("p"), F.col("q")), 6).alias("iou"), F.round(V.center_distance(F.col("p"), F.col("q")), 6).alias("distance"))


def _benchmark_queries(spark, d):
    return C.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), C.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


HYBRID = """, post AS (SELECT doc_id, term, count(*) AS tf FROM kb_tokens GROUP BY ALL), len AS (SELECT doc_id, count(*) AS length FROM kb_tokens GROUP BY ALL),
asked AS (SELECT DISTINCT query_id, term FROM kb_query_tokens WHERE length(term) >= 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL),
n AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(length) FROM len) * 1.0 / (SELECT count(*) FROM documents) AS mean),
lex AS (SELECT query_id, post.doc_id AS chunk_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS lexical_score FROM asked JOIN post USING (term) JOIN df USING (term) JOIN len ON len.doc_id = post.doc_id CROSS JOIN n GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical_score, 9) DESC, chunk_id) AS rank FROM lex) WHERE rank <= 30),
both_ AS (SELECT 0 AS side, doc_id AS id, term FROM kb_tokens UNION ALL SELECT 1, query_id, term FROM kb_query_tokens),
h AS (SELECT side, id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS slot, CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS x FROM both_),
w AS (SELECT side, id, slot, sum(x) AS x FROM h GROUP BY ALL), z AS (SELECT side, id, sqrt(sum(x * x)) AS n FROM w GROUP BY ALL), u AS (SELECT w.side, w.id, slot, CASE WHEN n > 0 THEN x / n ELSE 0 END AS x FROM w JOIN z ON z.side = w.side AND z.id = w.id),
cosn AS (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.x * c.x) AS vector_score FROM u q JOIN u c ON q.side = 1 AND c.side = 0 AND q.slot = c.slot GROUP BY ALL),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score, 9) DESC, chunk_id) AS rank FROM cosn) WHERE rank <= 30),
m AS (SELECT coalesce(kw.query_id, vec.query_id) AS query_id, coalesce(kw.chunk_id, vec.chunk_id) AS chunk_id, coalesce(lexical_score, 0) AS lexical_score, coalesce(vector_score, 0) AS vector_score, kw.rank AS keyword_rank, vec.rank AS vector_rank,
  CASE WHEN kw.rank IS NOT NULL AND vec.rank IS NOT NULL THEN 1.0 / (60 + kw.rank) + 1.0 / (60 + vec.rank) ELSE 0 END AS fusion_score FROM kw FULL OUTER JOIN vec ON kw.query_id = vec.query_id AND kw.chunk_id = vec.chunk_id)"""


@query("j5_keyword_vector_merge", using("kb_tokens kb_query_tokens", HYBRID + " SELECT query_id, chunk_id, round(lexical_score, 5) AS lexical_score, round(vector_score, 5) AS vector_score, keyword_rank, vector_rank, round(fusion_score, 6) AS fusion_score FROM m"))
def j5(spark, d):
    q, c = _benchmark_queries(spark, d)
    lexical = retrieval.bm25_top(q, c, "query_id", "text", "chunk_id", "text", 30)
    near = retrieval.knn(retrieval.hashed_vectors(q, "query_id", "text"), written(retrieval.hashed_vectors(c, "chunk_id", "text"), "vectors"), "query_id", "chunk_id", 30)
    m = retrieval.merge_sources(lexical, near, "query_id", "chunk_id")
    return m.select("query_id", "chunk_id", F.round("lexical_score", 5).alias("lexical_score"), F.round("vector_score", 5).alias("vector_score"), "keyword_rank", "vector_rank", F.round("fusion_score", 6).alias("fusion_score"))


@query("k24_hybrid_retrieve", using("kb_tokens kb_query_tokens", HYBRID + """, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fusion_score, 9) DESC, round(lexical_score, 9) DESC, round(vector_score, 9) DESC, chunk_id) AS rank FROM m WHERE lexical_score > 0 OR vector_score >= 0.12)
SELECT query_id, chunk_id, round(lexical_score, 5) AS lexical_score, round(vector_score, 5) AS vector_score, round(fusion_score, 6) AS fusion_score, rank FROM b WHERE rank <= 10"""))
def k24(spark, d):
    q, c = _benchmark_queries(spark, d)
    return retrieval.hybrid_retrieve(q, c).select("query_id", "chunk_id", F.round("lexical_score", 5).alias("lexical_score"), F.round("vector_score", 5).alias("vector_score"), F.round("fusion_score", 6).alias("fusion_score"), "rank")


@query("f13_relax_if_empty", "WITH " + KNN_SQL[1:] + ", strict AS (SELECT query_id, chunk_id FROM r WHERE rank <= 10 AND vector_score >= 0.45 AND chunk_id <> query_id), loose AS (SELECT query_id, chunk_id FROM r WHERE rank <= 3) SELECT *, FALSE AS relaxed FROM strict UNION ALL SELECT *, TRUE FROM loose WHERE query_id NOT IN (SELECT query_id FROM strict)")
def f13(spark, d):
    r = j4(spark, d)
    return retrieval.relax_if_empty(r.where("rank <= 10 and vector_score >= 0.45 and chunk_id <> query_id").select("query_id", "chunk_id"), r.where("rank <= 3").select("query_id", "chunk_id"), "query_id")


@query("f9_reliable", "WITH " + KNN_SQL[1:] + " SELECT query_id, chunk_id FROM r WHERE rank <= 30 AND vector_score >= 0.4")
def f9(spark, d):
    return retrieval.reliable(j4(spark, d).withColumn("lexical_score", F.lit(0.0)), 0.4).select("query_id", "chunk_id")


@query("j22_backfill", "WITH " + KNN_SQL[1:] + ", p AS (SELECT query_id, chunk_id, rank AS place FROM r WHERE rank <= 30 AND chunk_id % 2 = 0), t AS (SELECT query_id, chunk_id, rank AS place FROM r WHERE rank <= 30 AND chunk_id % 3 = 0), e AS (SELECT *, 0 AS source FROM p UNION ALL SELECT *, 1 FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = t.query_id AND p.chunk_id = t.chunk_id)) SELECT query_id, chunk_id, place, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source, place, chunk_id) AS rank FROM e) WHERE rank <= 18")
def j22(spark, d):
    r = j4(spark, d).select("query_id", "chunk_id", F.col("rank").alias("place"))
    return retrieval.backfill(r.where("chunk_id % 2 = 0"), r.where("chunk_id % 3 = 0"), "query_id", "chunk_id", 18, F.col("place"))


@query("w1_source_rank", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 9) DESC, vec_id) AS source_rank FROM embeddings")
def w1(spark, d):
    v = C.vectors(spark, d).select("vec_id", "label", F.round(F.col("v")[0], 9).alias("score"), F.lit(0).alias("q"))
    return retrieval.source_rank(v, "q", "label", "score", "vec_id").select("vec_id", "label", "source_rank")

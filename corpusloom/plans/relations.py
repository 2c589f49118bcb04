"""Queries: relations, duplicates, conflicts, graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import graphs as GR
from corpusloom.operators import ordering, overlaps
from corpusloom.operators import relations as R
from corpusloom.operators import similarity, spatial
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval import KNN_SQL, TOKENS, j4
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

GRAPH = ("graph_id",)
LINKS = """WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a FROM pages), kb_links AS (SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, lower(regexp_extract(a, '>([^<]*)<', 1)) AS target FROM raw)"""


def _links(spark, d):
    a = C.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">[^<]*</a>'), 0)).alias("a"))
    return a.select("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), F.lower(F.regexp_extract("a", ">([^<]*)<", 1)).alias("target"))


KINDS = "CASE WHEN length(target) % 3 = 0 THEN 'depends_on' WHEN length(target) % 3 = 1 THEN 'related' ELSE 'references' END"


@query("c24_relation_candidates", LINKS + f" SELECT page_id, target, {KINDS} AS kind, CASE WHEN target LIKE '%.' THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM kb_links")
def c24(spark, d):
    kind = F.when(F.length("target") % 3 == 0, "depends_on").when(F.length("target") % 3 == 1, "related").otherwise("references")
    return _links(spark, d).select("page_id", "target", kind.alias("kind"), F.when(F.col("target").endswith("."), 0.5).otherwise(0.8).alias("confidence"))


@query("c25_consolidate_relations", LINKS + f", c AS (SELECT target, {KINDS} AS kind, CASE WHEN target LIKE '%.' THEN 0.5 ELSE 0.8 END::DOUBLE AS confidence FROM kb_links) SELECT target, arg_min(kind, CASE kind WHEN 'references' THEN 1 WHEN 'related' THEN 2 ELSE 3 END) AS kind, max(confidence) AS confidence, count(*) AS candidates FROM c GROUP BY 1")
def c25(spark, d):
    return R.consolidate(c24(spark, d), ["target"], "kind", "confidence", ["references", "related", "depends_on"])


@query("j7_exact_relation_target", "WITH t AS (SELECT lower(c_name) AS title, c_custkey FROM customer), u AS (SELECT title, any_value(c_custkey) AS target_id FROM t GROUP BY 1 HAVING count(*) = 1), e AS (SELECT o_orderkey AS source_id, lower(c_name) AS title FROM orders JOIN customer ON o_custkey = c_custkey) SELECT source_id, e.title, target_id FROM e JOIN u ON u.title = e.title WHERE target_id <> source_id")
def j7(spark, d):
    titles = C.table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("title"))
    named = C.table(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_custkey").alias("c_custkey")).join(titles, "c_custkey").select("source_id", "title")
    return R.exact_targets(named, titles, "title", "c_custkey", "source_id").select("source_id", "title", "target_id")


EDGES = "edges AS (SELECT vec_id AS source_id, (vec_id * 7 + 3) // 10 AS target_id, CASE WHEN vec_id % 3 = 0 THEN 'unresolved' ELSE 'approved' END AS status FROM embeddings)"


def _edges(spark, d):
    return C.vectors(spark, d).select(F.col("vec_id").alias("source_id"), F.floor((F.col("vec_id") * 7 + 3) / 10).alias("target_id"), F.when(F.col("vec_id") % 3 == 0, "unresolved").otherwise("approved").alias("status"))


@query("j8_relation_expansion", "WITH " + KNN_SQL[1:] + f", h AS (SELECT query_id, chunk_id FROM r WHERE rank <= 8), {EDGES}, x AS (SELECT DISTINCT query_id, target_id AS chunk_id FROM h JOIN edges ON source_id = chunk_id AND status = 'approved'), y AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.query_id = x.query_id AND h.chunk_id = x.chunk_id)) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM y) WHERE rank <= 4")
def j8(spark, d):
    return R.expand(j4(spark, d).where("rank <= 8").select("query_id", "chunk_id"), _edges(spark, d), "query_id", "chunk_id", 4)


@query("j11_chunks_by_id", "WITH " + KNN_SQL[1:] + " SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT chunk_id FROM r WHERE rank <= 3) AND vec_id NOT IN (SELECT query_id FROM r)")
def j11(spark, d):
    r = j4(spark, d)
    v = C.vectors(spark, d).select("vec_id", "label")
    return v.join(r.where("rank <= 3").select(F.col("chunk_id").alias("vec_id")), "vec_id", "left_semi").join(r.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")


@query("j6_hydrate_hits", "WITH " + KNN_SQL[1:] + " SELECT query_id, chunk_id, rank, label FROM r JOIN embeddings ON vec_id = chunk_id WHERE rank <= 10 AND label <> 0")
def j6(spark, d):
    v = C.vectors(spark, d).where("label <> 0").select(F.col("vec_id").alias("chunk_id"), "label")
    return j4(spark, d).where("rank <= 10").join(v, "chunk_id").select("query_id", "chunk_id", "rank", "label")


@query("j21_unresolved_relations", "WITH " + KNN_SQL[1:] + f", {EDGES} SELECT source_id, target_id FROM edges WHERE status = 'unresolved' AND source_id IN (SELECT chunk_id FROM r WHERE rank <= 8) ORDER BY source_id DESC LIMIT 20")
def j21(spark, d):
    hits = j4(spark, d).where("rank <= 8").select(F.col("chunk_id").alias("source_id"))
    return _edges(spark, d).where("status = 'unresolved'").join(hits, "source_id", "left_semi").orderBy(F.col("source_id").desc()).limit(20).select("source_id", "target_id")


@query("j10_parent_context", using("kb_units", "SELECT DISTINCT u.version_id, u.chunk_index, u.content FROM kb_units u WHERE u.chunk_index = 0 AND u.version_id IN (SELECT version_id FROM kb_units WHERE chunk_index > 0 AND content LIKE '%licensed%' OR length(content) > 300)"))
def j10(spark, d):
    u = C.units(spark, d)
    hits = u.where("chunk_index > 0 and content like '%licensed%' or length(content) > 300").select("version_id").distinct()
    return u.where("chunk_index = 0").join(hits, "version_id", "left_semi").distinct()


@query("j12_display_context", using("kb_units", "SELECT version_id, count(*) AS units, md5(string_agg(chunk_index || '=' || content, chr(10) ORDER BY chunk_index)) AS context_md5 FROM kb_units GROUP BY 1"))
def j12(spark, d):
    g = C.units(spark, d).groupBy("version_id").agg(F.count("*").alias("units"), F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("m"))
    return g.select("version_id", "units", F.md5(F.array_join(F.transform("m", lambda x: F.concat(x["chunk_index"].cast("string"), F.lit("="), x["content"])), "\n")).alias("context_md5"))


@query("j13_exists_published", using("kb_status", "SELECT p_partkey FROM part WHERE p_partkey % 5 = 0 OR EXISTS (SELECT 1 FROM kb_status WHERE status = 'published' AND version_id = p_partkey)"))
def j13(spark, d):
    part = C.table(spark, d, "part").select("p_partkey")
    live = C.with_status(C.versions(spark, d)).where("status = 'published'").select(F.col("version_id").alias("p_partkey"))
    return part.where("p_partkey % 5 = 0").unionByName(part.where("p_partkey % 5 <> 0").join(live, "p_partkey", "left_semi"))


@query("j14_relations_with_titles", "WITH e AS (SELECT p_partkey AS s, p_partkey * 3 + 20 AS t FROM part) SELECT s, a.p_name AS source_title, t, b.p_name AS target_title FROM e JOIN part a ON a.p_partkey = s LEFT JOIN part b ON b.p_partkey = t")
def j14(spark, d):
    n = C.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_name")
    e = n.select(F.col("k").alias("s"), (F.col("k") * 3 + 20).alias("t"))
    return e.join(n.select(F.col("k").alias("s"), F.col("p_name").alias("source_title")), "s").join(n.select(F.col("k").alias("t"), F.col("p_name").alias("target_title")), "t", "left").select("s", "source_title", "t", "target_title")


@query("j15_collection_items", "SELECT r_name AS collection, n_name AS item, count(c_custkey) AS people FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY ALL")
def j15(spark, d):
    people = C.table(spark, d, "customer").where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"))
    items = C.table(spark, d, "nation").join(people, "n_nationkey", "left").fillna(0, ["people"])
    return C.table(spark, d, "region").join(items, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("collection"), F.col("n_name").alias("item"), "people")


PAIRS = f", t AS (SELECT version_id AS id, list_distinct({TOKENS}) AS ts FROM kb_units WHERE chunk_index = 0), l AS (SELECT id, unnest(ts) AS t FROM t), f AS (SELECT t FROM l GROUP BY t HAVING count(*) BETWEEN 2 AND 12), p AS (SELECT DISTINCT x.id AS a, y.id AS b FROM l x JOIN l y ON x.t = y.t AND x.id < y.id WHERE x.t IN (SELECT t FROM f)), s AS (SELECT a, b, len(list_intersect(x.ts, y.ts)) AS shared, len(x.ts) AS size_a, len(y.ts) AS size_b FROM p JOIN t x ON x.id = a JOIN t y ON y.id = b)"


def _pairs(spark, d):
    t = C.units(spark, d).where("chunk_index = 0").select(F.col("version_id").alias("id"), T.tokens(F.col("content")).alias("ts"))
    return R.pairs_by_token(t, "id", "ts", 12)


@query("j18_document_pairs", using("kb_units", PAIRS + " SELECT a, b, shared, size_a, size_b FROM s"))
def j18(spark, d):
    return _pairs(spark, d)


@query("k20_reconcile", using("kb_units", PAIRS + ", o AS (SELECT a, b, round(shared / greatest(size_a, size_b), 6) AS overlap FROM s), k AS (SELECT *, CASE WHEN overlap >= 0.82 THEN 'duplicate' WHEN overlap >= 0.35 THEN 'related' ELSE 'possible_conflict' END AS relation FROM o) SELECT a, b, overlap, relation, place FROM (SELECT *, row_number() OVER (PARTITION BY a, relation ORDER BY overlap DESC, b) AS place FROM k) WHERE place <= 5"))
def k20(spark, d):
    o = _pairs(spark, d).select("a", "b", F.round(F.col("shared") / F.greatest("size_a", "size_b"), 6).alias("overlap"))
    k = o.withColumn("relation", F.when(F.col("overlap") >= 0.82, "duplicate").when(F.col("overlap") >= 0.35, "related").otherwise("possible_conflict"))
    return ordering.top_k(k, ["a", "relation"], 5, F.col("overlap").desc(), F.col("b"), rank="place")


CLASSES = f", t AS (SELECT version_id AS id, list_sort(list_distinct({TOKENS})) AS ts FROM kb_units WHERE chunk_index = 0), m AS (SELECT id, md5(array_to_string(ts, ' ')) AS class, ts FROM t WHERE len(ts) > 0)"
ALL_PAIRS = CLASSES + ", s AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.ts, y.ts)) AS shared, len(x.ts) AS size_a, len(y.ts) AS size_b FROM m x JOIN m y ON x.id < y.id WHERE len(list_intersect(x.ts, y.ts)) > 0)"


def _classes(spark, d):
    t = C.units(spark, d).where("chunk_index = 0").select(F.col("version_id").alias("id"), T.tokens(F.col("content")).alias("ts"))
    return R.token_classes(t, "id", "ts")


@query("j18_title_classes", using("kb_units", CLASSES + " SELECT id, class, len(ts) AS size FROM m"))
def j18_classes(spark, d):
    return _classes(spark, d).select("id", "class", F.size("ts").alias("size"))


@query("j18_title_class_pairs", using("kb_units", CLASSES + ", c AS (SELECT DISTINCT class, ts FROM m) SELECT x.class AS a, y.class AS b, len(list_intersect(x.ts, y.ts)) AS shared, len(x.ts) AS size_a, len(y.ts) AS size_b FROM c x JOIN c y ON x.class < y.class WHERE len(list_intersect(x.ts, y.ts)) > 0"))
def j18_pairs(spark, d):
    return R.class_pairs(_classes(spark, d))


RELATION = "CASE WHEN overlap >= 0.82 THEN 'duplicate' WHEN overlap >= 0.35 THEN 'related' ELSE 'possible_conflict' END"


@query("k20_reconcile_all", using("kb_units", ALL_PAIRS + f", o AS (SELECT a, b, round(shared / greatest(size_a, size_b), 6) AS overlap FROM s), k AS (SELECT *, {RELATION} AS relation FROM o) SELECT a, b, overlap, relation, place FROM (SELECT *, row_number() OVER (PARTITION BY a, relation ORDER BY overlap DESC, b) AS place FROM k) WHERE place <= 5"))
def k20_all(spark, d):
    c = _classes(spark, d)
    o = overlaps.best_partners(c, "id", 5, (350_000, 820_000)).select("a", "b", F.round(F.col("shared") / F.greatest("size_a", "size_b"), 6).alias("overlap"))
    return ordering.top_k(o.withColumn("relation", F.expr(RELATION)), ["a", "relation"], 5, F.col("overlap").desc(), F.col("b"), rank="place")


SETS = f""", t AS (SELECT doc_id AS id, list_distinct({TOKENS.replace("content", "text")}) AS ts FROM documents), m AS (SELECT id, md5(array_to_string(list_sort(ts), ' ')) AS k, ts FROM t WHERE len(ts) > 0),
    c AS (SELECT k, min(id) AS class_id, count(*) AS members, any_value(ts) AS ts, len(any_value(ts)) AS n FROM m GROUP BY k),
    links AS (SELECT x.k AS ka, y.k AS kb, x.class_id AS a, y.class_id AS b, y.members AS mb, len(list_intersect(x.ts, y.ts)) AS shared, x.n AS size_a, y.n AS size_b FROM c x JOIN c y ON x.k <> y.k AND least(x.n, y.n) * 100 >= 82 * greatest(x.n, y.n) WHERE len(list_intersect(x.ts, y.ts)) * 100 >= 82 * greatest(x.n, y.n))"""


def _set_classes(spark, d):
    docs = C.table(spark, d, "documents").select("doc_id", "text")
    return docs, *similarity.set_classes(docs, "doc_id", "text")


@query("j18_similar_documents", "WITH z AS (SELECT 1)" + SETS + ", n AS (SELECT ka AS k, sum(mb)::BIGINT AS n_links FROM links GROUP BY 1) SELECT id AS doc_id, class_id, members - 1 AS n_copies, coalesce(n_links, 0) AS n_links FROM m JOIN c USING (k) LEFT JOIN n USING (k) UNION ALL SELECT id, NULL, 0, 0 FROM t WHERE coalesce(len(ts), 0) = 0")
def j18_similar(spark, d):
    docs, rows, sets, reps = _set_classes(spark, d)
    return similarity.link_counts(docs, "doc_id", "text", rows, similarity.linked_members(sets, reps, consume=True))


@query("j18_similar_class_pairs", "WITH z AS (SELECT 1)" + SETS + " SELECT a, b, shared, size_a, size_b FROM links WHERE a < b")
def j18_similar_pairs(spark, d):
    _, _, sets, reps = _set_classes(spark, d)
    return similarity.similar_sets(sets, reps, consume=True, name="class_id")


@query("k20_duplicate_documents", "WITH z AS (SELECT 1)" + SETS + ", o AS (SELECT a, b, round(shared / greatest(size_a, size_b), 6) AS overlap FROM links) SELECT a, b, overlap, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY overlap DESC, b) AS place FROM o) WHERE place <= 5")
def k20_duplicates(spark, d):
    """The report's five best duplicates of each class, as the report's limit is; j18_similar_class_pairs has all of them."""
    _, _, sets, reps = _set_classes(spark, d)
    o = similarity.best_links(sets, reps, 5, consume=True).select("a", "b", F.round(F.col("shared") / F.greatest("size_a", "size_b"), 6).alias("overlap"))
    return ordering.top_k(o, ["a"], 5, F.col("overlap").desc(), F.col("b"), rank="place")


@query("j19_polarity_conflicts", using("kb_units", f", t AS (SELECT version_id AS id, list_distinct({TOKENS}) AS ts, version_id % 2 = 0 AS allow, length(content) // 20 AS scope FROM kb_units WHERE chunk_index = 0) SELECT x.id AS a, y.id AS b, len(list_intersect(x.ts, y.ts)) AS shared FROM t x JOIN t y ON x.scope = y.scope AND x.id < y.id AND x.allow <> y.allow WHERE len(list_intersect(x.ts, y.ts)) >= 4"))
def j19(spark, d):
    t = C.units(spark, d).where("chunk_index = 0").select(F.struct("version_id", F.floor(F.length("content") / 20).alias("scope")).alias("of"), T.tokens(F.col("content")).alias("ts"))
    c = R.token_classes(t, "of", "ts").select("class", "ts", "of.*", F.expr("of.version_id % 2 = 0").alias("allow"))
    return overlaps.opposed_pairs(c, "version_id", "scope", "allow", 4)


@query("j20_nearest_node", "WITH n AS (SELECT s_suppkey AS node, s_nationkey AS page, s_acctbal::DOUBLE AS x FROM supplier), o AS (SELECT c_custkey AS note, c_nationkey AS page, c_acctbal::DOUBLE AS y FROM customer), r AS (SELECT note, node, abs(x - y) AS distance, row_number() OVER (PARTITION BY note ORDER BY abs(x - y), node) AS k FROM n JOIN o USING (page)) SELECT note, node, round(distance, 4) AS distance FROM r WHERE k = 1")
def j20(spark, d):
    n = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("page"), F.col("s_acctbal").cast("double").alias("x"))
    o = C.table(spark, d, "customer").select(F.col("c_custkey").alias("note"), F.col("c_nationkey").alias("page"), F.col("c_acctbal").cast("double").alias("y"))
    near = spatial.nearest(o.select("page", "note", F.col("y").alias("x"), F.lit(0.0).alias("y")), n.withColumn("y", F.lit(0.0)), "page", "note", "node")
    return near.select("note", "node", F.round("distance", 4).alias("distance"))


@query("k19_relation_review", f"WITH {EDGES} SELECT source_id, target_id, CASE WHEN source_id % 4 = 1 AND status = 'unresolved' THEN 'approved' WHEN source_id % 4 = 2 AND status = 'unresolved' THEN 'rejected' WHEN source_id % 4 = 3 THEN 'archived' ELSE status END AS status FROM edges")
def k19(spark, d):
    e = _edges(spark, d)
    dec = e.where("source_id % 4 > 0").select("source_id", F.when(F.col("source_id") % 4 == 1, "assign").when(F.col("source_id") % 4 == 2, "reject").otherwise("archive").alias("decision"))
    return R.review(e, dec, ["source_id"]).select("source_id", "target_id", "status")


@query("k18_relation_sync", LINKS + f", c AS (SELECT page_id, target, {KINDS} AS kind FROM kb_links), g AS (SELECT page_id, target, min(kind) AS kind, count(*) AS evidence FROM c GROUP BY ALL), t AS (SELECT target, count(DISTINCT page_id) AS pages FROM c GROUP BY 1) SELECT g.page_id, g.target, kind, evidence, CASE WHEN pages = 1 THEN 'approved' ELSE 'unresolved' END AS status FROM g JOIN t ON t.target = g.target")
def k18(spark, d):
    c = c24(spark, d)
    g = R.consolidate(c, ["page_id", "target"], "kind", "confidence", ["depends_on", "references", "related"]).withColumnRenamed("candidates", "evidence")
    t = c.groupBy("target").agg(F.countDistinct("page_id").alias("pages"))
    return g.join(t, "target").select("page_id", "target", "kind", "evidence", F.when(F.col("pages") == 1, "approved").otherwise("unresolved").alias("status"))


@query("d15_row_links", LINKS + " SELECT page_id, href, count(*) AS n FROM kb_links GROUP BY ALL")
def d15(spark, d):
    return _links(spark, d).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("k27_graph_degrees", using("kb_degrees", "SELECT graph_id, node_id, out_degree, in_degree FROM kb_degrees"))
def k27(spark, d):
    return GR.degrees(C.graph_nodes(spark, d), C.graph_edges(spark, d), GRAPH).select("graph_id", "node_id", "out_degree", "in_degree")


@query("k28_graph_topology", using("kb_nodes kb_drawn", "SELECT graph_id, 'duplicate_label' AS code, lower(title) AS id FROM kb_nodes GROUP BY graph_id, lower(title) HAVING count(*) > 1"
    " UNION ALL SELECT DISTINCT graph_id, 'unknown_endpoint', to_node::VARCHAR FROM kb_drawn e ANTI JOIN kb_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.to_node"
    " UNION ALL SELECT graph_id, 'duplicate_edge', from_node || '>' || to_node FROM kb_drawn GROUP BY graph_id, from_node, to_node HAVING count(*) > 1"
    " UNION ALL SELECT graph_id, 'disconnected', node_id::VARCHAR FROM kb_nodes n ANTI JOIN kb_drawn e ON e.graph_id = n.graph_id AND (e.from_node = n.node_id OR e.to_node = n.node_id)"
    " UNION ALL SELECT graph_id, 'missing_branch', from_node::VARCHAR FROM kb_drawn GROUP BY graph_id, from_node HAVING count(*) = 1"))
def k28(spark, d):
    return GR.topology(C.graph_nodes(spark, d), C.drawn_edges(spark, d), GRAPH)


@query("k26_graph_compile", using("kb_degrees", "SELECT graph_id, from_node, to_node, condition FROM kb_edges UNION ALL SELECT graph_id, -1, node_id, 'start' FROM kb_degrees WHERE in_degree = 0 UNION ALL SELECT graph_id, node_id, -2, 'end' FROM kb_degrees WHERE out_degree = 0"))
def k26(spark, d):
    return GR.compile_graph(C.graph_nodes(spark, d), C.graph_edges(spark, d), GRAPH)[1]


@query("k29_graph_paths", using("kb_degrees", "").replace("WITH ", "WITH RECURSIVE ", 1) + ", w AS (SELECT graph_id, node_id AS root, node_id AS at_, [node_id] AS path, '' AS c FROM kb_degrees WHERE in_degree = 0 UNION ALL SELECT w.graph_id, root, to_node, list_append(path, to_node), c || CASE WHEN condition = 'yes' THEN '0' ELSE '1' END FROM w JOIN kb_edges e ON e.graph_id = w.graph_id AND e.from_node = w.at_ WHERE NOT list_contains(path, to_node) AND len(path) < 18)"
    ", e AS (SELECT w.graph_id, root, array_to_string(path, ',') AS p, c FROM w JOIN kb_degrees g ON g.graph_id = w.graph_id AND g.node_id = w.at_ AND g.out_degree = 0), r AS (SELECT graph_id, root, p AS path, row_number() OVER (PARTITION BY graph_id, root ORDER BY c, p) AS place FROM e) SELECT * FROM r WHERE place <= 18")
def k29(spark, d):
    p = GR.paths(C.graph_nodes(spark, d), C.graph_edges(spark, d), by=GRAPH)
    return p.select("graph_id", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "place")


@query("k30_graph_units", using("kb_edges", "SELECT graph_id, 'node' AS kind, node_id::VARCHAR AS id, title AS text FROM kb_nodes UNION ALL SELECT e.graph_id, 'branch', from_node || '>' || to_node, a.title || ' -[' || condition || ']-> ' || b.title FROM kb_edges e JOIN kb_nodes a ON a.graph_id = e.graph_id AND a.node_id = from_node JOIN kb_nodes b ON b.graph_id = e.graph_id AND b.node_id = to_node"))
def k30(spark, d):
    n, e = C.graph_nodes(spark, d), C.graph_edges(spark, d)
    a, b = (n.select("graph_id", F.col("node_id").alias(f"{c}_node"), F.col("title").alias(f"{c}_title")) for c in ("from", "to"))
    named = e.join(a, ["graph_id", "from_node"]).join(b, ["graph_id", "to_node"])
    branch = F.concat(F.col("from_title"), F.lit(" -["), F.col("condition"), F.lit("]-> "), F.col("to_title"))
    return n.select("graph_id", F.lit("node").alias("kind"), F.col("node_id").cast("string").alias("id"), F.col("title").alias("text")).unionByName(named.select("graph_id", F.lit("branch").alias("kind"), F.concat_ws(">", "from_node", "to_node").alias("id"), branch.alias("text")))


@query("w15_sequential_followup", using("kb_degrees", "SELECT a.graph_id, a.node_id AS from_node, b.node_id AS to_node FROM kb_degrees a JOIN kb_nodes b ON b.graph_id = a.graph_id AND b.node_id = a.node_id + 1 WHERE a.out_degree = 0"))
def w15(spark, d):
    n = C.graph_nodes(spark, d)
    t = GR.terminals(n, C.graph_edges(spark, d), GRAPH).select("graph_id", F.col("node_id").alias("from_node"), (F.col("node_id") + 1).alias("to_node"))
    return t.join(n.select("graph_id", F.col("node_id").alias("to_node")), ["graph_id", "to_node"], "left_semi").select("graph_id", "from_node", "to_node")


@query("d47_graph_summary", using("kb_degrees", "SELECT graph_id, count(*) AS nodes, count(*) FILTER (out_degree > 0) AS decisions, count(*) FILTER (out_degree = 0) AS ends FROM kb_degrees GROUP BY 1"))
def d47(spark, d):
    g = GR.degrees(C.graph_nodes(spark, d), C.graph_edges(spark, d), GRAPH)
    return g.groupBy("graph_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("out_degree") > 0).alias("decisions"), F.count_if(F.col("out_degree") == 0).alias("ends"))


@query("d54_graph_dedupe", using("kb_nodes", "SELECT graph_id, lower(trim(title)) AS k, min(node_id) AS node_id, count(*) AS n FROM kb_nodes GROUP BY 1, 2"))
def d54(spark, d):
    return C.graph_nodes(spark, d).groupBy("graph_id", F.lower(F.trim("title")).alias("k")).agg(F.min("node_id").alias("node_id"), F.count("*").alias("n"))


@query("k33_candidate_selection", "SELECT l_orderkey, arg_max(l_linenumber, (l_quantity, -l_linenumber)) AS chosen, count(*) AS attempts FROM lineitem GROUP BY 1")
def k33(spark, d):
    return C.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_quantity", -F.col("l_linenumber"))).alias("chosen"), F.count("*").alias("attempts"))


@query("k34_embedding_backfill", "SELECT vec_id, vec_id // 100 AS batch, count(*) OVER (PARTITION BY vec_id // 100) AS batch_rows FROM embeddings WHERE label <> 3")
def k34(spark, d):
    """Every stale row, in batches by id: a batch is a range of ids, so that no row's batch depends on all the others."""
    stale = C.vectors(spark, d).where("label <> 3").select("vec_id", F.floor(F.col("vec_id") / 100).alias("batch"))
    return stale.withColumn("batch_rows", F.count("*").over(Window.partitionBy("batch")))


@query("d12_index_rows", using("kb_status kb_units", "SELECT version_id, chunk_index, length(content) AS n FROM kb_units JOIN kb_status USING (version_id) WHERE review_status = 'approved' UNION ALL SELECT version_id, -1, length(text) FROM kb_status WHERE status = 'published'"))
def d12(spark, d):
    v = C.with_status(C.versions(spark, d))
    u = C.units(spark, d).join(v.where("review_status = 'approved'").select("version_id"), "version_id", "left_semi").select("version_id", "chunk_index", F.length("content").alias("n"))
    return u.unionByName(v.where("status = 'published'").select("version_id", F.lit(-1).alias("chunk_index"), F.length("text").alias("n")))


@query("d14_embedding_spec_registry", "SELECT label AS spec, count(*) AS n, max(vec_id) AS newest FROM embeddings GROUP BY 1")
def d14(spark, d):
    return C.vectors(spark, d).groupBy(F.col("label").alias("spec")).agg(F.count("*").alias("n"), F.max("vec_id").alias("newest"))


@query("d9_inferred_effective_from", using("kb_units", "SELECT version_id, coalesce(arg_min(chunk_index, chunk_index) FILTER (length(content) > 100), -1) AS first_long FROM kb_units GROUP BY 1"))
def d9(spark, d):
    return C.units(spark, d).groupBy("version_id").agg(F.coalesce(F.min(F.when(F.length("content") > 100, F.col("chunk_index"))), F.lit(-1)).alias("first_long"))


@query("d7_required_types", using("kb_units", ", t AS (SELECT DISTINCT version_id, CASE WHEN length(content) > 300 THEN 'long' WHEN length(content) > 80 THEN 'middle' ELSE 'short' END AS kind FROM kb_units), q AS (SELECT version_id, unnest(['long', 'middle', 'short']) AS kind FROM (SELECT DISTINCT version_id FROM kb_units)) SELECT version_id, kind FROM q EXCEPT SELECT version_id, kind FROM t"))
def d7(spark, d):
    n = F.length("content")
    t = C.units(spark, d).select("version_id", F.when(n > 300, "long").when(n > 80, "middle").otherwise("short").alias("kind")).distinct()
    required = t.select("version_id").distinct().select("version_id", F.explode(F.array(*map(F.lit, ("long", "middle", "short")))).alias("kind"))
    return required.join(t, ["version_id", "kind"], "left_anti")

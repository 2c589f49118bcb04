"""Queries: logs, sessions, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import analytics as A
from corpusloom.operators import ordering
from corpusloom.plans.registry import query
from corpusloom.plans.views import using
from corpusloom.sources import corpus as C

ATTRIBUTED = """, c AS (SELECT event_id, ts, actor, rank FROM kb_audit WHERE action = 'search_result_click'), s AS (SELECT event_id, ts, actor FROM kb_audit WHERE action = 'sop_search'),
p AS (SELECT c.event_id, c.actor, c.rank, s.event_id AS search_event_id, epoch_us(c.ts) - epoch_us(s.ts) AS elapsed_us, row_number() OVER (PARTITION BY c.event_id ORDER BY s.ts DESC, s.event_id DESC) AS r FROM c JOIN s ON s.actor = c.actor AND s.ts <= c.ts),
attributed AS (SELECT event_id, actor, rank, search_event_id, elapsed_us FROM p WHERE r = 1)"""


@query("j16_click_attribution", using("kb_audit", ATTRIBUTED + " SELECT * FROM attributed"))
def j16(spark, d):
    return A.attribute_clicks(C.audit(spark, d))


@query("a1_ops_kpis", using("kb_audit kb_log", "SELECT a.*, b.* FROM (SELECT count(*) FILTER (action = 'sop_search') AS searches, count(*) FILTER (action = 'search_result_click') AS clicks, count(*) FILTER (action = 'quick_answer_open') AS quick_opens, count(*) FILTER (action = 'feedback_submitted') AS feedback, count(DISTINCT actor) AS actors, round(avg(rank) FILTER (action = 'search_result_click'), 6) AS avg_clicked_rank FROM kb_audit) a, (SELECT count(*) AS retrievals, round(avg((result_count = 0)::INT), 6) AS zero_rate, round(quantile_cont(latency_ms, 0.5), 6) AS median_latency FROM kb_log) b"))
def a1(spark, d):
    k = A.ops_kpis(C.audit(spark, d), C.retrieval_log(spark, d))
    return k.withColumns({c: F.round(c, 6) for c in ("avg_clicked_rank", "zero_rate", "median_latency")})


@query("a2_median", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def a2(spark, d):
    return C.table(spark, d, "events").groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("median"))


@query("a3_popular_queries", using("kb_log", "SELECT query, count(*) AS n, epoch_us(max(ts)) AS last_us FROM kb_log GROUP BY 1 ORDER BY n DESC, last_us DESC, query DESC LIMIT 6"))
def a3(spark, d):
    return A.popular_queries(C.retrieval_log(spark, d)).select("query", "n", F.unix_micros("last_seen").alias("last_us"))


@query("a4_feedback_queue", using("kb_audit", ", r AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'c' || event_id END AS comment FROM kb_audit WHERE action = 'feedback_submitted' ORDER BY ts DESC, event_id DESC LIMIT 200) SELECT query, count(*) AS n, arg_max(comment, (ts, event_id)) FILTER (trim(comment) <> '') AS comment, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM r GROUP BY 1"))
def a4(spark, d):
    e = C.audit(spark, d).where("action = 'feedback_submitted'").withColumn("comment", F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(F.lit("c"), "event_id")))
    return A.feedback_queue(e, ["query"], 200).select("query", "n", "comment", "severity")


@query("a5_zero_result_clusters", using("kb_log", "SELECT query, count(*) AS n, round(least(0.94::DOUBLE, 0.48::DOUBLE + least(count(*), 10) * 0.035::DOUBLE + CASE WHEN query LIKE '%7' THEN 0.2::DOUBLE ELSE 0 END), 6) AS confidence FROM kb_log WHERE result_count = 0 GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, query LIMIT 40"))
def a5(spark, d):
    return A.zero_result_clusters(C.retrieval_log(spark, d), 2, 40, F.col("query").endswith("7")).select("query", "n", F.round("confidence", 6).alias("confidence"))


@query("a8_issue_router_rollup", "SELECT o_custkey AS chunk_id, max(o_orderstatus) AS status, count(DISTINCT o_orderkey) AS relations, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1")
def a8(spark, d):
    return C.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("chunk_id")).agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("relations"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("kinds"))


@query("a25_stage_summary", "SELECT o_orderpriority AS stage, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def a25(spark, d):
    return C.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.count_if(F.col("o_orderstatus") == "F").alias("failed"))


@query("a24_pipeline_issue_summary", "SELECT o_custkey AS job, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS degraded, round(sum(o_totalprice)::DOUBLE, 2) AS total FROM orders GROUP BY 1")
def a24(spark, d):
    return C.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") == "P").alias("degraded"), F.round(F.sum("o_totalprice").cast("double"), 2).alias("total"))


@query("a27_migration_counts", "SELECT count(*) FILTER (label <> 3) AS stale, count(*) FILTER (label = 3) AS current FROM embeddings")
def a27(spark, d):
    return C.vectors(spark, d).agg(F.count_if(F.col("label") != 3).alias("stale"), F.count_if(F.col("label") == 3).alias("current"))


KNN = "WITH s AS (SELECT q.vec_id AS query_id, q.label AS want, c.vec_id AS chunk_id, c.label, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)"


def _ranked(spark, d):
    from corpusloom.plans.retrieval import j4

    label = C.vectors(spark, d).select(F.col("vec_id").alias("chunk_id"), "label")
    return j4(spark, d).join(label, "chunk_id")


@query("a36_source_groups", KNN + " SELECT query_id, label, count(*) AS n, min(rank) AS first_rank FROM r WHERE rank <= 30 GROUP BY ALL")
def a36(spark, d):
    return _ranked(spark, d).groupBy("query_id", "label").agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


@query("a37_group_by_display_source", KNN + " SELECT query_id, label, round(max(score), 6) AS score, array_to_string(list_slice(list(chunk_id ORDER BY rank), 1, 3), ',') AS matches FROM r WHERE rank <= 30 GROUP BY ALL")
def a37(spark, d):
    g = _ranked(spark, d).groupBy("query_id", "label").agg(F.max("vector_score").alias("score"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("m"))
    return g.select("query_id", "label", F.round("score", 6).alias("score"), F.array_join(F.slice("m.chunk_id", 1, 3), ",").alias("matches"))


@query("a38_ranking_eval", KNN + ", g AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id), h AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5 FROM r JOIN g USING (query_id, chunk_id) WHERE rank <= 30 GROUP BY 1) SELECT query_id, coalesce(h1, 0) > 0 AS top1, coalesce(h3, 0) > 0 AS top3, coalesce(h5, 0) > 0 AS top5, round(coalesce(h3, 0) / 3, 6) AS p_at_3, round(coalesce(h5, 0) / wanted, 6) AS r_at_5 FROM (SELECT query_id, count(*) AS wanted FROM g GROUP BY 1) LEFT JOIN h USING (query_id)")
def a38(spark, d):
    v = C.vectors(spark, d)
    golden = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v.select(F.col("vec_id").alias("chunk_id"), "label"), "label").where("query_id <> chunk_id").select("query_id", "chunk_id")
    e = A.ranking_eval(golden, _ranked(spark, d).select("query_id", "chunk_id", "rank"), "query_id", "chunk_id")
    return e.withColumns({c: F.round(c, 6) for c in ("p_at_3", "r_at_5")})


@query("a39_golden_pass_rate", KNN + " SELECT query_id, min(rank) FILTER (label = want AND chunk_id <> query_id) AS first_hit, coalesce(min(rank) FILTER (label = want AND chunk_id <> query_id) <= 5, FALSE) AS passed FROM r WHERE rank <= 30 GROUP BY 1")
def a39(spark, d):
    want = C.vectors(spark, d).select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    g = _ranked(spark, d).join(want, "query_id").groupBy("query_id").agg(F.min(F.when((F.col("label") == F.col("want")) & (F.col("chunk_id") != F.col("query_id")), F.col("rank"))).alias("first_hit"))
    return g.select("query_id", "first_hit", F.coalesce(F.col("first_hit") <= 5, F.lit(False)).alias("passed"))


@query("w4_top_gap", KNN + " SELECT query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 3) AS gap FROM r GROUP BY 1")
def w4(spark, d):
    g = _ranked(spark, d).where("rank <= 2").groupBy("query_id").agg((F.max(F.when(F.col("rank") == 1, F.col("vector_score"))) - F.max(F.when(F.col("rank") == 2, F.col("vector_score")))).alias("gap"))
    return g.select("query_id", F.round("gap", 3).alias("gap"))


@query("w2_duplicate_parent_penalty", KNN + ", n AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS sibling FROM r WHERE rank <= 30) SELECT query_id, chunk_id, CASE WHEN sibling = 1 THEN 0 WHEN sibling = 2 THEN -8 ELSE -16 END AS penalty FROM n")
def w2(spark, d):
    return ordering.top_k(_ranked(spark, d).withColumnRenamed("rank", "place"), ["query_id", "label"], 1 << 30, F.col("place"), rank="sibling").select("query_id", "chunk_id", F.when(F.col("sibling") == 1, 0).when(F.col("sibling") == 2, -8).otherwise(-16).alias("penalty"))


@query("w11_context_limit", KNN + ", p AS (SELECT *, score >= 0.45 AS pass FROM r WHERE rank <= 30 AND chunk_id <> query_id), q AS (SELECT *, row_number() OVER (PARTITION BY query_id, pass ORDER BY rank) AS n, bool_or(pass) OVER (PARTITION BY query_id) AS any_pass FROM p) SELECT query_id, chunk_id, NOT any_pass AS diagnostic FROM q WHERE (pass AND n <= 5) OR (NOT any_pass AND n <= 3)")
def w11(spark, d):
    from pyspark.sql import Window

    p = _ranked(spark, d).where("chunk_id <> query_id").withColumn("pass", F.col("vector_score") >= 0.45)
    q = p.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "pass").orderBy("rank"))).withColumn("any_pass", F.bool_or("pass").over(Window.partitionBy("query_id")))
    return q.where("(pass and n <= 5) or (not any_pass and n <= 3)").select("query_id", "chunk_id", (~F.col("any_pass")).alias("diagnostic"))


@query("w12_recent_turns", using("kb_messages", ", l AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM kb_messages WHERE role IN ('user', 'assistant')) SELECT session_id, seq, role, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS place FROM l WHERE back <= 3"))
def w12(spark, d):
    return A.recent_turns(C.messages(spark, d), 3).select("session_id", "seq", "role", "place")


@query("w13_follow_up_query", using("kb_messages", ", l AS (SELECT *, lag(content, 1) OVER w AS p1, lag(content, 2) OVER w AS p2 FROM kb_messages WINDOW w AS (PARTITION BY session_id ORDER BY seq)) SELECT session_id, seq, CASE WHEN length(content) < 60 THEN concat_ws(' ', p2, p1, content) ELSE content END AS expanded FROM l WHERE role = 'user'"))
def w13(spark, d):
    return A.follow_up(C.messages(spark, d), 60)


@query("w14_session_rollup", using("kb_messages", "SELECT session_id, count(*) AS n, count(*) FILTER (role = 'user') AS user_turns, max(seq) AS last_seq, right(string_agg(content, ' ' ORDER BY seq), 600) AS summary FROM kb_messages GROUP BY 1"))
def w14(spark, d):
    return A.session_rollup(C.messages(spark, d))


@query("d48_assistant_briefs", using("kb_messages", "SELECT session_id, arg_max(seq, seq) AS seq, arg_max(left(content, 220), seq) AS brief FROM kb_messages WHERE role = 'assistant' GROUP BY 1"))
def d48(spark, d):
    return ordering.latest(C.messages(spark, d).where("role = 'assistant'").select("session_id", "seq", F.substring("content", 1, 220).alias("brief")), ["session_id"], F.col("seq"))


@query("d58_top1_suggestion", KNN + " SELECT query_id, chunk_id, round(score, 6) AS score FROM r WHERE rank = 1")
def d58(spark, d):
    return _ranked(spark, d).where("rank = 1").select("query_id", "chunk_id", F.round("vector_score", 6).alias("score"))


@query("s11_retrieval_log", KNN + " SELECT query_id, count(*) AS result_count, round(max(score), 6) AS best, array_to_string(list(chunk_id ORDER BY rank), ',') AS trace FROM r WHERE rank <= 30 GROUP BY 1")
def s11(spark, d):
    g = _ranked(spark, d).groupBy("query_id").agg(F.count("*").alias("result_count"), F.max("vector_score").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("m"))
    return g.select("query_id", "result_count", F.round("best", 6).alias("best"), F.array_join("m.chunk_id", ",").alias("trace"))


@query("s12_audit_rows", using("kb_audit", "SELECT event_id, actor, action, query FROM kb_audit"))
def s12(spark, d):
    return C.audit(spark, d).select("event_id", "actor", "action", "query")


@query("o4_popular_items", "SELECT p_partkey, count(*) AS views FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 ORDER BY views DESC, p_partkey LIMIT 25")
def o4(spark, d):
    return C.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("views")).join(C.table(spark, d, "part").select("p_partkey"), "p_partkey", "left_semi").orderBy(F.col("views").desc(), "p_partkey").limit(25)


@query("o7_autocomplete", "WITH c AS (SELECT 0 AS tier, n_name AS title FROM nation WHERE lower(n_name) LIKE '%an%' UNION ALL SELECT 1, p_name FROM part WHERE lower(p_name) LIKE '%an%'), u AS (SELECT lower(title) AS title, min(tier) AS tier FROM c GROUP BY 1) SELECT title, tier FROM u ORDER BY tier, title LIMIT 12")
def o7(spark, d):
    a = C.table(spark, d, "nation").select(F.lit(0).alias("tier"), F.lower("n_name").alias("title"))
    b = C.table(spark, d, "part").select(F.lit(1).alias("tier"), F.lower("p_name").alias("title"))
    return a.unionByName(b).where(F.contains("title", F.lit("an"))).groupBy("title").agg(F.min("tier").alias("tier")).orderBy("tier", "title").limit(12)


@query("u7_multi_query_merge", KNN + " SELECT chunk_id, round(max(score), 6) AS score, min(rank) AS place FROM r WHERE rank <= 30 GROUP BY 1")
def u7(spark, d):
    return _ranked(spark, d).groupBy("chunk_id").agg(F.round(F.max("vector_score"), 6).alias("score"), F.min("rank").alias("place"))


@query("u4_dedupe_first_stage", KNN + ", a AS (SELECT query_id, chunk_id, 0 AS stage FROM r WHERE rank <= 8 UNION ALL SELECT query_id, chunk_id, 1 FROM r WHERE rank <= 20 AND chunk_id % 2 = 0) SELECT query_id, chunk_id, min(stage) AS stage FROM a GROUP BY ALL")
def u4(spark, d):
    r = _ranked(spark, d)
    every = r.where("rank <= 8").select("query_id", "chunk_id", F.lit(0).alias("stage")).unionByName(r.where("rank <= 20 and chunk_id % 2 = 0").select("query_id", "chunk_id", F.lit(1).alias("stage")))
    return every.groupBy("query_id", "chunk_id").agg(F.min("stage").alias("stage"))


@query("o1_candidate_order", KNN + " SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY label DESC, round(score, 6) DESC, rank, chunk_id) AS place FROM r WHERE rank <= 30")
def o1(spark, d):
    return ordering.top_k(_ranked(spark, d).withColumnRenamed("rank", "r"), ["query_id"], 1 << 30, F.col("label").desc(), F.col("vector_score").desc(), F.col("r"), F.col("chunk_id"), rank="place").select("query_id", "chunk_id", "place")


@query("o2_stage_limits", KNN + " SELECT query_id, count(*) FILTER (rank <= 30) AS merged, count(*) FILTER (rank <= 20) AS business, count(*) FILTER (rank <= 8) AS output FROM r WHERE rank <= 30 GROUP BY 1")
def o2(spark, d):
    return _ranked(spark, d).groupBy("query_id").agg(F.count("*").alias("merged"), F.count_if(F.col("rank") <= 20).alias("business"), F.count_if(F.col("rank") <= 8).alias("output"))


@query("a14_scope_mix", KNN + " SELECT query_id, count(DISTINCT label) AS scopes, count(DISTINCT label) > 1 AS mixed FROM r WHERE rank <= 8 GROUP BY 1")
def a14(spark, d):
    return _ranked(spark, d).where("rank <= 8").groupBy("query_id").agg(F.countDistinct("label").alias("scopes")).select("query_id", "scopes", (F.col("scopes") > 1).alias("mixed"))


@query("a13_conflict_groups", KNN + " SELECT query_id, label AS conflict_group, count(DISTINCT chunk_id) AS documents FROM r WHERE rank <= 8 GROUP BY ALL HAVING count(DISTINCT chunk_id) > 1")
def a13(spark, d):
    return _ranked(spark, d).where("rank <= 8").groupBy("query_id", F.col("label").alias("conflict_group")).agg(F.countDistinct("chunk_id").alias("documents")).where("documents > 1")


@query("k22_authority_split", KNN + ", t AS (SELECT *, bool_or(chunk_id % 2 = 0) OVER (PARTITION BY query_id) AS peer FROM r WHERE rank <= 8) SELECT query_id, chunk_id, CASE WHEN chunk_id % 2 = 1 AND peer THEN 'secondary' ELSE 'primary' END AS authority FROM t")
def k22(spark, d):
    from pyspark.sql import Window

    t = _ranked(spark, d).where("rank <= 8").withColumn("peer", F.bool_or(F.col("chunk_id") % 2 == 0).over(Window.partitionBy("query_id")))
    return t.select("query_id", "chunk_id", F.when((F.col("chunk_id") % 2 == 1) & F.col("peer"), "secondary").otherwise("primary").alias("authority"))


@query("t4_session_windows_batch", "WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n FROM s GROUP BY user_id, s")
def t4(spark, d):
    e = C.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"), F.min("ts").alias("first")).select("user_id", F.unix_micros("first").alias("first_us"), "n")

"""Workflow graphs taken together with what a second reading found: better node texts, the candidate to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Node types of a graph, how flows rank, what a graph must have to be reviewed.
GRAPH_TYPES = ["start", "end", "action", "decision", "queue_rule", "sla_rule"]
FLOW_PRIORITY = {"workflow_v3_graph_primary": 4, "workflow_v2_vision_primary": 3, "workflow_legacy": 2, "semantic_workflow_structuring": 0}
UNREVIEWABLE_FLOW = "semantic_workflow_structuring"
MIN_NODES, MIN_EDGES = 2, 1
MATCHES = ["id", "code", "words"]
STEP_CODE = r"\b(\d+(?:\.\d+)*)[.)]?\s+"


def compatible(graph_type: Column, semantic_type: Column) -> Column:
    """Whether a graph's node type and a semantic one may stand for each other; a blank one always."""
    g, s = F.coalesce(graph_type, F.lit("")), F.coalesce(semantic_type, F.lit(""))
    steps = [t for t in GRAPH_TYPES if t not in ("decision", "start", "end")]
    return (g == "") | (s == "") | (g == s) | ((g == "action") & s.isin(*steps))


def _best_in_lists(n: DataFrame, s: DataFrame, by: str, least: float) -> DataFrame:
    """n with its best semantic node's semantic_id, matched_by, semantic_content and semantic_type, all of a graph's semantic nodes being at hand as a list."""
    lists = s.groupBy(by).agg(F.collect_list(F.struct("semantic_id", "semantic_content", "semantic_type", "s_code", "sw")).alias("all"))

    def match(x):
        fit = lambda rank, first, second: F.struct(F.lit(rank).alias("rank"), first.cast("double").alias("first"), second.cast("double").alias("second"), x["semantic_id"].alias("semantic_id"), x["semantic_content"].alias("semantic_content"), x["semantic_type"].alias("semantic_type"), F.lit(MATCHES[rank]).alias("matched_by"))
        score = T.containment(F.col("nw"), x["sw"])
        coded = (F.col("code") != "") & (F.col("code") == x["s_code"])
        by_code = fit(1, (~compatible(F.col("node_type"), x["semantic_type"])).cast("int"), -F.length(x["semantic_content"]))
        return F.when(F.col("node_id") == x["semantic_id"], fit(0, F.lit(0), F.lit(0))).when(coded, by_code).when(score >= least, fit(2, -score, F.lit(0)))

    found = n.join(lists, by, "left").withColumn("m", F.array_min(F.transform("all", match))).drop("all")
    return found.select(*n.columns, "m.semantic_id", "m.matched_by", "m.semantic_content", "m.semantic_type")


def _best_by_joins(n: DataFrame, s: DataFrame, by: str, least: float) -> DataFrame:
    """The same as ``_best_in_lists`` by joins alone, for graphs of any size."""
    direct = n.join(s, (n[by] == s[by]) & (n["node_id"] == s["semantic_id"])).select(n[by], "node_id", "semantic_id", F.lit("id").alias("matched_by"))
    fit = F.struct(~compatible(F.col("node_type"), F.col("semantic_type")), -F.length("semantic_content"), F.col("semantic_id"))
    coded = n.where("code <> ''").join(s, (n[by] == s[by]) & (n["code"] == s["s_code"])).groupBy(n[by], "node_id").agg(F.min_by("semantic_id", fit).alias("semantic_id")).select(by, "node_id", "semantic_id", F.lit("code").alias("matched_by"))

    a, b = n.select(by, "node_id", F.explode("nw").alias("t")), s.select(by, "semantic_id", F.explode("sw").alias("t"))
    df = a.select(by, "t").unionByName(b.select(by, "t")).groupBy(by, "t").agg(F.count("*").alias("df"))

    def rarest(long, key):
        w = long.join(df, [by, "t"]).groupBy(by, key).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("w"))
        keep = F.size("w") - F.ceil(F.size("w") * F.lit(least) - 1e-9) + 1
        return w.select(by, key, F.explode(F.slice("w", F.lit(1), keep.cast("int"))).alias("x")).select(by, key, F.col("x.t").alias("t"))

    pairs = rarest(a, "node_id").join(b, [by, "t"]).unionByName(rarest(b, "semantic_id").join(a, [by, "t"]), allowMissingColumns=True).select(by, "node_id", "semantic_id").distinct()
    met = pairs.join(n.select(by, "node_id", "nw"), [by, "node_id"]).join(s.select(by, "semantic_id", "sw"), [by, "semantic_id"]).withColumn("score", T.containment(F.col("nw"), F.col("sw"))).where(F.col("score") >= least)
    alike = met.groupBy(by, "node_id").agg(F.min_by("semantic_id", F.struct(-F.col("score"), F.col("semantic_id"))).alias("semantic_id")).select(by, "node_id", "semantic_id", F.lit("words").alias("matched_by"))
    order = F.array_position(F.array(*map(F.lit, MATCHES)), F.col("matched_by"))
    best = direct.unionByName(coded).unionByName(alike).groupBy(by, "node_id").agg(F.min_by(F.struct("semantic_id", "matched_by"), order).alias("m")).select(by, "node_id", "m.*")
    return n.join(best, [by, "node_id"], "left").join(s.select(by, "semantic_id", "semantic_content", "semantic_type"), [by, "semantic_id"], "left")


def enrich_nodes(nodes: DataFrame, semantic: DataFrame, by: str, least: float = 0.72, small: int = 64) -> DataFrame:
    """(by, node_id, matched_by, semantic_id, node_type, content): each node with the longer content and the type of its best semantic node.

    nodes(by, node_id, node_type, content) unique by node_id, semantic(by, semantic_id, semantic_type, semantic_content), ids as text. Of semantic nodes with the
    same id the longest counts. A node takes the one with its id; else, of those with its step code, a compatible, then the longest one; else the
    one whose words it shares most, ``least`` of the smaller set at least; ties go to the smallest id. Which one an earlier node took plays no part. Candidates by words
    of a graph with more than ``small`` semantic nodes meet on the rarest words of either side, enough of them that no pair above the threshold is missed. The semantic
    nodes of other graphs go along as a list, so that each node is compared with them in its row.
    """
    longest = F.struct(F.length("semantic_content"), F.col("semantic_content"), F.col("semantic_type"))
    s = semantic.where("semantic_id is not null").fillna("", ["semantic_content", "semantic_type"]).groupBy(by, "semantic_id").agg(F.max_by(F.struct("semantic_content", "semantic_type"), longest).alias("x")).select(by, "semantic_id", "x.*")
    code = lambda c: F.regexp_extract(c, STEP_CODE, 1)
    words = lambda c: F.array_distinct(T.tokens(F.regexp_replace(c, r"^\d+(\.\d+)*[.)]?\s*", "")))
    n = nodes.fillna("", ["content", "node_type"]).withColumn("code", code("content")).withColumn("nw", words(F.col("content")))
    s = s.withColumn("s_code", code("semantic_content")).withColumn("sw", words(F.col("semantic_content")))
    large = semantic.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") > small).select(by)
    if large.isEmpty():
        x = _best_in_lists(n, s, by, least)
    else:
        few = _best_in_lists(n.join(large, by, "left_anti"), s.join(large, by, "left_anti"), by, least)
        x = few.unionByName(_best_by_joins(n.join(large, by, "left_semi"), s.join(large, by, "left_semi"), by, least).select(few.columns))
    longer = F.length("semantic_content") > F.length("content")
    kind = F.when(F.col("semantic_type").isin("decision", "start", "end"), F.col("semantic_type")).when(F.col("semantic_type").isin(*GRAPH_TYPES), "action").when(F.coalesce("semantic_type", F.lit("")) != "", "annotation")
    return x.select(by, "node_id", F.coalesce("matched_by", F.lit("")).alias("matched_by"), "semantic_id", F.coalesce(kind, F.nullif("node_type", F.lit("")), F.lit("action")).alias("node_type"), F.when(longer, F.col("semantic_content")).otherwise(F.col("content")).alias("content"))


def review_candidates(candidates: DataFrame, by: str) -> DataFrame:
    """``candidates`` with reviewable, selected and the number of candidates of their document.

    candidates(by, candidate_id, flow, nodes, edges, score). Selected is the reviewable one of highest flow, then most edges, nodes and score (null: 0), ties to the smallest id;
    a document without a reviewable one selects none. One aggregation, joined back, so that a document with many candidates isn't sorted.
    """
    rank = F.lit(0)
    for flow, place in FLOW_PRIORITY.items():
        rank = F.when(F.col("flow") == flow, place).otherwise(rank)
    fit = F.coalesce((F.col("flow") != UNREVIEWABLE_FLOW), F.lit(True)) & (F.coalesce("nodes", F.lit(0)) >= MIN_NODES) & (F.coalesce("edges", F.lit(0)) >= MIN_EDGES)
    c = candidates.withColumn("reviewable", fit)
    order = F.struct(-rank, -F.col("edges"), -F.col("nodes"), -F.coalesce("score", F.lit(0.0)), F.col("candidate_id"))
    best = c.groupBy(by).agg(F.min_by("candidate_id", F.when(F.col("reviewable"), order)).alias("__best"), F.count("*").alias("candidate_count")).withColumnRenamed(by, "__by")
    return c.join(best, F.col(by).eqNullSafe(F.col("__by"))).withColumn("selected", F.coalesce(F.col("candidate_id") == F.col("__best"), F.lit(False))).drop("__by", "__best")


# Unit types of semantic nodes, and the text of an annotation that is only a mark such as (a1).
CANDIDATE_UNITS = {
    "start": "candidate_action", "end": "candidate_action", "action": "candidate_action", "decision": "candidate_decision", "annotation": "candidate_annotation",
    "warning": "candidate_warning", "sla_rule": "candidate_sla", "audit_rule": "candidate_audit_rule", "queue_rule": "candidate_queue_rule", "macro_script": "macro_script",
}
MARK_ONLY = r"(?i)^\s*\([a-z0-9*]{1,4}\)\s*$"


def semantic_candidates(nodes: DataFrame, uncertain: DataFrame, by: str) -> DataFrame:
    """(by, semantic_id, unit_type, heading, content, uncertain_edges): a unit for review from each semantic node or annotation.

    nodes(by, semantic_id, semantic_type, title, content), uncertain(by, from_node, to_node), whose edges are counted at either end, a loop once. A null type is an action, an unknown
    one too; start, end, nodes without text and annotations that are only a mark give no unit; headings are cut to 180 characters.
    """
    ends = uncertain.select(by, F.explode(F.array_distinct(F.array("from_node", "to_node"))).alias("semantic_id"))
    touched = ends.groupBy(by, "semantic_id").agg(F.count("*").alias("uncertain_edges"))
    given = F.coalesce("semantic_type", F.lit("action"))
    kind = F.lit("candidate_action")
    for name, unit in CANDIDATE_UNITS.items():
        kind = F.when(given == name, unit).otherwise(kind)
    text = F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.nullif(F.trim("title"), F.lit("")))
    u = nodes.where(~given.isin("start", "end")).withColumn("unit_type", kind).withColumn("heading", F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), text), 1, 180)).withColumn("content", text)
    u = u.where(F.col("content").isNotNull() & ~((F.col("unit_type") == "candidate_annotation") & F.regexp_like("content", F.lit(MARK_ONLY))))
    return u.join(touched, [by, "semantic_id"], "left").fillna(0, ["uncertain_edges"]).select(by, "semantic_id", "unit_type", "heading", "content", "uncertain_edges")

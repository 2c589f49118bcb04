"""Diagram layouts and workflow graphs as evidence elements and retrieval units."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import spatial

# Unit type of a node by words of its text, first match first, and the confidences given where a source has none.
SLA_PATTERN = r"\bsla\b|\b\d+ (phut|gio)\b"
NODE_WORDS = {"routing_rule": ["queue", "chuyen case"], "handoff_rule": ["goi ra", "call in app", "lien he"]}
WARNINGS = ["warning", "audit_rule"]
NODE_CONFIDENCE, EDGE_CONFIDENCE, BARE_EDGE_CONFIDENCE = 0.75, 0.72, 0.45
ANNOTATION_LIMIT, RELATION_LIMIT = 0.78, 0.9


def layout_elements(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """(by, kind, element_id, text, source_id, target_id, condition, confidence, missing_evidence) of nodes, edges and the flows between known nodes.

    nodes(by, node_id, title, confidence), edges(by, edge_id, from_node, to_node, condition, confidence, has_source); an empty or null title
    becomes the node's id, a null or blank condition ``next``, a null confidence the value for its kind. An edge to an unknown node stays an
    element and gives no flow. Null graphs or node ids meet nothing; repeated edges stay apart by edge_id.
    """
    none = F.lit(None).cast("string")
    name = F.concat(F.lit("graph_node_"), F.col("node_id").cast("string"))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("node_id").cast("string"))
    drawn = nodes.select(
        by, F.lit("graph_node").alias("kind"), name.alias("element_id"), title.alias("text"), none.alias("source_id"), none.alias("target_id"), none.alias("condition"),
        F.coalesce("confidence", F.lit(NODE_CONFIDENCE)).alias("confidence"), F.lit(False).alias("missing_evidence"),
    )
    condition = F.coalesce(F.nullif(F.lower(F.trim("condition")), F.lit("")), F.lit("next"))
    sure = F.coalesce("confidence", F.when(F.col("has_source"), EDGE_CONFIDENCE).otherwise(BARE_EDGE_CONFIDENCE))
    e = edges.select(
        by, "from_node", "to_node", F.concat(F.lit("graph_edge_"), F.col("edge_id").cast("string")).alias("element_id"), condition.alias("condition"),
        sure.alias("confidence"), (~F.coalesce("has_source", F.lit(False))).alias("missing_evidence"),
    )
    shown = F.concat(F.col("from_node").cast("string"), F.lit(" --"), F.col("condition"), F.lit("--> "), F.col("to_node").cast("string"))
    lines = e.select(by, F.lit("graph_edge").alias("kind"), "element_id", shown.alias("text"), none.alias("source_id"), none.alias("target_id"), "condition", "confidence", "missing_evidence")
    ids = nodes.select(by, "node_id", name.alias("element")).distinct()
    a, b = (ids.withColumnsRenamed({"node_id": f"{end}_node", "element": f"{end}_id"}) for end in ("from", "to"))
    met = e.join(a, [by, "from_node"]).join(b, [by, "to_node"])
    flows = met.select(by, F.lit("flows_to").alias("kind"), F.concat(F.lit("flows_to_"), "element_id").alias("element_id"), none.alias("text"), F.col("from_id").alias("source_id"), F.col("to_id").alias("target_id"), "condition", "confidence", "missing_evidence")
    return drawn.unionByName(lines).unionByName(flows)


def node_unit_type(node_type: Column, text: Column, sla: str = SLA_PATTERN, words: dict[str, list[str]] | None = None) -> Column:
    """Unit type of a workflow node: decision, then time limits, then words of its normalised text."""
    plain = T.normalize_phrase(text)
    kind = F.when(node_type == "decision", "decision_point").when(F.regexp_like(plain, F.lit(sla)), "sla_rule")
    for name, found in (words or NODE_WORDS).items():
        kind = kind.when(T.contains_any(plain, found), name)
    return kind.otherwise("workflow_step")


def atomic_graph_units(nodes: DataFrame, annotations: DataFrame, relations: DataFrame, by: str, sla: str = SLA_PATTERN, words: dict[str, list[str]] | None = None) -> DataFrame:
    """(by, retrieval_scope, source_key, unit_type, title, content, confidence): every node, annotation and relation of a graph as a unit of its own.

    nodes(by, node_id, node_type, title, content, confidence), annotations(by, annotation_id, kind, title, content, confidence),
    relations(by, relation_id, target_title, evidence, confidence). Start and end nodes and nodes without text give no unit; an annotation's
    and a relation's confidence is bounded; titles are cut to 180 characters. No graph is cut to a number of units.
    """
    content = F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.nullif(F.trim("title"), F.lit("")))
    row = lambda scope, key, kind, title, text, sure: (by, F.lit(scope).alias("retrieval_scope"), F.col(key).cast("string").alias("source_key"), kind.alias("unit_type"), F.substring(title, 1, 180).alias("title"), text.alias("content"), sure.alias("confidence"))
    steps = nodes.where(~F.coalesce(F.col("node_type").isin("start", "end"), F.lit(False))).withColumn("content", content).where("content is not null")
    kind = node_unit_type(F.col("node_type"), F.concat_ws(" ", "title", "content"), sla, words)
    units = steps.select(*row("unit", "node_id", kind, F.coalesce(F.nullif("title", F.lit("")), "content"), F.col("content"), F.col("confidence")))
    note = F.when(F.col("kind").isin(*WARNINGS), "warning").otherwise("operational_note")
    notes = annotations.select(*row("annotation", "annotation_id", note, F.coalesce(F.nullif("title", F.lit("")), F.lit("Workflow note")), F.coalesce("content", F.lit("")), F.least("confidence", F.lit(ANNOTATION_LIMIT))))
    target = F.coalesce(F.nullif("target_title", F.lit("")), F.lit("Related document"))
    links = relations.select(*row("relation", "relation_id", F.lit("related_document"), target, F.coalesce(F.nullif("evidence", F.lit("")), F.concat(F.lit("Related document: "), target)), F.least("confidence", F.lit(RELATION_LIMIT))))
    return units.unionByName(notes).unionByName(links)


# Types that annotate instead of being nodes, and confidences by origin.
ANNOTATION_TYPES = ["annotation", "warning", "audit_rule", "macro_script"]
ORIGIN_CONFIDENCE = {"node": 0.55, "text_block": 0.56, "annotation": 0.58}


def semantic_nodes(nodes: DataFrame, blocks: DataFrame, by: str, types: tuple[tuple[str, str], ...], other: Column, normalize: Callable[[Column], Column], least_share: float = 0.5, cell: float = 64.0) -> DataFrame:
    """(by, semantic_id, semantic_type, key, origin, is_annotation, confidence): the drawn nodes, and the text blocks that no node stands for.

    nodes and blocks(by, block_id, text, box; area, if corners don't give it exactly). A block goes if a node of its page has the same normalised text, or covers ``least_share`` of the block's box
    (found over a grid). ``types`` are (type, pattern) in order, ``other`` the type of the rest. Blank texts give nothing; null or flat boxes cover nothing.
    """
    kind = F.coalesce(*(F.when(F.col("text").rlike(p), F.lit(t)) for t, p in types), other)
    typed = lambda df: df.where("trim(text) <> ''").select(by, "block_id", "box", *(c for c in df.columns if c == "area"), normalize(F.col("text")).alias("key"), kind.alias("semantic_type"))
    drawn, loose = typed(nodes), typed(blocks)
    loose = spatial.uncovered(loose.join(drawn.select(by, "key").distinct(), [by, "key"], "left_anti"), drawn, by, "block_id", least_share, cell)
    every = drawn.withColumn("origin", F.lit("node")).unionByName(loose.select(*drawn.columns).withColumn("origin", F.lit("text_block")))
    note = F.col("semantic_type").isin(ANNOTATION_TYPES)
    confidence = F.when(F.col("origin") == "node", ORIGIN_CONFIDENCE["node"]).when(note, ORIGIN_CONFIDENCE["annotation"]).otherwise(ORIGIN_CONFIDENCE["text_block"])
    return every.select(by, F.concat(F.lit("sem_"), F.col("block_id").cast("string")).alias("semantic_id"), "semantic_type", "key", "origin", note.alias("is_annotation"), confidence.alias("confidence"))

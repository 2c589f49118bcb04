"""Index workbooks: rows of sheets as a plan of candidates, relations and units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.ordering import position

# What the rows of a kind of sheet become and how they relate to their target.
CANDIDATE_TYPES = {
    "tool_directory": "tool_link",
    "cross_audience_issue_router": "issue_router_unit",
    "driver_cleaner_issue_router": "issue_router_unit",
    "rider_issue_router": "issue_router_unit",
    "cleaner_issue_router": "issue_router_unit",
    "merchant_issue_router": "issue_router_unit",
    "vip_overlay_policy": "vip_overlay_rule",
    "product_update_index": "product_update_note",
}
REQUIRING = ["issue_router_unit", "vip_overlay_rule"]
BUCKETS = {"tool_link": "tool_links", "sop_reference": "sop_references"}
SOP_INDEXES = ["core_sop_index", "general_sop_index", "collection_summary"]
URL = r"(?i)(https?://|www\.)[^\s)]+"
UNIT_ORDER = ["collections", "issue_router_units", "sop_references", "tool_links"]


def _chosen(c: Column, found: dict[str, str], otherwise: str) -> Column:
    return reduce(lambda w, kv: w.when(c == kv[0], kv[1]), found.items(), F.when(F.lit(False), "")).otherwise(otherwise)


def index_plan(rows: DataFrame, kinds: dict[str, tuple[str, str]], target_header: str = "sop", actions: dict[str, list[str]] | None = None, default_collection: str = "core") -> DataFrame:
    """One candidate per non-blank row: workbook, sheet, row, bucket, collection, candidate_type, title, content, target_title, relation_type, url, action.

    rows(workbook, sheet, row, headers, values), row unique in its workbook; ``kinds`` gives the kind and collection of a normalised sheet name,
    other sheets are for review and become references. The title is the first value that is neither a link nor a running number, else the first
    value; the target is the value under the first header that contains ``target_header``, and in an index of documents the title
    itself. ``actions`` gives words of an action, first match first; only routers have one. Null cells are blank; a null sheet is unknown.
    """
    name = T.normalize_phrase(F.col("sheet"))
    kind = _chosen(name, {k: v[0] for k, v in kinds.items()}, "review_required")
    cells = F.arrays_zip("headers", "values")
    filled = F.filter(F.transform(cells, lambda x: F.struct(F.coalesce(x["headers"], F.lit("")).alias("h"), F.trim(F.coalesce(x["values"], F.lit(""))).alias("v"))), lambda x: x["v"] != "")
    first = lambda found: F.try_element_at(found, F.lit(1))["v"]
    own = F.filter("cells", lambda x: ~F.regexp_like(x["v"], F.lit(URL)) & ~T.normalize_key(x["h"]).isin("stt", "no", "no_"))
    under = F.filter("cells", lambda x: F.contains(T.normalize_key(x["h"]), F.lit(target_header)))
    given = first(under)
    target = F.when(T.normalize_key(given).isin("", "link", "sop"), None).otherwise(given)
    low = T.normalize_phrase(F.col("content"))
    action = reduce(lambda w, kv: w.when(T.contains_any(low, kv[1]), kv[0]), (actions or {}).items(), F.when(F.lit(False), ""))
    p = rows.select("workbook", "sheet", "row", kind.alias("kind"), _chosen(name, {k: v[1] for k, v in kinds.items()}, default_collection).alias("collection"), filled.alias("cells"))
    p = p.where(F.size("cells") > 0).withColumn("title", F.substring(F.coalesce(first(own), first(F.col("cells"))), 1, 180))
    p = p.withColumn("content", F.array_join(F.transform("cells", lambda x: F.concat(x["h"], F.lit(": "), x["v"])), "\n"))
    p = p.withColumn("candidate_type", _chosen(F.col("kind"), CANDIDATE_TYPES, "sop_reference"))
    related = F.when(F.col("candidate_type") != "tool_link", F.coalesce(target, F.when(F.col("kind").isin(*SOP_INDEXES), F.col("title"))))
    return p.select(
        "workbook", "sheet", "row", _chosen(F.col("candidate_type"), BUCKETS, "issue_router_units").alias("bucket"), "collection", "candidate_type", "title", "content",
        related.alias("target_title"), F.when(related.isNotNull(), F.when(F.col("candidate_type").isin(*REQUIRING), "requires").otherwise("references")).alias("relation_type"),
        F.nullif(F.regexp_extract("content", URL, 0), F.lit("")).alias("url"), F.when(F.col("candidate_type") == "issue_router_unit", action).alias("action"),
    )


def plan_relations(plan: DataFrame, titles: DataFrame) -> DataFrame:
    """The plan's relations with the target_id of titles(title, target_id) that exactly one target has, and their status."""
    unique = titles.groupBy(T.normalize_phrase(F.col("title")).alias("__key")).agg(F.count("*").alias("__n"), F.first("target_id").alias("target_id")).where("__n = 1").drop("__n")
    asked = plan.where("target_title is not null").select("workbook", "sheet", "row", "target_title", "relation_type", "url", T.normalize_phrase(F.col("target_title")).alias("__key"))
    return asked.join(unique, "__key", "left").drop("__key").withColumn("status", F.when(F.col("target_id").isNull(), "unresolved").otherwise("resolved"))


def plan_units(plan: DataFrame) -> DataFrame:
    """(workbook, chunk_index, section, heading, content): the workbook's summary, its collections, its candidates and, after a router, its action.

    Numbers come from ``position``, so that a workbook with most of the rows isn't sorted in one task.
    """
    place = lambda bucket: F.array_position(F.array(*map(F.lit, UNIT_ORDER)), bucket).cast("long") * F.lit(1 << 40)
    unit = lambda order, section, heading, content: ("workbook", order.cast("long").alias("__order"), section.alias("section"), heading.alias("heading"), content.alias("content"))
    counts = plan.groupBy("workbook").agg(F.countDistinct("collection").alias("n"), *(F.count_if(F.col("bucket") == b).alias(b) for b in UNIT_ORDER[1:]), F.count("action").alias("a"))
    lines = [("Collections", "n"), ("Issue router units", "issue_router_units"), ("SOP references", "sop_references"), ("Tool links", "tool_links"), ("Actions", "a")]
    summary = F.concat_ws("\n", "workbook", *(F.concat(F.lit(f"{t}: "), F.col(c).cast("string")) for t, c in lines))
    whole = counts.select(*unit(F.lit(0), F.lit("full_sop"), F.col("workbook"), summary))
    groups = plan.groupBy("workbook", "collection").agg(F.min("row").alias("row"))
    collections = groups.select(*unit(place(F.lit("collections")) + F.col("row") * 2, F.lit("text_section"), F.col("collection"), F.col("collection")))
    at = place(F.col("bucket")) + F.col("row") * 2
    candidates = plan.select(*unit(at, F.col("candidate_type"), F.col("title"), F.col("content")))
    acted = plan.where("action is not null").select(*unit(at + 1, F.lit("quick_action_rule"), F.col("action"), F.concat(F.col("action"), F.lit(": "), F.col("title"))))
    parts = whole.unionByName(collections).unionByName(candidates).unionByName(acted)
    return position(parts, ["workbook"], "__order", "__n").select("workbook", (F.col("__n") - 1).alias("chunk_index"), "section", "heading", "content")

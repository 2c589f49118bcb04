"""Evidence: locators, gates on them, validators, elements matched to chunks.

A locator array ``refs`` holds structs with the fields of REF; fields that don't apply are null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

REF = "page int, bbox array<double>, sheet string, row_start int, cell_ref string, table_index int, row_index int, paragraph_index int, line_start int, block_id string"
#: Locator classes from the most to the least exact.
QUALITIES = ("bbox", "sheet_row", "table_row", "paragraph_only", "line_span", "page_only", "structured", "none")


def ref(**fields: Column) -> Column:
    """One locator; fields that aren't given are null."""
    kinds = dict(f.strip().split(" ", 1) for f in REF.split(", "))
    return F.struct(*((fields[k] if k in fields else F.lit(None)).cast(v).alias(k) for k, v in kinds.items()))


def _any(refs: Column, test) -> Column:
    return F.coalesce(F.exists(F.coalesce(refs, F.array().cast(f"array<struct<{REF.replace(' ', ':').replace(',:', ',')}>>")), test), F.lit(False))


def has_page_bbox(refs: Column) -> Column:
    """Whether some locator has a page and a box of four numbers with an area."""
    return _any(refs, lambda r: (r["page"] > 0) & (F.size(r["bbox"]) >= 4) & (r["bbox"][2] != r["bbox"][0]) & (r["bbox"][3] != r["bbox"][1]))


def ref_quality(refs: Column) -> Column:
    """The most exact class that some locator has."""
    tests = {
        "bbox": lambda r: F.size(r["bbox"]) > 0,
        "sheet_row": lambda r: r["sheet"].isNotNull() & (r["row_start"].isNotNull() | r["cell_ref"].isNotNull()),
        "table_row": lambda r: r["table_index"].isNotNull() & r["row_index"].isNotNull(),
        "paragraph_only": lambda r: r["paragraph_index"].isNotNull(),
        "line_span": lambda r: r["line_start"].isNotNull(),
        "page_only": lambda r: r["page"].isNotNull(),
    }
    ladder = F.when(F.coalesce(F.size(refs), F.lit(0)) < 1, "none")
    for name, test in tests.items():
        ladder = ladder.when(_any(refs, test), name)
    return ladder.otherwise("structured")


def ranking_ref_quality(refs: Column) -> Column:
    return F.when(_any(refs, lambda r: r["table_index"].isNotNull() & r["row_index"].isNotNull()), "table_row").when(_any(refs, lambda r: F.size(r["bbox"]) >= 4), "bbox").when(_any(refs, lambda r: r["block_id"].isNotNull()), "block_id").when(_any(refs, lambda r: r["paragraph_index"].isNotNull()), "paragraph_only").otherwise("none")


def required_ref(kind: Column, refs: Column) -> Column:
    """Whether the locators are what the document kind needs; kinds without a need always pass."""
    row = lambda r: r["table_index"].isNotNull() & r["row_index"].isNotNull()
    return F.when(kind == "policy_table", _any(refs, lambda r: r["sheet"].isNotNull() | row(r))).when(kind == "kb_index_workbook", _any(refs, lambda r: r["sheet"].isNotNull() & r["row_start"].isNotNull())).when(kind == "workflow_diagram", _any(refs, lambda r: r["page"].isNotNull())).when(kind == "policy_rule", _any(refs, lambda r: r["paragraph_index"].isNotNull() | r["line_start"].isNotNull() | r["page"].isNotNull() | row(r))).otherwise(True)


def indexable(unit: Column, review: Column, extraction: Column, blocked: Column, refs: Column, visual: tuple[str, ...]) -> Column:
    """Approved, structured, not blocked; never evidence-only or candidate units; visual units need a page box."""
    ok = (unit != "") & ~unit.isin("source_evidence_section", "visual_source_block") & ~unit.startswith("candidate_")
    ok = ok & (review == "approved") & extraction.isin("structured", "manually_curated") & ~F.coalesce(blocked, F.lit(False))
    return F.coalesce(ok & (~unit.isin(*visual) | has_page_bbox(refs)), F.lit(False))


def effective_heading(heading: Column, content: Column, stop: tuple[str, ...]) -> Column:
    """'' for step numbers, for headings that the content begins with, and for stop words; else the heading."""
    h = F.trim(F.coalesce(heading, F.lit("")))
    plain, body = T.normalize_text(h), T.normalize_text(F.coalesce(content, F.lit("")))
    return F.when(h.rlike(r"^\d{1,3}(\.\d{1,3})*\.?$"), "").when((F.length(h) > 7) & F.startswith(body, plain), "").when(plain.isin(*stop), "").otherwise(F.coalesce(heading, F.lit("")))


def worst_quality(df: DataFrame, key: str, quality: str) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, QUALITIES)), F.col(quality))
    return df.groupBy(key).agg(F.max_by(quality, place).alias("worst"), F.min_by(quality, place).alias("best"))


def match_elements(chunks: DataFrame, elements: DataFrame, doc: str) -> DataFrame:
    """(doc, chunk_id, element_id, tier) of elements that a chunk stands on.

    Tier 1: the element's line lies in the chunk's line range; tier 2, for chunks without tier 1: one text contains the other. Both meet
    on the document, the first also on buckets of 64 lines, so that a long document's lines and chunks aren't all paired.
    """
    c = chunks.select(doc, "chunk_id", "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / 64), F.floor(F.col("line_end") / 64))).alias("b"))
    e = elements.select(doc, "element_id", "line", F.floor(F.col("line") / 64).alias("b"))
    first = c.join(e, [doc, "b"]).where("line between line_start and line_end").select(doc, "chunk_id", "element_id", F.lit(1).alias("tier"))
    rest = chunks.join(first.select(doc, "chunk_id").distinct(), [doc, "chunk_id"], "left_anti").select(doc, "chunk_id", "content")
    second = rest.join(elements.select(doc, "element_id", "text"), doc).where(F.contains("content", F.col("text")) | F.contains("text", F.col("content"))).select(doc, "chunk_id", "element_id", F.lit(2).alias("tier"))
    return first.unionByName(second)


def violations(df: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """(code, id) rows of every rule that a row breaks."""
    return df.select(F.explode(F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules.items())))).alias("code"), key.alias("id"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)

"""Policy units of a document's blocks: nested sections, typed units, their groups, channels and risk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import running_max
from corpusloom.sources.scratch import written

DOCUMENT = "full_sop"
LEVELS = ["low", "medium", "high", "critical"]
# Signals of risk as (pattern, level, category), the category of the first that is met holds; categories of things not to be told.
RISK_SIGNALS = (
    ("quy trinh xu ly noi bo", "critical", "internal_process_disclosure"),
    ("tuyet doi khong", "critical", "prohibited_disclosure"),
    ("khong chu dong cung cap", "high", "disclosure_control"),
    ("che tai(?=.*khong (cung cap|chu dong))|khong (cung cap|chu dong).*che tai", "critical", "sanction_disclosure"),
    ("che tai", "high", "sanction_disclosure"),
    ("cham loi", "high", "qa_compliance"),
)
NOT_TO_TELL = ("sanction_disclosure", "internal_process_disclosure", "disclosure_control", "prohibited_disclosure")
CHANNELS = (("email", "mail"), ("call", "call|hotline"), ("chat", "chat"))


def fixed_types(text: Column, section: Column, kind: Column) -> list[tuple[str, Column]]:
    """Types of units that carry no risk, by normalised text, section titles and kind of block; the first holds."""
    greeting = text.rlike("xin chao|chao anh|chao chi|quy khach hang") & (text.rlike("email|call|chat") | section.rlike("email|call|chat"))
    return [
        ("wording_rule", text.rlike("xin loi|rat tiec|mong quy khach thong cam") | section.rlike("xin loi")),
        ("example", text.rlike("vi du|vd|example")),
        ("operational_note", text.rlike("^(luu y|note|ghi chu|chi dung|chi su dung|only use)")),
        ("macro_script", greeting),
        ("handling_rule", (kind == "list_item") | text.rlike("cs |khong |can |phai |doi voi|truong hop|neu ")),
    ]


@dataclass(frozen=True)
class SectionRules:
    """Patterns over normalised text. types: (text, section titles, kind) to (unit type, condition) in order; groups: what a unit of that type must have to
    be grouped within its section, or within its list where the block names one; condition: three groups, the condition, a separator and the action; signs: what all these
    patterns need of a normalised text, such as the words they look for. Patterns are tried on that alone, and it goes through the shuffle instead of the text."""

    risk: tuple[tuple[str, str, str], ...] = RISK_SIGNALS
    not_to_tell: tuple[str, ...] = NOT_TO_TELL
    types: Callable[[Column, Column, Column], list[tuple[str, Column]]] = fixed_types
    channels: tuple[tuple[str, str], ...] = CHANNELS
    groups: tuple[tuple[str, str], ...] = (("wording_rule", "xin loi|rat tiec|wording|mau cau"), ("handling_rule", "neu |truong hop|chua |da |already|not yet"), ("compliance_rule", ""))
    condition: str = "(?i)^(neu .*?)(\\s*:\\s*|\\s*=>\\s*|\\s*->\\s*| thi )(.*)$"
    signs: Callable[[Column], Column] = lambda text: text
    levels: int = 6


def open_sections(blocks: DataFrame, doc: str, index: str, level: str, title: str, levels: int = 6) -> DataFrame:
    """Adds ``path``: indexes and titles of the headings that are open at each block, outermost first, a heading's own included.

    A heading of level k is open until the next one of level k or less. The last heading of each level is a running maximum of its index, so a
    nesting stack needs no walk; levels outside 1 .. ``levels`` are taken as the nearest of them.
    """
    own = F.when(F.col(level).isNotNull(), F.least(F.greatest(F.col(level), F.lit(1)), F.lit(levels)))
    last = {f"__h{k}": F.when(own == k, F.struct(F.col(index).alias("index"), F.col(title).alias("title"))) for k in range(1, levels + 1)}
    seen = running_max(blocks, [doc], index, last)
    path, above = [], F.lit(None).cast("long")
    for k in range(1, levels + 1):
        at = F.col(f"__h{k}.index").cast("long")
        path.append(F.when(above.isNull() | (at > above), F.col(f"__h{k}")))
        above = F.greatest(above, at)
    return seen.withColumn("path", F.array_compact(F.array(*path))).drop(*last)


def _risk(text: Column, rules: SectionRules) -> tuple[Column, Column]:
    """(place of the level, category) of a text."""
    place = F.greatest(F.lit(0), F.lit(0), *(F.when(text.rlike(p), LEVELS.index(x)).otherwise(0) for p, x, _ in rules.risk))
    return place, F.coalesce(*(F.when(text.rlike(p), F.lit(c)) for p, _, c in rules.risk), F.lit(""))


def _channels(text: Column, rules: SectionRules) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(c)) for c, p in rules.channels)))


def sectioned_units(blocks: DataFrame, doc: str, normalize: Callable[[Column], Column], rules: SectionRules = SectionRules()) -> DataFrame:
    """(doc, unit_id, chunk_type, unit_type, parent_unit_id, section, channels, risk_level, risk_category, first_index, n_children, condition, action).

    blocks(doc, index, level, kind, list_group, text): headings have a level, others none; (doc, index) is unique. Rows are the document, its sections (equal title paths
    are one), groups of two or more like units of a section, and every typed block. A unit's parent is its group, else its section, else the document; a
    section's parent is the section of the path above it. Channels come from titles and text, else from the whole document; risk of a section or
    group is the worst of its units. Null or blank texts give no unit; an empty table gives no rows.
    """
    step = lambda k: F.nullif(F.trim(F.regexp_extract("text", rules.condition, k)), F.lit(""))
    # What depends on the text alone is found first, so that only headings' texts go through the windows.
    plain = blocks.where("trim(text) <> ''").withColumn("plain", normalize(F.col("text"))).withColumn("plain", rules.signs(F.col("plain")))
    risk, category = _risk(F.col("plain"), rules)
    grouped = F.array_compact(F.array(*(F.when(F.lit(p == "") | F.col("plain").rlike(p or "^"), F.lit(t)) for t, p in rules.groups)))
    read = plain.withColumns({"risk": risk, "category": category, "said": _channels(F.col("plain"), rules), "groupable": grouped, "condition": step(1), "action": step(3), "title": F.when(F.col("level").isNotNull(), F.col("text"))}).drop("text")
    placed = open_sections(read, doc, "index", "level", "title", rules.levels)
    titles = placed.withColumn("titles", F.transform("path", lambda p: F.trim(p["title"])))
    named = titles.withColumns({"section": F.array_join("titles", " > "), "above": F.array_join(F.slice("titles", 1, F.greatest(F.size("titles") - 1, F.lit(0))), " > ")}).withColumn("head", normalize(F.col("section"))).withColumn("head", rules.signs(F.col("head")))
    kinds = F.coalesce(F.when(F.col("risk") >= LEVELS.index("high"), F.when(F.col("category").isin(*rules.not_to_tell), "compliance_rule").otherwise("warning")), *(F.when(hit, F.lit(t)) for t, hit in rules.types(F.col("plain"), F.col("head"), F.col("kind"))))
    typed = named.withColumn("unit_type", F.when(F.col("level").isNull(), kinds)).withColumn("own", _channels(F.concat_ws(" ", "head", "plain"), rules))
    kept = written(typed.select(doc, "index", "list_group", "section", "above", "risk", "category", "unit_type", "own", "said", "groupable", "condition", "action"), "blocks")
    of_doc = kept.groupBy(doc).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("said")))).alias("doc_channels"), F.max("risk").alias("risk"), F.min("index").alias("first_index"), F.count("unit_type").alias("units"))

    # A block's group: its list's, or its section's.
    can = F.when(F.array_contains("groupable", F.col("unit_type")), F.col("unit_type"))
    scope = F.when(F.col("unit_type") == "handling_rule", F.coalesce(F.col("list_group").cast("string"), "section")).otherwise(F.col("section"))
    units = kept.where("unit_type is not null").withColumn("grouped", can).withColumn("scope", F.when(can.isNotNull(), scope))
    id_of = lambda prefix, *parts: F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 16))
    groups = units.where("grouped is not null").groupBy(doc, "grouped", "scope").agg(F.count("*").alias("n"), F.min("index").alias("first_index"), F.max("risk").alias("risk"), F.min_by("section", "index").alias("section"), F.min_by("category", F.struct(F.col("category") == "", "index")).alias("category"), F.flatten(F.collect_set("own")).alias("own")).where("n > 1")
    sections = kept.where("section <> ''").groupBy(doc, "section", "above").agg(F.min("index").alias("first_index"), F.max("risk").alias("risk"), F.count("unit_type").alias("n"), F.flatten(F.collect_set("own")).alias("own"))

    section_id = F.when(F.col("section") == "", F.lit(DOCUMENT)).otherwise(id_of("section_", F.col("section")))
    above_id = F.when(F.col("above") == "", F.lit(DOCUMENT)).otherwise(id_of("section_", F.col("above")))
    group_id = id_of("group_", F.col("grouped"), F.col("scope"))
    none = F.lit(None).cast("string")
    met = units.join(groups.select(doc, "grouped", "scope", F.lit(True).alias("in_group")), [doc, "grouped", "scope"], "left")
    rows = met.select(doc, F.concat(F.lit("unit_"), F.col("index").cast("string")).alias("unit_id"), F.lit("atomic_child").alias("chunk_type"), "unit_type", F.when(F.col("in_group"), group_id).otherwise(section_id).alias("parent_unit_id"), "section", "own", "risk", "category", F.col("index").alias("first_index"), F.lit(0).cast("long").alias("n_children"), "condition", "action")
    rows = rows.unionByName(groups.select(doc, group_id.alias("unit_id"), F.lit("grouped_parent").alias("chunk_type"), F.col("grouped").alias("unit_type"), section_id.alias("parent_unit_id"), "section", "own", "risk", "category", "first_index", F.col("n").alias("n_children"), none.alias("condition"), none.alias("action")))
    rows = rows.unionByName(sections.select(doc, section_id.alias("unit_id"), F.lit("parent_section").alias("chunk_type"), F.lit("text_section").alias("unit_type"), above_id.alias("parent_unit_id"), "section", "own", "risk", F.lit("").alias("category"), "first_index", F.col("n").alias("n_children"), none.alias("condition"), none.alias("action")))
    # A document's risk is medium at least.
    whole = of_doc.select(doc, F.lit(DOCUMENT).alias("unit_id"), F.lit("full_sop").alias("chunk_type"), F.lit("full_sop").alias("unit_type"), none.alias("parent_unit_id"), F.lit("").alias("section"), F.col("doc_channels").alias("own"), F.greatest("risk", F.lit(1)).alias("risk"), F.lit("").alias("category"), "first_index", F.col("units").alias("n_children"), none.alias("condition"), none.alias("action"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.col("risk") + 1)
    told = F.when(F.size("own") > 0, F.array_sort(F.array_distinct("own"))).otherwise(F.col("doc_channels"))
    return rows.unionByName(whole).join(of_doc.select(doc, "doc_channels"), doc).select(doc, "unit_id", "chunk_type", "unit_type", "parent_unit_id", "section", F.array_join(told, ",").alias("channels"), level.alias("risk_level"), F.col("category").alias("risk_category"), "first_index", "n_children", "condition", "action")

"""What a reader sees of a hit: its section, why it couldn't be found, and the place to highlight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def display_context(hits: DataFrame, contexts: DataFrame, sections: DataFrame, break_: str = "\n\n") -> DataFrame:
    """(hit_id, status, reason, strategy, start_offset, end_offset, fallback) per hit; offsets from 0, end exclusive.

    hits(hit_id, version_id, section_id, content), contexts(version_id, context_version_id) one per version, sections(version_id, section_id,
    section_text) one per section. A hit is highlighted where it stands literally; else where its words stand in the same order whatever is between them; else on the
    paragraph (parted by ``break_``, the first of the best) that shares enough of its words of over two letters. Normalised
    offsets are given only if taking accents off keeps the section's length. A null or blank hit is unmatched; what isn't matched falls back to its text.
    """
    # What depends on the section alone is made once a section; what a better strategy makes needless is left out.
    ready = sections.select("version_id", "section_id", "section_text", F.lower(T.strip_accents(F.col("section_text"))).alias("plain"), T.normalize_match(F.col("section_text")).alias("flat"), F.split("section_text", break_).alias("ps"))
    ready = ready.withColumn("gaps", F.split("plain", "[a-z0-9]+")).withColumn("pw", F.transform("ps", lambda p: F.split(T.normalize_match(p), " ")))
    h = hits.join(contexts, "version_id", "left").join(ready, ["version_id", "section_id"], "left")
    missing = F.when(F.col("context_version_id").isNull(), F.struct(F.lit("parent_missing").alias("status"), F.lit("display_context_not_loaded").alias("reason"))).when(
        F.col("context_version_id") != F.col("version_id"), F.struct(F.lit("version_mismatch").alias("status"), F.lit("retrieval_version_does_not_match_display_context").alias("reason")),
    ).when(F.col("section_text").isNull(), F.struct(F.lit("parent_missing").alias("status"), F.lit("section_parent_not_found").alias("reason")))
    literal = (F.trim("content") != "") & F.contains("section_text", F.col("content"))
    h = h.withColumn("missing", missing).withColumn("literal", F.coalesce(literal, F.lit(False))).withColumn("words", F.filter(F.split(T.normalize_match(F.col("content")), " "), lambda x: x != ""))
    # Words parted by single blanks hold the hit or not; the lengths of what parts them in the section lead back to its own offsets.
    h = h.withColumn("needle", F.array_join("words", " "))
    h = h.withColumn("found", F.when(~F.col("literal") & F.col("missing").isNull() & (F.size("words") > 0), F.nullif(F.expr("instr(flat, needle)"), F.lit(0)) - 1).cast("int"))

    def original(at):
        words = F.length(F.regexp_replace(F.substring(F.col("flat"), F.lit(1), at), "[^ ]+", ""))
        return at - words + F.length(F.array_join(F.slice("gaps", F.lit(1), words + 1), ""))

    h = h.withColumn("wanted", F.array_distinct(F.filter("words", lambda x: F.length(x) > 2)))
    shared = F.when(~F.col("literal") & F.col("missing").isNull() & F.col("found").isNull(), F.transform("pw", lambda p: F.size(F.array_intersect(F.col("wanted"), p))))
    h = h.withColumn("shared", shared).withColumn("best", F.array_max("shared"))
    h = h.withColumn("p", F.array_position("shared", F.col("best")).cast("int"))
    enough = F.least(F.lit(5), F.greatest(F.lit(2), F.floor((F.size("wanted") + 1) / 2)))
    strategy = F.when(F.col("literal"), "exact").when(F.col("found").isNotNull(), "normalized").when((F.size("wanted") > 0) & (F.col("best") >= enough), "paragraph").otherwise("unmatched")
    h = h.withColumn("strategy", F.when(F.col("missing").isNull(), strategy))
    before = F.when(F.col("p") > 1, F.length(F.array_join(F.slice("ps", F.lit(1), F.greatest(F.col("p") - 1, F.lit(0))), break_)) + len(break_)).otherwise(0)
    same = F.length("plain") == F.length("section_text")
    start = F.when(F.col("strategy") == "exact", F.expr("instr(section_text, content)") - 1).when((F.col("strategy") == "normalized") & same, original(F.col("found"))).when(F.col("strategy") == "paragraph", before)
    last = original(F.col("found") + F.length("needle") - 1) + 1
    end = F.when(F.col("strategy") == "normalized", last).otherwise(F.col("start_offset") + F.when(F.col("strategy") == "exact", F.length("content")).otherwise(F.length(F.try_element_at("ps", "p"))))
    return h.withColumn("start_offset", start.cast("long")).select(
        "hit_id", F.coalesce("missing.status", F.lit("resolved")).alias("status"), F.coalesce("missing.reason", F.lit("")).alias("reason"), "strategy", "start_offset",
        F.when(F.col("start_offset").isNotNull(), end).cast("long").alias("end_offset"), F.when(F.col("missing").isNotNull() | (F.col("strategy") == "unmatched"), F.coalesce("content", F.lit(""))).otherwise("").alias("fallback"),
    )

"""Versions, gates, publication and upserts over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordering import position


def production_gate(v: DataFrame, risk_blocked: str = "high") -> DataFrame:
    """Only published, approved versions that aren't blocked by their risk."""
    return v.where((F.col("status") == "published") & (F.col("review_status") == "approved") & (F.col("risk_level") != risk_blocked))


def facet_filter(df: DataFrame, filters: dict[str, list], arrays: tuple[str, ...] = ()) -> DataFrame:
    """Conjunction of optional facets: an empty list doesn't filter; array columns match on any shared value."""
    for name, values in filters.items():
        if values:
            df = df.where(F.arrays_overlap(F.col(name), F.array(*map(F.lit, values))) if name in arrays else F.col(name).isin(values))
    return df


def payload_filter(df: DataFrame, must: list[Column], must_not: list[Column]) -> DataFrame:
    for c in must:
        df = df.where(c)
    for c in must_not:
        df = df.where(~F.coalesce(c, F.lit(False)))
    return df


def contains_any_or_empty(values: Column, wanted: Column) -> Column:
    return (F.size(wanted) == 0) | F.arrays_overlap(values, wanted)


def append_versions(existing: DataFrame, incoming: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Existing versions and incoming ones, numbered on from each document's largest number in order."""
    most = existing.groupBy(key).agg(F.max(number).alias("__most"))
    new = position(incoming, [key], order, number).join(most, key, "left")
    return existing.unionByName(new.withColumn(number, F.col(number) + F.coalesce("__most", F.lit(0))).drop("__most"))


def replace_units(units: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The units, with those of every version in ``new`` replaced by the new ones."""
    return units.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """A new snapshot: rows of both sides by key, with a rule per column.

    overwrite: the source's value; keep: the target's; keep_if_blank: the source's unless it is null or blank; greatest: the larger.
    """
    t = target.select(*keys, *(F.col(c).alias(f"t_{c}") for c in rules), F.lit(True).alias("__t"))
    s = source.select(*keys, *(F.col(c).alias(f"s_{c}") for c in rules), F.lit(True).alias("__s"))
    made = {
        "overwrite": lambda c: F.when(F.col("__s"), F.col(f"s_{c}")).otherwise(F.col(f"t_{c}")),
        "keep": lambda c: F.when(F.col("__t"), F.col(f"t_{c}")).otherwise(F.col(f"s_{c}")),
        "keep_if_blank": lambda c: F.coalesce(F.when(F.trim(F.col(f"s_{c}").cast("string")) != "", F.col(f"s_{c}")), F.col(f"t_{c}")),
        "greatest": lambda c: F.greatest(F.col(f"s_{c}"), F.col(f"t_{c}")),
    }
    return t.join(s, keys, "full_outer").select(*keys, *(made[r](c).alias(c) for c, r in rules.items()))


def publish(v: DataFrame, requests: DataFrame) -> DataFrame:
    """Publish the requested version per document: the one published before is archived; at most one is published.

    Of several requests for a document the largest version number wins.
    """
    asked = requests.join(v.select("version_id", "document_id", "version_number"), "version_id").groupBy("document_id").agg(F.max_by("version_id", "version_number").alias("__new"))
    status = F.when(F.col("__new") == F.col("version_id"), "published").when(F.col("__new").isNotNull() & (F.col("status") == "published"), "archived").otherwise(F.col("status"))
    return v.join(asked, "document_id", "left").withColumn("status", status).drop("__new")


def mark_indexing(v: DataFrame, results: DataFrame) -> DataFrame:
    """Set published versions to ready or failed by the results of indexing (version_id, ok)."""
    state = F.when(F.col("status") != "published", F.col("status")).when(F.col("ok"), "published_ready").when(~F.col("ok"), "published_indexing_failed").otherwise("published_indexing_pending")
    return v.join(results.select("version_id", "ok"), "version_id", "left").withColumn("publish_state", state).drop("ok")


def governance_failures(v: DataFrame, as_of: str, review_days: int) -> DataFrame:
    """(version_id, code) of missing risk, missing review and overdue review, as of a date."""
    codes = F.array_compact(F.array(F.when(F.col("risk_level") == "", F.lit("risk_missing")), F.when(F.col("review_status") == "needs_review", F.lit("review_missing")), F.when(F.datediff(F.lit(as_of), "last_reviewed_at") > review_days, F.lit("review_overdue"))))
    return v.select("version_id", F.explode(codes).alias("code"))


def publish_readiness(units: DataFrame, v: DataFrame, least_units: int = 1, longest: int = 400) -> DataFrame:
    """(version_id, failure codes joined by a comma) from one pass over each version's units."""
    agg = units.groupBy("version_id").agg(F.count("*").alias("units"), F.count_if(F.length("content") > longest).alias("long_units"), F.countDistinct("content").alias("different"))
    j = v.join(agg, "version_id", "left").fillna(0, ["units", "long_units", "different"])
    codes = F.array_compact(F.array(F.when(F.col("units") < least_units, F.lit("no_units")), F.when(F.col("long_units") > 0, F.lit("oversize_units")), F.when(F.col("different") < F.col("units"), F.lit("duplicate_units")), F.when(F.col("review_status") != "approved", F.lit("not_approved")), F.when(F.col("risk_level") == "high", F.lit("high_risk"))))
    return j.select("version_id", "units", F.array_join(codes, ",").alias("failures"))


def health_score(review: Column, risk: Column, status: Column, stale: Column) -> Column:
    """92 less penalties, held between 28 and 100."""
    raw = F.lit(92) - F.when(review != "approved", 18).otherwise(0) - F.when(risk == "high", 14).otherwise(0) - F.when(status != "published", 10).otherwise(0) - F.when(stale, 12).otherwise(0)
    return F.greatest(F.lit(28), F.least(F.lit(100), raw))

"""Rule-based ranking: query understanding, business scores, gates. Every word list and weight is a parameter."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T

DEFAULTS = {
    "unit_scores": {"rule": 20.0, "procedure": 16.0, "section": 8.0, "document": -60.0},
    "weights": {"phrase": 12.0, "token": 1.5, "title": 6.0, "approved": 4.0, "high_risk": -5.0},
    "blend": {"rule": 0.75, "procedure": 0.55, "default": 0.45},
}


def ranking_config(override: dict | None = None) -> dict:
    """The defaults with nested values of ``override`` in their place."""

    def merge(base: dict, more: dict) -> dict:
        for k, v in more.items():
            base[k] = merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
        return base

    return merge(copy.deepcopy(DEFAULTS), override or {})


def lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(float(default))
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(float(default)))


def rules_frame(spark: SparkSession, rules: dict[str, list[str]]) -> DataFrame:
    """(intent, phrase, priority) rows of a small rule set."""
    return spark.createDataFrame([(k, p, i) for i, (k, ps) in enumerate(rules.items()) for p in ps], "intent string, phrase string, priority int")


def seed_intent(queries: DataFrame, query_id: str, normalized: str, rules: dict[str, list[str]]) -> DataFrame:
    """(query_id, intent, matches): the rule set with most phrases in the query, then the longest phrase, then the first."""
    scored = []
    for i, (name, phrases) in enumerate(rules.items()):
        hits = F.filter(F.array(*map(F.lit, phrases)), lambda p: T.phrase_in(F.col(normalized), p))
        scored.append(F.struct(F.size(hits).alias("matches"), F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0)).alias("longest"), F.lit(-i).alias("order"), F.lit(name).alias("intent")))
    best = F.filter(F.array(F.array_max(F.array(*scored))), lambda b: b["matches"] > 0)
    # A generator, since a filter over the best rule would be computed below the normalised text, which it would take apart once per phrase.
    return queries.select(query_id, F.explode(best).alias("b")).select(query_id, "b.intent", "b.matches")


def intent_terms(queries: DataFrame, query_id: str, normalized: str, rules: dict[str, list[str]]) -> DataFrame:
    """(query_id, intents): every intent of which a phrase occurs, sorted."""
    found = F.array_compact(F.array(*(F.when(T.contains_any(F.col(normalized), ps), F.lit(k)) for k, ps in rules.items())))
    return queries.select(query_id, F.array_sort(found).alias("intents"))


def expand_query(queries: DataFrame, query_id: str, normalized: str, synonyms: DataFrame) -> DataFrame:
    """(query_id, expansions): other terms of every synonym group of which the query holds a term.

    Queries are cut into word sequences as long as the terms are, which meet the terms by an equi-join; their texts go no further.
    """
    terms = synonyms.where("term <> ''")
    lengths = [r.n for r in terms.select(F.size(F.split("term", " ")).alias("n")).distinct().collect()]
    words = queries.select(query_id, F.split(normalized, " ").alias("words"))
    grams = F.flatten(F.array(*(_sequences(F.col("words"), n) for n in sorted(lengths)))) if lengths else F.array().cast("array<string>")
    hit = words.select(query_id, F.explode(F.array_distinct(grams)).alias("term")).join(terms, "term").select(query_id, "group_id", F.col("term").alias("held")).distinct()
    return hit.join(synonyms.select("group_id", F.col("term").alias("other")), "group_id").where("other <> held").groupBy(query_id).agg(F.array_sort(F.collect_set("other")).alias("expansions"))


def _sequences(words: Column, n: int) -> Column:
    """All sequences of n words, joined by blanks; null where the words end first."""
    out = words
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), F.size(words)), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def business_score(df: DataFrame, query_tokens: str, text_tokens: str, query_text: str, text: str, unit: str, approved: Column, high_risk: Column, config: dict | None = None) -> DataFrame:
    """Component columns (score_unit, score_phrase, score_tokens, score_review, score_risk) and their sum business_score."""
    c = ranking_config(config)
    w = c["weights"]
    parts = {
        "score_unit": lookup(c["unit_scores"], F.col(unit), 0.0),
        "score_phrase": F.when(T.phrase_in(F.col(text), F.col(query_text)), w["phrase"]).otherwise(0.0),
        "score_tokens": F.size(F.array_intersect(query_tokens, text_tokens)) * F.lit(w["token"]),
        "score_review": F.when(approved, w["approved"]).otherwise(0.0),
        "score_risk": F.when(high_risk, w["high_risk"]).otherwise(0.0),
    }
    out = df.withColumns(parts)
    return out.withColumn("business_score", sum((F.col(p) for p in parts), F.lit(0.0)))


def blend(business: Column, relevance: Column, unit: Column, config: dict | None = None) -> Column:
    """business * w + relevance * 100 * (1 - w), with a weight per unit type; business alone without a relevance."""
    c = ranking_config(config)["blend"]
    w = lookup({k: v for k, v in c.items() if k != "default"}, unit, c["default"])
    return F.when(relevance.isNull(), business).otherwise(business * w + relevance * 100 * (1 - w))


def rerank_gate(n: Column, gap: Column, top: Column, enough: int = 2, clear: float = 20.0) -> Column:
    """Why a query isn't re-ranked, or 'use'; the first reason that holds."""
    return F.when(n == 0, "no_candidates").when(n < enough, "too_few").when(top <= 0, "no_positive_score").when(gap >= clear, "clear_winner").otherwise("use")


def keyword_field_score(title: Column, tags: Column, query_tokens: Column, views: Column) -> Column:
    """6 for a title hit, 5 for a tag hit, 1.5 per token in the title, views / 1500; over 12 and at most 1."""
    title_tokens = T.tokens(title)
    raw = F.when(F.size(F.array_intersect(title_tokens, query_tokens)) > 0, 6.0).otherwise(0.0) + F.when(F.arrays_overlap(tags, query_tokens), 5.0).otherwise(0.0) + 1.5 * F.size(F.array_intersect(title_tokens, query_tokens)) + views / 1500
    return F.least(F.lit(1.0), raw / 12)


def evidence_confidence(n: Column, best: Column, authority: Column) -> Column:
    return F.least(F.lit(0.94), F.lit(0.2) + F.least(n * 0.08, F.lit(0.32)) + F.least(best * 0.4, F.lit(0.4)) + F.when(authority, 0.1).otherwise(0.0))


def structural_boost(query: Column, sheet: Column, heading: Column, section: Column) -> Column:
    """0.75 per query token of four letters or more in the structure; 3 for a sheet and 2 for a heading that matches the query."""
    words = F.filter(F.split(query, " "), lambda t: F.length(t) >= 4)
    structure = F.concat_ws(" ", sheet, heading, section)
    near = lambda a: (a != "") & (F.contains(query, a) | F.contains(a, query))
    return 0.75 * F.size(F.filter(words, lambda t: F.contains(structure, t))) + F.when(near(sheet), 3.0).otherwise(0.0) + F.when(near(heading), 2.0).otherwise(0.0)


def intent_boost(query_tokens: Column, metadata_tokens: Column, text_tokens: Column, query: Column, text: Column, unit: Column, actions: list[str]) -> Column:
    """Capped boosts for tokens shared with metadata and text, more for action units, and for the whole query in the text."""
    m, t = F.size(F.array_intersect(query_tokens, metadata_tokens)), F.size(F.array_intersect(query_tokens, text_tokens))
    action = unit.isin(*actions)
    share = t / F.greatest(F.size(query_tokens), F.lit(1))
    return F.least(m * 0.018, F.lit(0.12)) + F.least(t * 0.006, F.lit(0.05)) + F.when(action & (m > 0), 0.025).otherwise(0.0) + F.when(action & (t > 0), F.least(share * 0.12, F.lit(0.18))).otherwise(0.0) + F.when((query != "") & F.contains(text, query), 0.18).otherwise(0.0)


def chat_score(score: Column, query_terms: Column, terms: Column, channels: list[str], exclusive: list[str], applicability: Column) -> Column:
    """0.52 of the adjusted score and 0.48 of the applicability; shared terms boost, foreign channels and contexts cost."""
    own, ch = F.array_intersect(query_terms, terms), F.array(*map(F.lit, channels))
    qc, cc = F.array_intersect(query_terms, ch), F.array_intersect(terms, ch)
    boost = 0.025 * F.size(own) + 0.02 * F.size(F.array_intersect(own, ch)) + F.when(applicability >= 0.58, F.least(F.lit(0.16), applicability * 0.14)).otherwise(0.0)
    foreign = F.size(F.array_except(F.array_intersect(terms, F.array(*map(F.lit, exclusive))), query_terms))
    cost = F.when((F.size(qc) > 0) & (F.size(cc) > 0) & ~F.arrays_overlap(qc, cc), 0.09).otherwise(0.0) + 0.07 * foreign + F.when(applicability < 0.32, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), 0.52 * F.greatest(F.lit(0.0), score + boost - cost) + 0.48 * applicability)


def policy_applicability(parts: dict[str, Column], weights: dict[str, float], penalty: Column) -> Column:
    """Weighted parts less 0.32 of the penalty, between 0 and 1."""
    total = sum((parts[k] * w for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total - 0.32 * penalty))


def portal_score(ranking: Column, query_tokens: Column, text: Column, query: Column) -> Column:
    """100 times the ranking score, 10 per query token in the text, 35 if all are, 25 for the whole query."""
    found = F.size(F.filter(query_tokens, lambda t: F.contains(text, t)))
    return ranking * 100 + 10 * found + F.when((F.size(query_tokens) > 0) & (found == F.size(query_tokens)), 35).otherwise(0) + F.when((query != "") & F.contains(text, query), 25).otherwise(0)


def preview_score(title: Column, section: Column, content: Column, query: Column, query_tokens: Column, approved: Column) -> Column:
    """12, 8 and 5 for the query in title, section and content; 2.8, 1.4 and 0.8 per token; 1 for approved units."""
    per = lambda c, w: w * F.size(F.filter(query_tokens, lambda t: F.contains(c, t)))
    whole = lambda c, w: F.when(F.contains(c, query), float(w)).otherwise(0.0)
    return whole(title, 12) + whole(section, 8) + whole(content, 5) + per(title, 2.8) + per(section, 1.4) + per(content, 0.8) + F.when(approved, 1.0).otherwise(0.0)


def derived_filters(queries: DataFrame, mode: str, confidence: str, least: float = 0.65) -> DataFrame:
    """Scope and visibility that a sure enough chat query adds where it has no filter of its own."""
    sure = (F.col(mode) == "ai_chat") & (F.col(confidence) >= least)
    return queries.withColumns({c: F.when(F.col(f"filter_{c}").isNull() & sure, F.col(f"understood_{c}")).otherwise(F.col(f"filter_{c}")) for c in ("scope", "visibility")})


def validated(value: Column, allowed: list[str], fallback: Column) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(fallback)

"""Quality rules with thresholds that follow the data: quantile sketches per language and source in place of fixed cutoffs.

1. Every text is measured once, whole (``profile``).
2. The measures of texts that pass the base rules go into quantile sketches (``sketch``): counts of integer buckets that are exact up to
   127 and 64 to the octave above, so a quantile is at most 1/64 too small. Sketches merge by adding counts, so partial ones are combined
   before the shuffle, and those of small groups are merged upwards: a group of fewer than ``least_docs`` texts takes its language's sketch,
   a small language that of all texts.
3. Each rule's fence is the median plus (or minus) ``factor`` times the distance of the quartiles, or a least spread where a group is
   uniform (``fences``).
4. Texts are joined with their group's fences (``judge``); a group with a large share of all rows is salted.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, materialize, name, spread_join

WHITE = " \t\n\r\x0b\x0c"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


@dataclass(frozen=True)
class Rule:
    """A measured value (an integer column of profile) and its fences. least: spread that a uniform group is taken to have."""

    name: str
    value: str
    least: int
    low: bool = False


@dataclass(frozen=True)
class RuleConfig:
    """symbols: characters that count as such. window: words of a repeated window. least_words, most_repeat: the base rules (words; percent of words in
    repeated windows). factor: spreads between median and fence. least_docs: texts that a group needs for fences of its own."""

    symbols: str = "#*$%&|<>"
    window: int = 3
    least_words: int = 50
    most_repeat: int = 50
    factor: int = 5
    least_docs: int = 200
    rules: tuple[Rule, ...] = (
        Rule("symbols", "10000 * n_symbols div word_chars", 80),
        Rule("word_length", "100 * word_chars div n_words", 30, low=True),
        Rule("dup_lines", "10000 * n_dup_lines div n_lines", 1000),
        Rule("repeats", "10000 * n_repeat_words div n_words", 800),
    )


def measure(text: str | None, symbols: str, window: int) -> tuple[int, ...]:
    """The MEASURES of one text. Words are runs of anything but ASCII white space, compared as they stand; null is an empty text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = Counter(x for x in text.split("\n") if x.strip(WHITE))
    n = len(words)
    repeated, end = 0, 0
    if n >= window:
        windows = list(zip(*(words[k:] for k in range(window)), strict=False))
        seen = Counter(windows)
        if len(seen) < len(windows):
            for at, w in enumerate(windows):
                if seen[w] > 1:
                    repeated += at + window - max(at, end)
                    end = at + window
    return n, len(text) - sum(map(text.count, WHITE)), sum(map(text.count, symbols)), sum(lines.values()) - len(lines), repeated, sum(lines.values())


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """(id, lang, source, *MEASURES, base_failed) of every row; null texts count as empty, other columns of docs are ignored."""

    def rows(ids, langs, sources, texts):
        for i, lang, source, text in zip(ids, langs, sources, texts, strict=True):
            yield i, lang, source, *measure(text, cfg.symbols, cfg.window)

    arrow = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((m, pa.int64()) for m in MEASURES)])
    taken = docs.select(name(id_col).cast("long"), name(lang_col).cast("string"), name(source_col).cast("string"), name(text_col))
    found = arrow_map(taken, rows, "id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES), arrow)
    return found.withColumn("base_failed", (F.col("n_words") < cfg.least_words) | (100 * F.col("n_repeat_words") > cfg.most_repeat * F.col("n_words")))


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket: all bits under the seven leading ones are cleared."""
    low = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def group_key(*columns: str) -> Column:
    """A text that names a group; null and empty differ."""
    return F.to_json(F.struct(*columns))


def sketch(profiled: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketches of the texts that pass the base rules."""
    values = F.inline(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).cast("long").alias("v")) for r in cfg.rules)))
    passed = profiled.where("not base_failed").select("lang", "source", values)
    return passed.groupBy("lang", "source", "rule", bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: counts of the same bucket are added."""
    return sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """(*keys, docs, fences): for each group its number of texts and a struct of ``<rule>_high`` and ``<rule>_low``.

    A window holds the buckets of one rule in one group, of which there are 64 an octave at most.
    """
    group = Window.partitionBy(*keys, "rule")
    upto = F.sum("n").over(group.orderBy("bucket"))
    ranked = sketches.withColumn("upto", upto).withColumn("docs", F.sum("n").over(group))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bucket")))
    of_rule = ranked.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), quartile(1).alias("q1"), quartile(2).alias("q2"), quartile(3).alias("q3"))
    sides = []
    for r in cfg.rules:
        reach = cfg.factor * F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least))
        sides.append(F.max(F.when(F.col("rule") == r.name, F.col("q2") + reach)).alias(f"{r.name}_high"))
        if r.low:
            sides.append(F.max(F.when(F.col("rule") == r.name, F.col("q2") - reach)).alias(f"{r.name}_low"))
    named = [f"{r.name}_{side}" for r in cfg.rules for side in ("high", "low")[: 1 + r.low]]
    return of_rule.groupBy(*keys).agg(F.max("docs").alias("docs"), *sides).select(*keys, "docs", F.struct(*named).alias("fences"))


def group_fences(profiled: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """(group, lang, source, level, docs, fences): the fences that hold for each (lang, source), from the finest level with enough texts."""
    fine = sketch(profiled, cfg)
    by_lang = merge(fine, "lang")
    own = fences(fine, ["lang", "source"], cfg).select(group_key("lang", "source").alias("group"), F.col("docs").alias("d0"), F.col("fences").alias("f0"))
    lang = fences(by_lang, ["lang"], cfg).select(group_key("lang").alias("of_lang"), F.col("docs").alias("d1"), F.col("fences").alias("f1"))
    all_ = fences(merge(by_lang.withColumn("all", F.lit(0)), "all"), ["all"], cfg).select("all", F.col("docs").alias("d2"), F.col("fences").alias("f2"))
    groups = profiled.groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source", group_key("lang", "source").alias("group"), group_key("lang").alias("of_lang"), F.lit(0).alias("all"))
    met = groups.join(own, "group", "left").join(lang, "of_lang", "left").join(F.broadcast(all_), "all", "left")
    level = F.when(F.col("d0") >= cfg.least_docs, 0).when(F.col("d1") >= cfg.least_docs, 1).otherwise(2)
    return met.withColumn("level", level).select("group", "lang", "source", "level", F.expr("element_at(array(d0, d1, d2), level + 1)").alias("docs"), F.expr("element_at(array(f0, f1, f2), level + 1)").alias("fences"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """One row per row of ``docs``: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules, level).

    kept: passes the base rules and lies inside all fences of its group (values on a fence do). failed_rules names the others, in the order of
    cfg.rules; level: 0 for fences of the row's own language and source, 1 of its language, 2 of all texts. Null texts are empty and fail the base
    rules; null languages and sources are groups like any other; rows with a null or repeated id are judged each on its own text. An empty table gives
    no rows. Other columns, of whatever name, are ignored.
    """
    profiled = materialize(profile(docs, id_col, text_col, lang_col, source_col, cfg), "profiled")
    limits = group_fences(profiled, cfg).select("group", "level", "fences")
    met = spread_join(profiled.withColumn("group", group_key("lang", "source")), limits, "group")
    outside = []
    for r in cfg.rules:
        out = F.expr(r.value) > F.col(f"fences.{r.name}_high")
        if r.low:
            out = out | (F.expr(r.value) < F.col(f"fences.{r.name}_low"))
        outside.append(F.when(~F.col("base_failed") & out, F.lit(r.name)))
    met = met.withColumn("failed_rules", F.array_compact(F.array(*outside)))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return met.select(F.col("id").alias(id_col), *MEASURES[:-1], "base_failed", kept.alias("kept"), "failed_rules", "level")

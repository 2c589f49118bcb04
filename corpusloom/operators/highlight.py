"""Where a passage stands in a text though some of its words differ: seeds by equi-join, diagonals, alignment of the words.

A passage of m words may differ from its place by k = m // 10 words put in, left out or replaced. Cut into k + 1 pieces, one piece at
least then stands there unchanged, so that the first words of the pieces (five, or as many as a short passage has) are seeds that miss no
place. Seeds on near diagonals (place in the text less place in the passage) are one candidate, of which only the window around it is aligned.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEED = 5
ERRORS_ONE_IN = 10
WORD, PIECES = r"[\p{L}\p{N}]", r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"


def pieces(text: Column) -> Column:
    """Words and what is between them in turn; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD + "+"), F.lit(0))


def align(window: Sequence[str], passage: Sequence[str], k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the run of the window nearest to the passage within k edits: fewest, then first, then shortest; None without one."""
    best = None
    row = [(0, j) for j in range(len(window) + 1)]  # edits so far and where the run began; it may begin anywhere
    for i, w in enumerate(passage, 1):
        old, row = row, [(i, 0)]
        for j, x in enumerate(window, 1):
            a, b, c = old[j - 1], old[j], row[j - 1]
            row.append(min((a[0] + (x != w), a[1]), (b[0] + 1, b[1]), (c[0] + 1, c[1])))
        if min(e for e, _ in row) > k:
            return None
    for j, (e, start) in enumerate(row):
        if e <= k and j > start and (best is None or (e, start, j) < best):
            best = (e, start, j)
    return best


@F.pandas_udf(StructType().add("edits", "integer").add("start", "integer").add("end", "integer"))
def _aligned(window: pd.Series, passage: pd.Series, k: pd.Series) -> pd.DataFrame:
    found = [align(list(w), list(p), int(n)) or (None, None, None) for w, p, n in zip(window, passage, k)]
    return pd.DataFrame(found, columns=["edits", "start", "end"]).astype("Int32")


def _seeds(passages: DataFrame) -> DataFrame:
    """The first words of each piece, with their place (from 0)."""
    m, k = F.size("ws"), F.col("k")
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), k), lambda i: F.floor(i * m / (k + 1)).cast("int")))
    g = F.least(m, F.lit(SEED))
    return passages.withColumn("at", F.explode(places)).select("item_id", "nk", "k", "at", g.alias("g"), F.xxhash64(F.slice("ws", F.col("at") + 1, g)).alias("seed"))


def _grams(g: int) -> Column:
    """Each run of g words with its place (from 0), as a hash."""
    return F.transform(F.sequence(F.lit(0), F.size("ws") - g), lambda i: F.struct(F.lit(g).alias("g"), i.alias("pos"), F.xxhash64(F.slice("ws", i + 1, F.lit(g))).alias("seed")))


def highlights(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per text and passage that has a place in it: its best place, as characters of the text (``start_at`` from 1, ``n``), edits and stage.

    ``exact``: the passage stands there letter for letter, from its first word to its last; ``normalised``: its words do, in other case or with
    other marks between them; ``fuzzy``: within m // 10 edits of words. Of several places the one with the fewest edits counts, then the first.
    Texts and passages that are null or have no word give no row; equal rows count once, rows of one id with other texts each for itself.
    """
    p = passages.select(F.col(item_id).alias("item_id"), F.col(text).alias("passage")).withColumn("ws", words(F.col("passage"))).where(F.size("ws") > 0)
    p = p.withColumn("nk", F.xxhash64("passage")).withColumn("k", F.floor(F.size("ws") / ERRORS_ONE_IN).cast("int")).dropDuplicates(["item_id", "nk"])
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where(F.col("body").isNotNull()).withColumn("tk", F.xxhash64("body"))
    seeds = _seeds(p)
    sizes = [r[0] for r in seeds.select("g").distinct().collect()]  # at most SEED values
    grams = d.select("doc_id", "tk", words(F.col("body")).alias("ws"))
    empty = F.expr("array_remove(array(named_struct('g', 0, 'pos', 0, 'seed', 0L)), named_struct('g', 0, 'pos', 0, 'seed', 0L))")
    all_grams = F.concat(empty, *[F.when(F.size("ws") >= g, _grams(g)).otherwise(empty) for g in sizes])
    found = grams.select("doc_id", "tk", F.inline(all_grams)).join(seeds, ["g", "seed"])
    band = F.floor((F.col("pos") - F.col("at")) / (F.col("k") + 1)).cast("int")
    hits = found.select("doc_id", "tk", "item_id", "nk", band.alias("band")).distinct()
    both = hits.join(d, [hits["doc_id"].eqNullSafe(d["doc_id"]), hits["tk"] == d["tk"]]).select(hits["*"], "body")
    both = both.join(p, [both["item_id"].eqNullSafe(p["item_id"]), both["nk"] == p["nk"]]).select(both["*"], "passage", F.col("ws").alias("pw"), "k")
    # the band's diagonals, k words more on either side, and the passage's length
    first = F.greatest(F.col("band") * (F.col("k") + 1) - F.col("k"), F.lit(0))
    last = (F.col("band") + 1) * (F.col("k") + 1) + F.size("pw") + F.col("k")
    placed = both.withColumn("first", first).withColumn("a", _aligned(F.slice(words(F.col("body")), F.col("first") + 1, last - F.col("first")), F.col("pw"), F.col("k")))
    place = F.struct(F.col("a.edits").alias("edits"), (F.col("first") + F.col("a.start")).alias("start"), (F.col("first") + F.col("a.end")).alias("end"))
    # the filter follows the grouping: before it, it would align every candidate a second time
    placed = placed.withColumn("place", F.when(F.col("a.edits").isNotNull(), place))
    best = placed.groupBy("doc_id", "tk", "item_id", "nk").agg(F.min("place").alias("place"), F.first("body").alias("body"), F.first("passage").alias("passage")).where("place IS NOT NULL")
    # word j (from 0) is piece 2j, or 2j + 1 if the text begins between words
    lead = F.when(F.col("body").rlike("^" + WORD), 0).otherwise(1)
    skip, span = F.col("place.start") * 2 + lead, (F.col("place.end") - F.col("place.start")) * 2 - 1
    ps, core = pieces(F.col("body")), F.regexp_replace("passage", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    out = best.select(
        "doc_id", "item_id", (F.length(F.array_join(F.slice(ps, 1, skip), "")) + 1).cast("long").alias("start_at"), F.array_join(F.slice(ps, skip + 1, span), "").alias("mark"), F.col("place.edits").alias("edits"), core.alias("core")
    )
    stage = F.when(F.col("mark") == F.col("core"), "exact").when(F.col("edits") == 0, "normalised").otherwise("fuzzy")
    return out.select("doc_id", "item_id", "start_at", F.length("mark").cast("long").alias("n"), "edits", stage.alias("stage"))

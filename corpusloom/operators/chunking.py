"""Ingestion: logical units, repair, greedy chunks, section paths, evidence elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def unit_type(c: Column) -> Column:
    """note, bullet, condition or section, the first that holds."""
    low = F.lower(c)
    return F.when(low.rlike(r"^(note|nota|hinweis|remarque)($|[^\p{L}])"), "note").when(T.is_bullet(c), "bullet").when(low.rlike(r"(^|[^\p{L}])(if|when|unless|quand|wenn)($|[^\p{L}])"), "condition").otherwise("section")


def claims(units: DataFrame, content: str) -> DataFrame:
    """Units with their type and claim, a hash of the type and the whole normalised text."""
    typed = units.withColumn("unit_type", unit_type(F.col(content)))
    return typed.withColumn("claim", F.md5(T.normalize_phrase(F.concat_ws(" ", "unit_type", content))))


def claim_counts(units: DataFrame, id_col: str, content: str) -> DataFrame:
    """(claim, unit_type, dup_count, longest, versions); counted per id first, so that no task gathers a frequent claim's ids."""
    each = units.groupBy("claim", "unit_type", id_col).agg(F.count("*").alias("n"), F.max(F.length(content)).alias("longest"))
    return each.groupBy("claim", "unit_type").agg(F.sum("n").alias("dup_count"), F.max("longest").alias("longest"), F.count("*").alias("versions"))


def logical_units(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Sentences of every paragraph in order: (id, paragraph, sentence, content, unit_type)."""
    p = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("paragraph", "p")).where(F.trim("p") != "")
    s = p.select(id_col, "paragraph", F.posexplode(T.sentences(F.col("p"))).alias("sentence", "content"))
    return s.withColumn("unit_type", unit_type(F.col("content")))


def repair(units: Column, incomplete: str) -> Column:
    """Fold an array of texts: a text is joined to the one before as long as what is gathered there matches ``incomplete``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    step = lambda acc, x: F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), x.alias("open"))).when(acc["open"].rlike(incomplete), F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["open"], x).alias("open"))).otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), x.alias("open")))
    return F.aggregate(units, start, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def chunk(units: DataFrame, id_col: str, order: list[str], text_col: str, target: int = 260, overlap: int = 48) -> DataFrame:
    """Greedy chunks of whole units: (id, chunk_index, first_unit, end_unit, tokens, content).

    A chunk closes before it would exceed ``target`` tokens; the next starts with the closed one's trailing units whose tokens sum
    to at most ``overlap`` (at least one, unless that is the whole chunk). Token counts are folded inside one row per document as
    plain integers; texts are joined by slices only at the end.
    """
    n = F.size(F.split(F.trim(F.col(text_col)), r"\s+"))
    docs = units.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text_col).alias("x"), n.alias("n")))).alias("u"))
    before = F.transform("u.n", lambda x, k: F.aggregate(F.slice("u.n", F.lit(1), k), F.lit(0), lambda s, y: s + y))
    docs = docs.withColumn("before", F.concat(before, F.array(F.aggregate("u.n", F.lit(0), lambda s, y: s + y))))
    b = F.col("before")

    def back(at: Column, first: Column) -> Column:
        """Where the next chunk starts after one of units first..at."""
        fits = F.filter(F.sequence(first + 1, at), lambda k: F.element_at(b, at + 1) - F.element_at(b, k + 1) <= overlap)
        return F.when(at - first <= 1, at).otherwise(F.least(F.coalesce(F.array_min(fits), at), at - 1))

    zero = F.struct(F.array().cast("array<struct<s:int,e:int>>").alias("done"), F.lit(0).alias("first"))

    def step(acc: Column, k: Column) -> Column:
        over = (F.element_at(b, k + 2) - F.element_at(b, acc["first"] + 1) > target) & (k > acc["first"])
        nxt = back(k, acc["first"])
        nxt = F.when(F.element_at(b, k + 2) - F.element_at(b, nxt + 1) > target, k).otherwise(nxt)
        return F.when(over, F.struct(F.array_append(acc["done"], F.struct(acc["first"].alias("s"), k.alias("e"))).alias("done"), nxt.alias("first"))).otherwise(acc)

    total = F.size("u")
    cuts = F.aggregate(F.sequence(F.lit(0), total - 1), zero, step, lambda acc: F.array_append(acc["done"], F.struct(acc["first"].alias("s"), total.alias("e"))))
    out = docs.select(id_col, "u", "before", F.posexplode(cuts).alias("chunk_index", "c"))
    size = F.element_at("before", F.col("c.e") + 1) - F.element_at("before", F.col("c.s") + 1)
    return out.select(id_col, "chunk_index", F.col("c.s").alias("first_unit"), F.col("c.e").alias("end_unit"), size.alias("tokens"), F.array_join(F.slice(F.col("u.x"), F.col("c.s") + 1, F.col("c.e") - F.col("c.s")), " ").alias("content"))


def section_path(blocks: DataFrame, keys: list[str], order: list[str], level: str, title: str, depth: int = 3) -> DataFrame:
    """Headings in force at each block: of each level the last one since the last heading of a smaller level."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = blocks
    for k in range(1, depth + 1):
        reset = F.when(F.col(level) == k, F.struct(F.col(title).alias("t"))).when(F.col(level) < k, F.struct(F.lit(None).cast("string").alias("t")))
        out = out.withColumn(f"__h{k}", F.last(reset, ignorenulls=True).over(w)["t"])
    return out.withColumn("section_path", F.concat_ws(" > ", *(F.col(f"__h{k}") for k in range(1, depth + 1)))).drop(*(f"__h{k}" for k in range(1, depth + 1)))


def html_elements(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Headings, paragraphs and list items of a page in order: (id, position, kind, text)."""
    found = F.regexp_extract_all(html_col, F.lit(r"(?s)(<(?:h1|p|li)>.*?)(?=<(?:/?h1|/?p|/?li|/article)>|$)"), 1)
    e = pages.select(id_col, F.posexplode(found).alias("position", "raw"))
    kind = F.when(F.col("raw").startswith("<h1>"), "heading").when(F.col("raw").startswith("<p>"), "paragraph").otherwise("list_item")
    return e.select(id_col, "position", kind.alias("kind"), F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("text"))


def cell_name(column: Column, row: Column) -> Column:
    """A1 reference of a 0-based column (up to ZZ) and a 1-based row."""
    letter = lambda c: F.char(c + 65)
    return F.concat(F.when(column >= 26, letter(F.floor(column / 26) - 1)).otherwise(""), letter(column % 26), row.cast("string"))


def evidence_hash(ids: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(ids)), ","), 256)

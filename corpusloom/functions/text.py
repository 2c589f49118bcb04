"""Text normalisers and small text functions as Column expressions (no UDFs).

The normalisers differ on purpose: ranking rules depend on which one is used where.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


@lru_cache(1)
def _accent_pairs() -> tuple[str, str]:
    """Code points that decompose to one base character and marks, and these bases; with the Vietnamese d."""
    source, target = ["đ", "Đ"], ["d", "D"]
    for cp in range(0xC0, min(0x10000, sys.maxunicode)):
        c = chr(cp)
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c and not 0xD800 <= cp <= 0xDFFF:
            source.append(c)
            target.append(base[0])
    return "".join(source), "".join(target)


def strip_accents(c: Column) -> Column:
    """Remove diacritics: precomposed letters through a table from the Unicode rule, free marks by pattern."""
    source, target = _accent_pairs()
    return F.regexp_replace(F.translate(c, source, target), r"\p{M}+", "")


def tokens(c: Column) -> Column:
    """Lower-case words of letters and digits without accents; underscores separate words."""
    return F.regexp_extract_all(strip_accents(F.lower(c)), F.lit(WORD), 0)


def normalize_phrase(c: Column, by: str = " ") -> Column:
    return F.array_join(tokens(c), by)


def normalize_text(c: Column) -> Column:
    """Accents off, lower case, white space collapsed; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"\s+", " "))


def normalize_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normalize_text(c), "[^a-z0-9_]+", "_"), "^_+|_+$", "")


def normalize_match(c: Column, keep: str = "") -> Column:
    """Lower case without accents; anything but a-z, 0-9 and ``keep`` is a blank."""
    # ASCII texts have no accents, and the table goes through a text character by character.
    plain = F.when(F.length(c) == F.octet_length(c), c).otherwise(strip_accents(c))
    return F.trim(F.regexp_replace(F.lower(plain), f"[^a-z0-9{keep}]+", " "))


def portal_normalize(c: Column) -> Column:
    """Lower case; anything but letters and digits is a blank; accents stay."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def normalize_whitespace(c: Column) -> Column:
    """NULs go, white space collapses within lines, blank lines go."""
    lines = F.transform(F.split(F.regexp_replace(c, "\\x00", ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def phrase_in(query: Column, phrase: Column) -> Column:
    """Whether a normalised phrase occurs in a normalised query at word borders."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), query, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def or_terms(c: Column) -> Column:
    return F.filter(F.array_distinct(tokens(c)), lambda t: F.length(t) >= 2)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?。！？])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def is_heading(c: Column, longest: int = 120) -> Column:
    """Markdown heading, capitals before a colon, or a short line that ends in a colon; never a numbered item."""
    markdown = c.rlike(r"^#{1,6}\s+\S")
    capitals = c.rlike(r"^[\p{Lu}\p{N} _/-]{3,}:?$") & c.rlike(r"\p{Lu}")
    colon = c.endswith(":") & (F.size(F.split(c, r"\s+")) <= 8)
    return (F.length(c) <= longest) & ~c.rlike(r"^\d+[.)]\s") & (markdown | capitals | colon)


def is_bullet(c: Column) -> Column:
    return c.rlike(r"^\s*(?:[-*•+]|\d+[.)]|[a-z][.)])\s+\S")


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether any of the words occurs at word borders (no words: never)."""
    found = F.lit(False)
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    for w in words:
        found = found | F.contains(padded, F.lit(f" {w} "))
    return found


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger size; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def register(spark: SparkSession) -> None:
    """The normalisers as SQL functions of the session."""
    source, target = (x.replace("\\", "\\\\").replace("'", "\\'") for x in _accent_pairs())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strip_accents(x STRING) RETURNS STRING RETURN regexp_replace(translate(x, '{source}', '{target}'), '\\\\p{{M}}+', '')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalize_phrase(x STRING) RETURNS STRING RETURN array_join(regexp_extract_all(strip_accents(lower(x)), '[\\\\p{L}\\\\p{N}]+', 0), ' ')")

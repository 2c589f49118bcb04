"""Spelling variants: words one edit apart, found over a reduced alphabet and verified on their own letters.

1. Words are counted over whole texts, combined inside each task before the shuffle (``vocabulary``).
2. Letters are hashed to a few symbols. A reduced word is known by a polynomial of its symbols modulo 2**64 and its length (``reduced``).
   Words one edit apart have reduced words that are equal or one edit apart.
3. Each reduced word's one-edit neighbourhood is generated (``neighbourhood``) and joined with the reduced vocabulary. Of every edit one
   direction is generated, the other being its mirror image: deletions of the longer word (the other's insertions), replacements by a
   larger symbol (the other's by a smaller one), and the word itself.
4. Candidates are verified on the original words (``near_pairs``).
5. A word's form is its most frequent near word, if that is frequent enough; roots follow forms to the last (``variants``).
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, drop, materialize, name

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Odd, so it has an inverse modulo 2**64.
BACK = pow(BASE, -1, 2**64)
#: Latin-1 text to words: A-Z lower-cased, all but letters to spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


@dataclass(frozen=True)
class SpellingConfig:
    """symbols: size of the reduced alphabet. least_length, least_count: code points and occurrences of a word. ratio: how many times as frequent
    a form must be. mutate: every how manieth (document, word) hash loses a code point, 0 for none. flush: words that a task holds before it passes
    its counts on."""

    symbols: int = 8
    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    mutate: int = 0
    flush: int = 400_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n): words of at least cfg.least_length code points and cfg.least_count occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With cfg.mutate, a run whose crc32 of ``<id>:<run>`` it
    divides loses the code point of place crc32 % length; a null id is written as nothing there. Null texts have no words.
    """
    least, mutate, flush = cfg.least_length, cfg.mutate, cfg.flush

    def run(batches):
        counts: Counter[bytes] = Counter()

        def passed():
            words = pa.array((w.decode("latin-1") for w in counts), pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found = Counter(text.encode("latin-1", "replace").translate(LETTERS).split())
                if not mutate:
                    for w, k in found.items():
                        if len(w) >= least:
                            counts[w] += k
                else:
                    start = zlib.crc32(f"{i.as_py() if i.is_valid else ''}:".encode())
                    for w, k in found.items():
                        if len(w) >= least:
                            h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                            if h % mutate == 0:
                                at = h % len(w)
                                w = w[:at] + w[at + 1 :]
                                if len(w) < least:
                                    continue
                            counts[w] += k
                if len(counts) > flush:
                    yield passed()
        if counts:
            yield passed()

    counted = docs.select(name(id_col).cast("string").alias("i"), name(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= cfg.least_count)


@lru_cache(8)
def symbol_table(symbols: int) -> np.ndarray:
    """Symbols 1 .. symbols of the code points under 0x250; others go by their remainder."""
    points = np.arange(0x250, dtype=U64)
    return ((points * U64(2654435761) >> U64(7)) % U64(symbols)).astype(np.int64) + 1


def symbols_of(word: str, symbols: int) -> np.ndarray:
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
    return symbol_table(symbols)[points % 0x250]


@lru_cache(64)
def powers(n: int) -> np.ndarray:
    out = np.ones(n, U64)
    out[1:] = BASE
    return np.multiply.accumulate(out)


def reduced_key(s: np.ndarray) -> int:
    """The polynomial of a reduced word (or, of a matrix, of each row), modulo 2**64."""
    return (s.astype(U64) * powers(s.shape[-1])).sum(axis=-1, dtype=U64)


def neighbourhood(s: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lengths of what one word generates: itself first, replacements by larger symbols, and deletions; equal ones once."""
    n, p = len(s), powers(len(s))
    terms = s.astype(U64) * p
    upto = np.cumsum(terms, dtype=U64)
    whole = upto[-1]
    same = np.unique(np.concatenate([p[:0], *(whole + U64(more) * p[s + more <= symbols] for more in range(1, symbols))]))
    shorter = np.unique(upto - terms + (whole - upto) * U64(BACK)) if n > 1 else np.empty(0, U64)
    return np.concatenate([whole[None], same, shorter]), np.repeat([n, n - 1], [1 + len(same), len(shorter)])


def reduced(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, n, key, len) of each word."""

    def rows(texts, counts):
        for w, n in zip(texts, counts, strict=True):
            s = symbols_of(w, cfg.symbols)
            yield w, n, int(reduced_key(s).astype(np.int64)), len(s)

    return arrow_map(words.select("word", "n"), rows, "word string, n long, key long, len int", pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("len", pa.int32())]))


def generated(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(key, len, word, n, own): the neighbourhood of every word's reduced word; own: the reduced word itself."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, lengths, sizes = [], [], []
                for w in part.column(0).to_pylist():
                    k, n = neighbourhood(symbols_of(w, cfg.symbols), cfg.symbols)
                    keys.append(k)
                    lengths.append(n)
                    sizes.append(len(k))
                if sizes:
                    of = np.repeat(np.arange(len(sizes)), sizes)
                    own = pa.array(np.diff(of, prepend=-1) > 0)
                    of = pa.array(of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(lengths).astype(np.int32)), part.column(0).take(of), part.column(1).take(of), own], names=["key", "len", "word", "n", "own"])

    return words.select("word", "n").mapInArrow(run, "key long, len int, word string, n long, own boolean")


def near_pairs(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(a, n_a, b, n_b): every pair of distinct words that differ by exactly one inserted, deleted or replaced code point, once."""
    known = reduced(words, cfg).select("key", "len", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = generated(words, cfg).select("key", "len", "own", F.col("word").alias("a"), F.col("n").alias("n_a")).join(known, ["key", "len"])
    # Two words of one reduced word both generate it.
    return met.where((~F.col("own") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(word, root) of ``forms(word, form)``: pointers are doubled until none moves. A form is more frequent than its word, so there are no cycles."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(max_rounds):
        onward = now.where("root is not null").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(now)
        now = moved.select("word", "root")
        now.scratch_path = moved.scratch_path
        if moved.where("moved").isEmpty():
            return now
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def variants(words: DataFrame, cfg: SpellingConfig = SpellingConfig()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words(word, n)``, of which each word is one row.

    form: the near word of largest n, ties to the first in code-point order, if its n is at least cfg.ratio times the word's, else null;
    root: where forms end, the word itself if it has none. n_near: number of near words. An empty table gives no rows.
    """
    words = materialize(words, "words")
    pairs = near_pairs(words, cfg)
    both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    met = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= cfg.ratio * F.col("n"), F.col("best.near")).alias("form"), F.when(-F.col("best.less") >= cfg.ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    met = materialize(met, "near")
    return met.join(roots(met), "word").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed character 1- to 3-grams; a bounded sample of labelled rows of each language is
clustered (spherical k-means) into several centroids. A text gets the language of the centroid with the largest cosine,
and is rejected if that cosine is under the language's threshold for texts of such a length: a share of a low quantile of
the cosines that texts of the sample, and cuts of them, reach at centroids fitted without them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, drop, hashed_place, materialize, name


@dataclass(frozen=True)
class LangConfig:
    """fit_rows: labelled rows per language that the model is fitted on, at most. clusters: centroids per language.
    dims: hashed n-gram dimensions. scale: of cosines in the score's softmax. low, slack: quantile of the held-out cosines and the
    share of it under which a text is rejected. cuts: texts of a language that are cut for thresholds of short texts.
    few: cosines that a length class needs for a threshold of its own."""

    fit_rows: int = 300
    clusters: int = 4
    dims: int = 16384
    scale: float = 25.0
    rounds: int = 8
    low: float = 0.01
    slack: float = 0.55
    cuts: int = 100
    few: int = 50
    seed: int = 5


#: Upper bounds of the length classes (in letters) that have a rejection threshold each.
LENGTHS = (4, 8, 16, 32, 64, 128, 512, 4096)


def letters(text: str | None) -> int:
    return sum(map(str.isalpha, text)) if text else 0


def counts(text: str, dims: int) -> np.ndarray:
    """Sublinear frequencies of the hashed 1- to 3-grams of a lower-cased text with white space and digits as one blank."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isalpha() else text.lower()
    c = np.frombuffer(f" {' '.join(words.split())} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint64(n)) * a
        h ^= h >> np.uint64(29)
        at = ((h * b) >> np.uint64(40)) % np.uint64(dims)
        grams.append(at if n > 1 else at[c != 32])  # a blank alone tells nothing
        if n == len(c):
            break
    return np.log1p(np.bincount(np.concatenate(grams).astype(np.int64), minlength=dims)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass
class LangModel:
    """langs: learned values, one per centroid; idf, centroids: as fitted; least: rejection cosines per language and length class."""

    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    least: dict[str, np.ndarray]
    cfg: LangConfig

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, cosine, rejected). No letters: ('und', 0, 0, True)."""
        n = letters(text)
        if not n or not self.langs:
            return "und", 0.0, 0.0, True
        cos = self.centroids @ _unit(counts(text, self.cfg.dims) * self.idf)
        best: dict[str, float] = {}
        for lang, x in zip(self.langs, cos.tolist(), strict=True):
            best[lang] = max(best.get(lang, -1.0), x)
        lang = min(best, key=lambda k: (-best[k], k))
        odds = sum(np.exp(self.cfg.scale * (x - best[lang])) for x in best.values())
        near = best[lang]
        return lang, float(1 / odds), near, bool(near <= 0 or near < self.least[lang][np.searchsorted(LENGTHS, n)])


def _cluster(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means, started from the mean and rows far from what is there."""
    centers = [_unit(x.mean(axis=0))]
    near = x @ centers[0]
    while len(centers) < min(k, len(x)):
        centers.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centers[-1])
    c = np.array(centers)
    for _ in range(rounds):
        to = (x @ c.T).argmax(axis=1)
        c = np.array([_unit(x[to == j].mean(axis=0)) if (to == j).any() else c[j] for j in range(len(c))])
    return c


def _weigh(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(raw * idf).astype(np.float32)


def _cut(text: str, n: int, rng: np.random.Generator) -> str:
    """A random run of n letters of a text, with what stands between them."""
    at = [k for k, c in enumerate(text) if c.isalpha()]
    first = int(rng.integers(0, len(at) - n + 1))
    return text[at[first] : at[first + n - 1] + 1]


def fit_language(texts: list[str], idf: np.ndarray, cfg: LangConfig) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosine per length class) of one language from its sampled texts.

    Each half of the sample, and cuts of its texts at every length class, is compared with centroids of the other half. A length class
    with fewer than cfg.few of them takes the next shorter one's threshold: longer texts are mostly nearer.
    """
    texts = sorted(texts)
    x, rng = _weigh(np.array([counts(t, cfg.dims) for t in texts]), idf), np.random.default_rng(cfg.seed)
    centroids = _cluster(x, cfg.clusters, cfg.rounds)
    found: list[list[float]] = [[] for _ in range(len(LENGTHS) + 1)]
    for h in (0, 1) if len(texts) > 1 else ():
        other = _cluster(x[1 - h :: 2], cfg.clusters, cfg.rounds)
        for t, v in zip(texts[h::2], x[h::2], strict=True):
            found[int(np.searchsorted(LENGTHS, letters(t)))].append(float((other @ v).max()))
        for t in texts[h::2][: cfg.cuts // 2]:
            n = letters(t)
            for k, bound in enumerate(LENGTHS):
                if bound < n:
                    found[k].append(float((other @ _weigh(counts(_cut(t, LENGTHS[k - 1] + 1 if k else 1, rng), cfg.dims), idf)).max()))
    least, last = np.zeros(len(found)), 0.0
    for k, cosines in enumerate(found):
        last = least[k] = cfg.slack * float(np.quantile(cosines, cfg.low)) if len(cosines) >= cfg.few else last
    return centroids.astype(np.float32), least


def fit(rows: list[tuple[str, str]], cfg: LangConfig = LangConfig()) -> LangModel:
    """Fit on (lang, text) rows, in any order; texts without letters are ignored."""
    by: dict[str, list[str]] = {}
    for lang, text in rows:
        if letters(text):
            by.setdefault(lang, []).append(text)
    df = sum(((counts(t, cfg.dims) > 0).astype(np.int64) for texts in by.values() for t in texts), np.zeros(cfg.dims, np.int64))
    idf = inverse_frequency(df, sum(map(len, by.values())))
    return assemble({lang: fit_language(texts, idf, cfg) for lang, texts in by.items()}, idf, cfg)


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + 1


def assemble(parts: dict[str, tuple[np.ndarray, np.ndarray]], idf: np.ndarray, cfg: LangConfig) -> LangModel:
    langs = [lang for lang in sorted(parts) for _ in parts[lang][0]]
    return LangModel(langs, idf, np.concatenate([parts[lang][0] for lang in sorted(parts)]) if parts else np.zeros((0, cfg.dims), np.float32), {lang: x for lang, (_, x) in parts.items()}, cfg)


def fit_table(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", cfg: LangConfig = LangConfig()) -> LangModel:
    """Fit on a bounded sample of labelled rows: of each language those whose hashed id comes first, cfg.fit_rows at most.

    Rows are bounded, texts are taken whole. Languages are fitted in tasks of their own; the driver sees document frequencies
    and centroids, a few vectors per language.
    """
    base = labelled.select(name(id_col).cast("long").alias("id"), name(text_col).alias("text"), name(lang_col).alias("lang")).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per class of the model
    if not sizes:
        return fit([], cfg)
    # Shares of the hash's range first, so that few rows are ranked; 2 ** 63 places tell any number of rows apart.
    bound = F.create_map(*[x for lang, n in sorted(sizes.items()) for x in (F.lit(lang), F.lit(min(2**63 - 1, int(2**63 * 2 * cfg.fit_rows / n))))])[F.col("lang")]
    order = Window.partitionBy("lang").orderBy("place", "id", "text")
    picked = base.withColumn("place", hashed_place("id", cfg.seed)).where(F.col("place") <= bound).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.fit_rows)
    picked = materialize(picked.select("lang", "text"), "language-sample")

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        df = np.zeros(cfg.dims, np.int64)
        for t in pdf["text"]:
            df += counts(t, cfg.dims) > 0
        return pd.DataFrame({"n": [len(pdf)], "df": [df.tobytes()]})

    df, total = np.zeros(cfg.dims, np.int64), 0
    for r in picked.groupBy("lang").applyInPandas(frequencies, "n long, df binary").toLocalIterator():
        df, total = df + np.frombuffer(r["df"], np.int64), total + r["n"]
    idf = inverse_frequency(df, total)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c, least = fit_language(pdf["text"].tolist(), idf, cfg)
        return pd.DataFrame({"lang": [key[0]], "c": [c.tobytes()], "least": [least.tobytes()]})

    parts = {r["lang"]: (np.frombuffer(r["c"], np.float32).reshape(-1, cfg.dims), np.frombuffer(r["least"], np.float64)) for r in picked.groupBy("lang").applyInPandas(one, "lang string, c binary, least binary").toLocalIterator()}
    drop(picked)
    return assemble(parts, idf, cfg)


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, cosine, rejected) of every row's whole text, in one narrow pass; other columns are ignored.

    A null text, or one without letters, is 'und' with score 0 and rejected. Repeated rows repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: centroids and weights

    def rows(ids, texts):
        m = shared.value
        for i, t in zip(ids, texts, strict=True):
            yield i, *m.predict(t)

    schema = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("rejected", pa.bool_())])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, "id long, lang_pred string, score double, cosine double, rejected boolean", schema).withColumnRenamed("id", id_col)


def accepted(model: LangModel, text: Column, spark: SparkSession) -> Column:
    """True where a text is of a learned language; a predicate, so that a filter by it moves no rows."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def keep(texts: pd.Series) -> pd.Series:
        return pd.Series([not shared.value.predict(t)[3] for t in texts], dtype=bool)

    return keep(text)

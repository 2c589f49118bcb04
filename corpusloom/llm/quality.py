"""Document quality by co-training two views.

The content view sees hashed words and the shape of the text; the metadata view sees where it comes from: source,
declared language and length. Each view's logistic classifier is fitted on the labelled rows of a bounded sample; over rounds
each labels the unlabelled rows that it is surest of, evenly from both classes, for the other one. On labelled rows
kept apart, both views' logits are then calibrated together into one probability, with which all documents are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, first_labelled, hashed_place

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class QualityConfig:
    """fit_rows: labelled, and as many unlabelled, rows of the fitting sample, at most. words, sources: hashed dimensions.
    rounds, exchanged: of the co-training; exchanged rows per class, view and round. apart: share kept for calibration."""

    fit_rows: int = 4000
    words: int = 512
    sources: int = 64
    rounds: int = 4
    exchanged: int = 100
    apart: float = 0.3
    seed: int = 13


def content_view(text: str | None, cfg: QualityConfig) -> np.ndarray:
    """Hashed log frequencies of words (unit length) and shape: shares of letters, capitals, digits, blanks and signs,
    distinct words, mean word length, repeated lines, words per line, length. Null counts as empty."""
    text = text or ""
    n = max(1, len(text))
    tokens = Counter(WORD.findall(text.lower()))
    total = max(1, sum(tokens.values()))
    v = np.zeros(cfg.words + 10, np.float32)
    for w, c in tokens.items():
        v[xxhash.xxh32_intdigest(w) % cfg.words] += np.log1p(c)
    v[: cfg.words] /= max(1e-6, float(np.linalg.norm(v[: cfg.words])))
    letters, upper, digits, blanks = sum(map(str.isalpha, text)), sum(map(str.isupper, text)), sum(map(str.isdigit, text)), sum(map(str.isspace, text))
    lines = [x for x in text.split("\n") if x.strip()]
    v[cfg.words :] = [letters / n, upper / n, 4 * digits / n, blanks / n, 2 * (n - letters - digits - blanks) / n, len(tokens) / total, sum(map(len, tokens)) / max(1, len(tokens)) / 10, len(set(lines)) / max(1, len(lines)), total / max(1, len(lines)) / 50, np.log1p(len(text)) / 10]
    return v


def metadata_view(source: str | None, lang: str | None, n_chars: int | None, cfg: QualityConfig) -> np.ndarray:
    """Hashed source and language, and the length in classes; nulls are values of their own."""
    v = np.zeros(cfg.sources + 16 + 12, np.float32)
    v[xxhash.xxh32_intdigest(source or "\0") % cfg.sources] = 1
    v[cfg.sources + xxhash.xxh32_intdigest(lang or "\0") % 16] = 1
    v[cfg.sources + 16 + min(11, int(np.log2(1 + max(0, n_chars or 0)) * 0.7))] = 1
    return v


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 200, rate: float = 2.0) -> np.ndarray:
    """Weights (the last is the bias) by accelerated gradient steps; both classes weigh the same."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    b = v = np.zeros(x.shape[1], np.float32)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        new = v - rate * (x.T @ (w * (p - y)) + ridge * v)
        b, v = new, new + k / (k + 3) * (new - b)
    return b


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class QualityModel:
    content: np.ndarray
    meta: np.ndarray
    mix: np.ndarray
    cfg: QualityConfig

    def score(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        z = np.column_stack([logit(content, self.content), logit(meta, self.meta)])
        return 1 / (1 + np.exp(-np.clip(logit(z, self.mix), -30, 30)))


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Fit on rows of both views; y is 0, 1 or -1 (unlabelled). Without both labels every score is a half."""
    none = QualityModel(np.zeros(content.shape[1] + 1, np.float32), np.zeros(meta.shape[1] + 1, np.float32), np.zeros(3), cfg)
    if not ((y == 0).any() and (y == 1).any()):
        return none
    labelled = np.flatnonzero(y >= 0)
    apart = labelled[np.arange(len(labelled)) % 10 < round(10 * cfg.apart)]
    apart = apart if len(set(y[apart])) == 2 and len(set(y[np.setdiff1d(labelled, apart)])) == 2 else labelled
    train = np.setdiff1d(labelled, apart) if len(apart) < len(labelled) else labelled
    views, taught = (content, meta), [y.copy(), y.copy()]
    for t in taught:
        t[apart] = -1
        if len(apart) == len(labelled):
            t[train] = y[train]
    weights = [logistic(v[t >= 0], t[t >= 0]) for v, t in zip(views, taught, strict=True)]
    for _ in range(cfg.rounds):
        for me, other in ((0, 1), (1, 0)):
            pool = np.flatnonzero((taught[other] < 0) & (y < 0))
            if not len(pool):
                continue
            z = logit(views[me][pool], weights[me])
            order = np.argsort(z, kind="stable")
            m = min(cfg.exchanged, len(pool) // 4)
            low, high = order[:m], order[len(order) - m :]
            taught[other][pool[low[z[low] < -1]]] = 0
            taught[other][pool[high[z[high] > 1]]] = 1
        weights = [logistic(v[t >= 0], t[t >= 0]) for v, t in zip(views, taught, strict=True)]
    z = np.column_stack([logit(v[apart], w) for v, w in zip(views, weights, strict=True)])
    return QualityModel(weights[0], weights[1], _calibrate(z, y[apart].astype(float)), cfg)


def _calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, w = np.column_stack([z, np.ones(len(z))]), np.zeros(z.shape[1] + 1)
    ridge = np.array([0.1] * z.shape[1] + [0.01])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - np.clip(step, -3, 3)
    return w


def fit_table(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """Fit on a bounded sample: of ``labels(doc_id, quality)`` and of documents without a label those whose hashed id comes first,
    cfg.fit_rows of either (of each class, labelled ones are half of them). The sample is drawn from ids; no text is shuffled by it."""
    known = first_labelled(docs, labels, "doc_id", "quality", (0, 1), cfg.fit_rows // 2, cfg.seed)
    rest = docs.select(F.col("doc_id").cast("long").alias("id")).where("id is not null").join(labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("id")), "id", "left_anti")
    rest = rest.withColumn("y", F.lit(-1)).withColumn("place", hashed_place("id", cfg.seed)).distinct().orderBy("place").limit(cfg.fit_rows)
    sample = F.broadcast(known.unionByName(rest))  # at most 2 * cfg.fit_rows ids
    picked = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")).join(sample, "id").select("id", "text", "source", "lang", "n_chars", "y", "place")

    def rows(ids, texts, sources, langs, sizes, ys, places):
        for i, t, s, lang, n, y, p in zip(ids, texts, sources, langs, sizes, ys, places, strict=True):
            yield p, y, content_view(t, cfg).tobytes(), metadata_view(s, lang, n, cfg).tobytes()

    schema = pa.schema([("place", pa.int64()), ("y", pa.int32()), ("c", pa.binary()), ("m", pa.binary())])
    views = arrow_map(picked, rows, "place long, y int, c binary, m binary", schema)
    # A repeated id may bring more rows than ids: the bound holds for rows too.
    found = views.withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("place", "c", "m"))).where(F.col("rank") <= F.when(F.col("y") < 0, cfg.fit_rows).otherwise(cfg.fit_rows // 2)).where(F.col("rank") <= cfg.fit_rows)
    found = sorted((r["place"], r["y"], bytes(r["c"]), bytes(r["m"])) for r in found.toLocalIterator())
    if not found:
        return co_train(np.zeros((0, cfg.words + 10)), np.zeros((0, cfg.sources + 28)), np.zeros(0), cfg)
    return co_train(np.array([np.frombuffer(r[2], np.float32) for r in found]), np.array([np.frombuffer(r[3], np.float32) for r in found]), np.array([r[1] for r in found]), cfg)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of every row of ``docs(doc_id, text, source, lang, n_chars)``: the probability of label 1, from whole texts.

    Nulls in any column have a defined score; repeated rows repeat; other columns are ignored. One narrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some hundred weights

    def rows(ids, texts, sources, langs, sizes):
        m = shared.value
        c = np.array([content_view(t, m.cfg) for t in texts])
        v = np.array([metadata_view(s, lang, n, m.cfg) for s, lang, n in zip(sources, langs, sizes, strict=True)])
        yield from zip(ids, m.score(c, v).tolist(), strict=True)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", "source", "lang", F.col("n_chars").cast("long")), rows, "doc_id long, score double", pa.schema([("doc_id", pa.int64()), ("score", pa.float64())]))

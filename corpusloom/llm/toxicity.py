"""Toxic passages by maximum-scoring segment search.

Token log-odds come from labelled texts, smoothed by a chain of Dirichlet priors: a word's prior is its six-letter
beginning's estimate, that one's the four-letter beginning's, that one's an even chance. Each token costs a constant, so
that ordinary text drifts downwards. A linear-time scan finds all maximal scoring segments of a text. Segment scores
are turned to extreme-value evidence: for a text of n tokens the best of chance exceeds s with an expected count of
K n exp(-lambda s). A text's evidence is summed over its significant segments and calibrated on the labelled rows.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, first_labelled, name

WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 50_000  # words whose scores a worker keeps


@dataclass(frozen=True)
class ToxicConfig:
    """fit_rows, fit_tokens: labelled rows of each class that the model is fitted on, and their tokens, at most. prior: weight of the prior, in tokens.
    folds: parts of the crosswise fit. cost: subtracted from each token's log-odds. expected: segments of at most that expected count are significant."""

    fit_rows: int = 2000
    fit_tokens: int = 2_000_000
    folds: int = 4
    prior: float = 2.0
    cost: float = 2.0
    expected: float = 0.05
    top: float = 6.0
    seed: int = 9


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def keys(word: str) -> tuple[str, ...]:
    """The word (marked), and its beginnings of six and four letters, as far as it is longer."""
    return (word + "$", word[:6], word[:4]) if len(word) > 6 else (word + "$", word[:4]) if len(word) > 4 else (word + "$",)


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order, in linear time (Ruzzo and Tompa).

    Each entry of the stack holds the running total before and after its segment.
    """
    out: list[list[float]] = []
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, high = k, before, total
        while out:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = int(out[j][4])
            if j < 0 or out[j][3] >= high:
                break
            start, low = int(out[j][0]), out[j][2]
            del out[j:]
        j = len(out) - 1
        while j >= 0 and out[j][2] >= low:
            j = int(out[j][4])
        out.append([start, k + 1, low, high, j])
    return [(int(a), int(b), h - low) for a, b, low, h, _ in out]


@dataclass
class ToxicModel:
    """odds: log-odds of keys; lam, log_k: extreme-value parameters; slope, bias: of the calibration."""

    odds: dict[str, float]
    lam: float
    log_k: float
    slope: float
    bias: float
    cfg: ToxicConfig

    def token(self, word: str) -> float:
        for k in keys(word):
            found = self.odds.get(k)
            if found is not None:
                return found - self.cfg.cost
        return -self.cfg.cost

    def spans(self, text: str | None, memo: dict[str, float]) -> list[tuple[int, int, float, float]]:
        """Every significant segment: (start, end) in characters, score, expected count."""
        if not text:
            return []
        low = text.lower()
        found = list(WORD.finditer(low))
        scores = self._scores([m[0] for m in found], memo)
        return [(found[a].start(), found[b - 1].end(), s, e) for a, b, s, e in self._significant(scores)]

    def _scores(self, tokens: list[str], memo: dict[str, float]) -> list[float]:
        out = []
        for w in tokens:
            s = memo.get(w)
            if s is None:
                s = memo[w] = self.token(w)
            out.append(s)
        return out

    def _significant(self, scores: list[float]) -> list[tuple[int, int, float, float]]:
        if not scores or max(scores) <= 0:
            return []
        n = np.log(len(scores)) + self.log_k
        return [(a, b, s, e) for a, b, s in segments(scores) if (e := float(np.exp(n - self.lam * s))) <= self.cfg.expected]

    def evidence(self, tokens: list[str], memo: dict[str, float]) -> tuple[float, int]:
        found = self._significant(self._scores(tokens, memo))
        return sum(-np.log(max(e, 1e-30)) for *_, e in found), len(found)

    def score(self, text: str | None, memo: dict[str, float]) -> tuple[float, int, float]:
        """(score, significant segments, evidence)."""
        e, n = self.evidence(words(text), memo)
        return float(1 / (1 + np.exp(-(self.slope * np.log1p(e) + self.bias)))), n, float(e)


def log_odds(toxic: dict[str, int], clean: dict[str, int], cfg: ToxicConfig) -> dict[str, float]:
    """Log-odds of keys from the counts of words in either class, each class scaled to the mean size."""
    n1, n0 = max(1, sum(toxic.values())), max(1, sum(clean.values()))
    f1, f0 = (n1 + n0) / 2 / n1, (n1 + n0) / 2 / n0
    c1, c0, parent = Counter(), Counter(), {}
    for counts, into in ((toxic, c1), (clean, c0)):
        for w, n in counts.items():
            ks = keys(w)
            for a, b in zip(ks, (*ks[1:], None), strict=True):
                into[a] += n
                parent[a] = b
    # The scale must not make one sighting of a rare word strong: the larger weight is spread over the prior too.
    prior = cfg.prior * max(f1, f0)
    rate: dict[str, float] = {}

    def of(k: str | None) -> float:
        if k is None:
            return 0.5
        if k not in rate:
            rate[k] = (c1[k] * f1 + prior * of(parent[k])) / (c1[k] * f1 + c0[k] * f0 + prior)
        return rate[k]

    # Only keys that can score, or that shield a word from a beginning that does, are kept: the rest just cost.
    least = 1 / (1 + np.exp(-cfg.cost / 2))
    return {k: float(np.clip(np.log(of(k) / (1 - of(k))), -cfg.top, cfg.top)) for k in parent if of(k) > least or of(parent[k]) > least}


def fit(rows: list[tuple[int, list[str]]], cfg: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """Fit on (label, tokens). The log-odds are learnt crosswise, each of cfg.folds parts scored by the counts of the others, for the
    extreme-value fit and the calibration, so that neither sees a text's own counts; the model then takes all rows."""
    counts = [[Counter(), Counter()] for _ in range(cfg.folds)]
    for k, (y, tokens) in enumerate(rows):
        counts[k % cfg.folds][y].update(tokens)
    both = [sum((c[y] for c in counts), Counter()) for y in (0, 1)]
    model = ToxicModel(log_odds(both[1], both[0], cfg), 1.0, 0.0, 1.0, 0.0, cfg)
    others = [ToxicModel(log_odds(both[1] - c[1], both[0] - c[0], cfg), 1.0, 0.0, 1.0, 0.0, cfg) for c in counts]
    memos: list[dict[str, float]] = [{} for _ in counts]
    scored = [(y, others[k % cfg.folds]._scores(t, memos[k % cfg.folds])) for k, (y, t) in enumerate(rows) if t]
    null = np.concatenate([np.array(s) for y, s in scored if not y] or [np.array([-cfg.cost])])
    lo, hi = 1e-3, 8.0  # lambda: the mean of exp(lambda * score) over clean tokens is 1
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.exp(mid * null).mean() < 1 else (lo, mid)
    model.lam = min(lo, 4.0)
    best = [(np.log(len(s)), max((x for *_, x in segments(s)), default=0.0)) for y, s in scored if not y]
    if best:
        n, m = np.array(best).T
        model.log_k = float((model.lam * m - n).mean() - 0.5772156649)
    x = np.log1p([sum(-np.log(max(e, 1e-30)) for *_, e in model._significant(s)) for _, s in scored])
    model.slope, model.bias = _logistic(x, np.array([y for y, _ in scored], float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt scaling: logistic regression on one feature. Targets are drawn in by one row of each class, so that separable data
    have an optimum too; Newton steps are halved until the loss falls, so that they can't run away from it."""
    w = np.zeros(2)
    if not len(x):
        return 0.0, 0.0
    z = np.column_stack([x, np.ones(len(x))])
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    ridge = np.array([0.01, 0.01])

    def loss(v: np.ndarray) -> float:
        m = z @ v
        return float((np.logaddexp(0, m) - t * m).sum() + (ridge * v * v).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - t) + ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        new = loss(w - size * step)
        if size <= 1e-6 or now - new < 1e-10 * (1 + now):
            break
        w, now = w - size * step, new
    return float(w[0]), float(w[1])


def fit_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cfg: ToxicConfig = ToxicConfig()) -> ToxicModel:
    """Fit on a bounded sample: of each class the labels whose hashed id comes first, cfg.fit_rows at most, and of their texts, in
    that order, as many as hold cfg.fit_tokens tokens (the first one always). The sample is drawn from ids; texts are never shuffled by it."""
    sample = first_labelled(docs, labels, id_col, label_col, (0, 1), cfg.fit_rows, cfg.seed)
    texts = docs.select(name(id_col).cast("long").alias("id"), name(text_col).alias("text")).where("text is not null")

    def rows(ids, texts, ys, places):
        for i, t, y, p in zip(ids, texts, ys, places, strict=True):
            tokens = words(t)
            yield i, y, p, len(tokens), " ".join(tokens)

    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("place", pa.int64()), ("n", pa.int64()), ("tokens", pa.string())])
    joined = texts.join(F.broadcast(sample), "id").select("id", "text", "y", "place")  # at most 2 * cfg.fit_rows ids
    found = arrow_map(joined, rows, "id long, y int, place long, n long, tokens string", schema)
    order = Window.partitionBy("y").orderBy("place", "id", "tokens")
    # A repeated id may bring more texts than ids: the bound holds for rows too.
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cfg.fit_rows)
    found = found.withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("rank") == 1) | (F.col("total") <= cfg.fit_tokens))

    def fitted(batches):
        held = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for p, y, t in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    held.append((p, y, t, list(map(sys.intern, t.split()))))  # one object per word: the sample stays small
        if held:
            held.sort(key=lambda r: r[:3])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(y, w) for _, y, _, w in held], cfg))], pa.binary())], names=["model"])

    # The sample is bounded, so that one task can fit on it; the driver gets the model only.
    model = found.select("place", "y", "tokens").repartition(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(model["model"]) if model else fit([], cfg)


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_passages, evidence) of every row's whole text, in one narrow pass; null and empty texts score as texts
    without a passage. Other columns are ignored; repeated rows repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample
    memo: dict[str, float] = {}

    def rows(ids, texts):
        if len(memo) > REMEMBERED:
            memo.clear()
        for i, t in zip(ids, texts, strict=True):
            yield i, *shared.value.score(t, memo)

    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n_passages", pa.int64()), ("evidence", pa.float64())])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, "id long, score double, n_passages long, evidence double", schema).withColumnRenamed("id", id_col)


def passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, score, expected) of every significant passage, in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids, texts):
        memo: dict[str, float] = {}
        for i, t in zip(ids, texts, strict=True):
            for span in shared.value.spans(t, memo):
                yield i, *span

    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, "id long, start long, end long, score double, expected double", schema).withColumnRenamed("id", id_col)


def score_column(model: ToxicModel, text: Column, spark: SparkSession) -> Column:
    """The score of a text as a column, so that a filter by it moves no rows."""
    shared = spark.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        if len(memo) > REMEMBERED:
            memo.clear()
        return pd.Series([shared.value.score(t, memo)[0] for t in texts], dtype=float)

    return of(text)

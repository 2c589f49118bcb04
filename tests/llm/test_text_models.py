import random
import zlib

import pytest

from corpusloom.llm import langid, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = registry.op7_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    assert sum(r.rejected for r in rows) <= 0.002 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    model = langid.fit([("en", "the cat and the dog in the house of the man"), ("fr", "le chat et le chien dans la maison de la dame"), ("en", "")])
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "12 !?", 1.0), (4, "the dog and the man", 1.0), (4, "the dog and the man", 1.0), (None, "le chien et la dame", 1.0), (6, "the man " * 30_000, 1.0), (7, "Привет мир " * 20, 1.0)], "doc_id long, text string, score double")
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(docs, model).collect()}
    assert got >= {(1, "und", True), (2, "und", True), (3, "und", True), (4, "en", False), (None, "fr", False), (6, "en", False)}
    assert any(i == 7 and r for i, _, r in got)
    assert docs.where(langid.accepted(model, docs["text"], spark)).count() == 4
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit_table(empty.selectExpr("doc_id", "text", "'en' lang"))).count() == 0


def brute_segments(scores):
    """All maximal segments by repeated search for the best one (leftmost, shortest), left and right of it."""
    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (found is None or total > found[2]):
                    found = (a, b + 1, total)
        if not found:
            return []
        return best(lo, found[0]) + [found] + best(found[1], hi)
    return best(0, len(scores))


@pytest.mark.parametrize("seed", range(30))
def test_segments_against_brute_force(seed):
    rng = random.Random(seed)
    scores = [rng.choice([-7, -3, -2, -1, 0, 2, 5, 9]) + rng.random() / 64 for _ in range(rng.randint(0, 40))]
    assert [(a, b, pytest.approx(s)) for a, b, s in brute_segments(scores)] == toxicity.segments(scores)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.op9_toxicity_segments(spark, SF).join(labels, "doc_id", "left").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert not any(r.predicted for r in rows if r.toxic == 0)
    ranked = sorted((r for r in rows if r.held_out and r.toxic is not None), key=lambda r: -r.score)
    positives = sum(r.toxic for r in ranked)
    assert sum(r.toxic for r in ranked[:positives]) >= 0.7 * positives


def test_toxicity_edges_and_spans(spark):
    rows = [(1, ["the", "fine", "idiotaaa", "man"])] * 30 + [(0, ["the", "fine", "good", "man"])] * 60
    model = toxicity.fit(rows)
    text = "the fine man " * 20 + "Idiotaaa idiotbbb " + "the fine man " * 20
    docs = spark.createDataFrame([(1, None), (2, ""), (3, text), (3, text), (None, "the good man")], "doc_id long, text string")
    got = toxicity.score(docs, model).collect()
    assert len(got) == 5 and {r.score for r in got if r.doc_id in (1, 2)} == {r.score for r in got if r.doc_id is None}
    assert all(r.score > 0.5 for r in got if r.doc_id == 3)
    assert {text[r.start : r.end] for r in toxicity.passages(docs, model).collect()} == {"Idiotaaa idiotbbb"}
    assert toxicity.score(docs.limit(0), toxicity.fit([])).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = registry.op8_quality_co_training(spark, SF).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    hit = [sum(r.predicted == r.quality for r in held if r.quality == y) / sum(r.quality == y for r in held) for y in (0, 1)]
    assert sum(hit) / 2 >= 0.8, hit


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "", "s", "en", 0, "x"), (2, "a b " * 50_000, "s", "en", 5, "x")], "doc_id long, text string, source string, lang string, n_chars long, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit_table(docs, labels)).collect()] == [0.5] * 3
    assert quality.score(docs.limit(0), quality.fit_table(docs.limit(0), labels)).count() == 0

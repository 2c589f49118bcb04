import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = "the cat and dog in house of man with that this from which where good small green walk talk over under road river stone light".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, an empty table's columns, nulls and a repeated id; labels for some of them."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 60), "en", f"s{i % 3}", 300) for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", "s", 300) for i in range(3)]
    rows += [(200, rows[1][1] + " extra", None, None, None), (201, None, "en", "s", 0), (202, "", "en", "s", 0), (203, " 12 ", "en", "s", 4), (None, prose(rng, 50), "en", "s", 1)]
    rows += [(300, rows[2][1], "en", "s", 1), (300, prose(rng, 55), "en", "s", 1)]
    rows += [(400 + i, "vile vermin filth " * 12 + prose(rng, 20), "en", "s", 1) for i in range(8)]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 400)) for i, *_ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs, rows


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "MinHash near-dedup", "packing"]


def test_language_stage(spark, corpus):
    path, docs, rows = corpus
    kept = corpus_pipeline.language(spark, docs, path)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, *_ in rows if i not in (201, 202, 203))


def test_toxicity_stage(spark, corpus):
    path, docs, rows = corpus
    kept = corpus_pipeline.toxic(spark, docs, path)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not any(i is not None and i >= 400 for i in ids) and len(ids) == len(rows) - 8
    unlabelled = spark.read.parquet(f"{path}/labels.parquet").limit(0)
    assert corpus_pipeline.registry.toxic_model(docs, unlabelled).odds == {}


def test_near_duplicate_stage_by_brute_force(spark, corpus):
    path, docs, rows = corpus
    docs = docs.withColumn("text_key", docs["source"])
    kept = corpus_pipeline.near_duplicates(spark, docs, path)
    assert kept.columns == docs.columns

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    gone = [k for k, (i, s) in enumerate(sets) if i is not None and s and any(j is not None and j < i and u and 100 * len(s & u) >= 80 * len(s | u) for j, u in sets)]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for k, (i, _) in enumerate(sets) if k not in gone)


def test_whole_run(spark, corpus):
    path, docs, _ = corpus
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in rows} == {*range(40), None, 300}
    assert all(0 < r.length <= 2048 for r in rows)


def test_empty_tables(spark, corpus, tmp_path):
    path, docs, _ = corpus
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

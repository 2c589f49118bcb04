import random
import re

import numpy as np
import pytest

from corpusloom.llm import minhash
from corpusloom.llm.components import components
from corpusloom.llm.minhash import MinHashConfig, near_duplicates

CFG = MinHashConfig(shingle=2)


def brute(rows, size=2, percent=80):
    """Every pair of sets of word tuples."""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 6, 12])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i * 3 + 5, " ".join(words)))
    return rows + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "Alone"), (1004, "alone"), (1005, "Éa"), (1006, "éa"), (1007, "a b")]


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limit", [24, 2])
def test_against_brute_force(spark, seed, limit):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string")
    assert got(near_duplicates(df, cfg=MinHashConfig(shingle=2, pair_limit=limit, block=8))) == brute(rows)


def test_empty_table_and_null_id(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), cfg=CFG).count() == 0
    rows = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string"), cfg=CFG).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows) == [("4", 4, True), ("4", 4, True), ("None", 4, True)]


def test_repeated_ids_are_linked_by_their_own_texts(spark):
    """An id that is the smallest of several classes: every row's component comes from its own text alone."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(6)]
    rows = [(9, texts[0]), (9, texts[1]), (3, texts[1] + " tail"), (4, "x y z"), (9, texts[2]), (9, texts[2]), (12, texts[2] + " more"), (9, texts[3]), (12, texts[3] + " end"), (12, texts[4]), (20, texts[4]), (9, None), (9, "x y z")]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cfg=CFG).collect()
    sets = brute(list(enumerate(t for _, t in rows)))
    groups = {k: [j for j in sets if sets[j][1] == sets[k][1]] for k in sets}
    expected = sorted((i, sets[k][0], min(rows[j][0] for j in groups[k])) for k, (i, _) in enumerate(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_sequential_look_keeps_true_pairs():
    assert all(m <= 0.8 * n for n, m in minhash.least_matches(192, 32, 0.8, 1e-6))
    sig = np.arange(192, dtype=np.uint32)[None, :]
    assert minhash.plausible(sig, sig, CFG).all()
    assert not minhash.plausible(sig, sig + 1, CFG).any()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}

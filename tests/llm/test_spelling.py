import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import spelling
from corpusloom.llm.spelling import SpellingConfig


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, mutate):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if mutate and h % mutate == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                count[w] += 1
    n = {w: k for w, k in count.items() if k >= 3}
    out = {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        form = others[0][1] if others and -others[0][0] >= 2 * n[w] else None
        out[w] = [form, n[w], len(others), n[form] if form else None]
    for w in n:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return {w: (f, r, k, m, fn) for w, (f, k, m, fn, r) in out.items()}


def found(spark, rows, cfg):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.vocabulary(docs, cfg=cfg), cfg).collect()}


@pytest.mark.parametrize(("seed", "symbols", "flush"), [(1, 8, 20), (2, 2, 400_000), (3, 1, 400_000)])
def test_against_all_pairs(spark, seed, symbols, flush):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeé×") for _ in range(rng.randint(4, 9))) for _ in range(12)]
    words = []
    for w in base:
        words += [w] * rng.randint(3, 40)
        for _ in range(6):
            k, c = rng.randrange(len(w)), rng.choice("abczß")
            words += [rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])] * rng.randint(1, 12)
    rng.shuffle(words)
    rows = [(i, rng.choice(" ,\n-ā中1").join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20 + 1)]
    rows += [(None, "Hello hello HELLO Éhello éhello éhello éhello"), (500, None), (501, ""), (502, " 12 é ")]
    assert found(spark, rows, SpellingConfig(symbols=symbols, flush=flush, mutate=7)) == brute(rows, 7)
    assert found(spark, rows, SpellingConfig(symbols=symbols, flush=flush)) == brute(rows, 0)


def test_ties_repeated_rows_and_chains(spark):
    text = " ".join(["water"] * 40 + ["watar"] * 20 + ["wator"] * 20 + ["vatar"] * 10 + ["vatax"] * 5 + ["waters"] * 19)
    rows = [(1, text), (1, text)]
    got = found(spark, rows, SpellingConfig())
    assert got == brute(rows, 0)
    assert got["vatax"][:2] == ("vatar", "water") and got["vatar"][0] == "watar" and got["waters"][0] == "water"


def test_long_words_and_empty_table(spark):
    long = "abcdefghij" * 400
    rows = [(1, f"{long} {long} {long} {long[:-1]} {long[:-1]} {long[:-1]} {long[:-1]} {long[:-1]} {long[:-1]}")]
    assert found(spark, rows, SpellingConfig()) == brute(rows, 0)
    assert found(spark, [], SpellingConfig()) == {}


def test_neighbourhood_is_that_of_the_reduced_word():
    for s in ([1, 2, 3, 1], [2, 2, 2], [3]):
        keys, lengths = spelling.neighbourhood(np.array(s), 3)
        edits = {(tuple(s[:i] + [c] + s[i + 1 :]), len(s)) for i in range(len(s)) for c in range(s[i], 4)}
        edits |= {(tuple(s[:i] + s[i + 1 :]), len(s) - 1) for i in range(len(s)) if len(s) > 1}
        assert sorted(zip(keys.tolist(), lengths.tolist(), strict=True)) == sorted((int(spelling.reduced_key(np.array(e))), n) for e, n in edits)

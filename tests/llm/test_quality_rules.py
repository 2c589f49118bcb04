import random
import re

from corpusloom.llm import quality_rules
from corpusloom.llm.quality_rules import RuleConfig

WORD = r"[^\x20\x09-\x0D]+"


def plain_measures(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(hit), len(lines)


def plain_judge(rows, least_docs):
    """Fences from sorted values: the bucket of the value of each quartile's rank."""
    seen = [(lang, source, m, m[0] < 50 or 100 * m[4] > 50 * m[0]) for _, text, lang, source in rows for m in [plain_measures(text)]]
    ratios = lambda m: [10000 * m[2] // m[1], 100 * m[1] // m[0], 10000 * m[3] // m[5], 10000 * m[4] // m[0]]
    low = lambda v: v >> max(0, v.bit_length() - 7) << max(0, v.bit_length() - 7)
    out = []
    for lang, source, m, failed in seen:
        if failed:
            out.append((*m[:5], True, False))
            continue
        for level in (lambda x: x[:2] == (lang, source), lambda x: x[0] == lang, lambda x: True):
            group = [ratios(x[2]) for x in seen if not x[3] and level(x)]
            if len(group) >= least_docs:
                break
        good = True
        for k, least in enumerate((80, 30, 1000, 800)):
            values = sorted(low(g[k]) for g in group)
            q1, q2, q3 = (values[-(-len(values) * q // 4) - 1] for q in (1, 2, 3))
            reach = 5 * max(q3 - q1, least)
            good &= ratios(m)[k] <= q2 + reach and (k != 1 or ratios(m)[k] >= q2 - reach)
        out.append((*m[:5], False, good))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(130):
        n = rng.choice([10, 49, 50, 80, 300])
        words = [rng.choice(vocab) for _ in range(n)]
        if rng.random() < 0.15:
            words = [w if rng.random() < 0.6 else "#$%|" * rng.randint(1, 9) for w in words]
        if rng.random() < 0.2:
            words[n // 2 :] = words[: n - n // 2]
        text = "".join(w + rng.choice([" ", " ", "\t", "\n", "\r\n", "\x0b"]) for w in words)
        if rng.random() < 0.3:
            text += ("\n" + "same line here") * rng.randint(1, 6)
        rows.append((i, text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "a", "a", "b", None])))
    return [*rows, (500, None, "en", "a"), (501, "", "en", "a"), (502, " \n \t", "en", "a"), (None, "word " * 60, "en", "a"), (7, "one two three " * 30, "en", "a")]


def found(spark, rows, cfg=RuleConfig()):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_words int, group string")
    return [tuple(r)[1:8] for r in quality_rules.judge(docs, cfg=cfg).collect()]


def test_against_plain_loops(spark):
    key = lambda r: tuple(map(str, r))
    for seed, least in ((1, 12), (2, 30)):
        rows = corpus(seed)
        expected = plain_judge(rows, least)
        assert sorted(found(spark, rows, RuleConfig(least_docs=least)), key=key) == sorted(expected, key=key)
        assert {e[6] for e in expected if not e[5]} == {True, False}


def test_symbols_of_an_outlier_and_clean_texts(spark):
    rng = random.Random(3)
    words = [f"word{chr(97 + k % 26)}" for k in range(90)]
    clean = [(i, " ".join(rng.sample(words, 70)), "en", f"s{i % 3}") for i in range(60)]
    rows = [*clean, (100, clean[0][1] + " ###" * 30, "en", "s0"), (101, clean[1][1] + " 5 > 3", "en", "s1")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in kept.items() if not k] == [100]


def test_sketches_merge_to_the_sketch_of_all(spark):
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string, lang string, source string")
    profiled = quality_rules.profile(docs).cache()
    parts = quality_rules.sketch(profiled.where("id % 2 = 0")).unionByName(quality_rules.sketch(profiled.where("id % 2 <> 0 or id is null")))
    once = quality_rules.merge(quality_rules.sketch(profiled), "lang")
    assert sorted(map(str, quality_rules.merge(parts, "lang").collect())) == sorted(map(str, once.collect()))


def test_very_long_text_and_empty_table(spark):
    text = "a b c d e " * 200_000
    assert found(spark, [(1, text, "en", "a")]) == [(1_000_000, 1_000_000, 0, 0, 1_000_000, True, False)]
    assert found(spark, []) == []

"""Places of passages in texts, against an alignment at every place of every pair."""

import random
import re

import pytest

from corpusloom.operators import highlight

WORD = re.compile(r"[^\W_]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[j - 1] + 1))
    return row[-1]


def brute(docs, passages):
    """Every run of words of every text against every passage; the fewest edits, then the first place (its length may tie)."""
    found = {}
    for doc, text in docs:
        at = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        ws = [text[a:b].lower() for a, b in at]
        for item, passage in passages:
            pw = [x.lower() for x in WORD.findall(passage or "")]
            k = len(pw) // 10
            runs = [(distance(ws[s:e], pw), s, e) for s in range(len(ws)) for e in range(max(s + 1, s + len(pw) - k), min(len(ws), s + len(pw) + k) + 1)] if pw else []
            runs = [x for x in runs if x[0] <= k]
            if runs:
                found[doc, item] = (min(runs)[0], min(at[s][0] + 1 for e, s, _ in runs if e == min(runs)[0]))
    return found


def texts(seed):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "x1"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passages = [(i, words(n)) for i, n in enumerate([1, 2, 3, 4, 7, 10, 12, 20, 23, 31])]
    docs = []
    for d in range(30):
        body = words(r.randint(0, 25))
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(passages)[1])
            for _ in range(r.randint(0, len(p) // 10 + 1)):
                at, how = r.randrange(len(p) + 1), r.randint(0, 2)
                p[at : at + (how > 0)] = [r.choice(vocabulary)] if how < 2 else []
            body += p + words(r.randint(0, 6))
        docs.append((d, r.choice(["", "- ", "(\n"]) + r.choice([" ", ", ", "\n\n"]).join(body) + r.choice(["", "."])))
    return docs, [(i, " ".join(p).upper() if i % 3 == 0 else " ".join(p)) for i, p in passages]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, passages = texts(seed)
    got = highlight.highlights(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")).collect()
    assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})
    assert {(r["doc_id"], r["item_id"]): (r["edits"], r["start_at"]) for r in got} == brute(docs, passages)
    assert {r["stage"] for r in got} == {"exact", "normalised", "fuzzy"}


def test_stages_and_offsets(spark):
    text = "«Ein» Satz: Öffnen Sie das Ventil, dann warten Sie; zehn Minuten lang bis zum Ton."
    passages = [(1, "öffnen SIE das ventil"), (2, " Öffnen Sie das Ventil, "), (3, "Ton"), (4, "das Ventil dann warten Sie elf Minuten lang bis zum"), (5, "Ventil warten"), (6, "..."), (7, None), (8, "Ton"), (8, "lang")]
    docs = [(1, text), (1, text), (1, "ton"), (2, None), (3, ""), (None, "Ein Ton")]
    got = highlight.highlights(spark.createDataFrame([(*x, "z", 0) for x in docs], "doc_id long, text string, passage string, k int"), spark.createDataFrame(passages, "item_id long, text string")).collect()
    seen = sorted((r["doc_id"] or 0, r["item_id"], r["stage"], r["edits"], r["start_at"], r["n"]) for r in got)
    fuzzy = text.index("das Ventil")
    place = lambda x: (text.index(x) + 1, len(x))
    assert seen == sorted(
        [(0, i, "exact", 0, 5, 3) for i in (3, 8)]
        + [(1, i, "normalised", 0, 1, 3) for i in (3, 8)]
        + [(1, 1, "normalised", 0, *place("Öffnen Sie das Ventil")), (1, 2, "exact", 0, *place("Öffnen Sie das Ventil")), (1, 3, "exact", 0, *place("Ton")), (1, 8, "exact", 0, *place("Ton")), (1, 8, "exact", 0, *place("lang"))]
        + [(1, 4, "fuzzy", 1, fuzzy + 1, len("das Ventil, dann warten Sie; zehn Minuten lang bis zum"))]
    )


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    one = spark.createDataFrame([(1, 1, "a b")], "doc_id long, item_id long, text string")
    for docs, passages in ((none, one), (one, none), (none, none)):
        assert highlight.highlights(docs, passages).collect() == []

import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import prefix_trie
from corpusloom.llm.prefix_trie import Parentheses, encode, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows, cycle):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % cycle if cycle else 0
        base = c - c % 5 if c >= 0 else c + (-c) % 5
        convs[c] = tuple(own.get(base, [])[:h] + turns[h:]) if cycle else tuple(turns)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        childless = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(x) == len(node) + 1 for x in under), len(childless), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-12, 100), n):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice("ab" if t < 4 else "abcdé") * (t + 1)))
    for c in range(200, 240):  # copies, and longer ones
        rows += [(c, t, "user", f"shared {t}") for t in range(12 if c % 3 else 15)]
    return rows


def found(spark, rows, **more):
    df = trie(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), **more)
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize(("seed", "cycle", "limit", "share", "shard"), [(1, 9, 64, 4096, 20_000), (2, 9, 1, 10**6, 3), (3, 0, 2, 10**6, 5), (4, 0, 64, 4096, 1)])
def test_against_brute_force(spark, seed, cycle, limit, share, shard):
    rows = corpus(seed)
    assert found(spark, rows, cycle=cycle, least_limit=limit, spine_share=share, shard_chains=shard) == brute(rows, cycle)


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(1, 2, "user", "late"), (1, None, None, None), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", None), (None, 1, "user", "x"), (3, 1, "user", "x"), (3, 1, "user", "x"), (4, 1, "b", "y"), (4, 1, "a", "z"), (5, 7, "a", "z")]
    assert found(spark, rows, cycle=0) == brute(rows, 0)
    assert found(spark, rows, cycle=9) == brute(rows, 9)
    assert found(spark, [], cycle=9) == []


def test_blocks_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, t, "user", f"t{t}") for c in (1, 2, 3) for t in range(-3, 20 + c)] + [(9, t, "user", f"t{t}" if t < 11 else f"x{t}") for t in range(-3, 30)]
    assert found(spark, rows, cycle=0) == brute(rows, 0)
    assert found(spark, rows, cycle=9) == brute(rows, 9)


def test_pieces_of_a_node_s_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    rows = [(c, 0, "user", "same") for c in range(90, 131)]
    assert found(spark, rows, cycle=0) == brute(rows, 0)


@pytest.mark.parametrize("width", [1, 2, 3, 8, 64])
def test_parentheses_and_forests(width):
    rng = random.Random(width)
    for n in (1, 2, 5, 40, 300):
        parents = np.array([rng.choice([-1, *range(max(0, i - 6), i)]) if i else -1 for i in range(n)])
        bits, stack = [], []
        kids = {p: [i for i in range(n) if parents[i] == p] for p in range(-1, n)}

        def walk(v):
            bits.append(1)
            for k in kids[v]:
                walk(k)
            bits.append(0)

        for r in kids[-1]:
            walk(r)
        forest = Parentheses(np.array(bits, np.int8), width)
        for at, bit in enumerate(bits):
            if bit:
                stack.append(at)
            else:
                assert forest.close(stack.pop()) == at
        saved, extra = np.array([rng.randrange(9) for _ in range(n)]), np.array([rng.choice([0, 0, 3]) for _ in range(n)])
        children, leaves, sums = encode(parents, saved, extra)

        def total(v):
            below = [total(k) for k in kids[v]]
            return (1 if not below and not extra[v] else 0) + extra[v] + sum(x for x, _ in below), saved[v] + sum(y for _, y in below)

        assert [(children[v], leaves[v], sums[v]) for v in range(n)] == [(len(kids[v]), *total(v)) for v in range(n)]

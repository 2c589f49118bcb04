"""Trie of conversations by their turns: which prefixes are shared, by whom, and what sharing saves.

1. Turns are numbered, optionally rebuilt on the head of another conversation, and each prefix gets a key: the exclusive or of hashes of
   (place, role, text), so that prefixes of very long conversations come from blocks (``prefixes``).
2. Prefixes with one key are one node. Nodes on one path with the same members form a chain, which is one node of a compact trie (``chains``);
   a turn that only one conversation has never grows a trie. There are at most two chains to a conversation.
3. Chains with more members than a limit are the shared spine. Below it, whole subtrees are dealt to shards. Each shard writes its forest as
   balanced parentheses (``Parentheses``): blocks of excess minima find the close of each chain and so delimit its subtree, ranks of the pair ``()``
   count its leaves, and a cumulative array gives what it saves (``encode``).
4. What hangs on the spine is added up by its chains, and the spine, encoded the same way, merges it.
5. Ids of the conversations that end in a node are hashed in order, a piece at a time (``ends``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import materialize, name, spread_join

BLOCK = 4096  # turns of a conversation that one window numbers
EMPTY = hashlib.sha256(b"").hexdigest()
BEFORE = (Window.unboundedPreceding, -1)


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, pos from 0, d1, d2, bytes): turns in order, texts as two 64-bit hashes and their UTF-8 length.

    Turns go by number, null first, ties by role and then by the texts' hashes; null roles and texts are empty. Rows without a conversation go.
    """
    role, text = F.coalesce(name(role_col), F.lit("")), F.coalesce(name(text_col), F.lit(""))
    own = turns.where(name(conv_col).isNotNull()).select(name(conv_col).cast("long").alias("conv_id"), name(turn_col).cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(1), role, text).alias("d2"), F.octet_length(text).cast("long").alias("bytes"))
    own = own.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    inside = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "d1", "d2"))
    before = own.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(*BEFORE))).where("before > 0").select("conv_id", "block", "before")
    return own.withColumn("inside", inside).join(before, ["conv_id", "block"], "left").select("conv_id", (F.col("inside") - 1 + F.coalesce("before", F.lit(0))).alias("pos"), "d1", "d2", "bytes")


def rebuilt(turns: DataFrame, family: int, cycle: int) -> DataFrame:
    """(conv_id, pos, d1, d2, bytes) of ``numbered`` turns, where conversation c begins with the first h turns of conversation c - c % family, in
    place of its own first h; h is crc32 of c in decimals modulo ``cycle``. ``cycle`` 0 or ``family`` 1 leaves everything as it is."""
    if cycle == 0 or family == 1:
        return turns
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % cycle
    base = F.col("conv_id") - F.col("conv_id") % family
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = sizes.where(base != F.col("conv_id")).select("conv_id", base.alias("base"), h.alias("h"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lead"))
    heads = turns.where((base == F.col("conv_id")) & (F.col("pos") < cycle - 1)).withColumnRenamed("conv_id", "base")
    lent = plan.join(heads, "base").where("pos < h").select("conv_id", "pos", "d1", "d2", "bytes")
    short = plan.where("lead < h").select("conv_id", (F.col("h") - F.col("lead")).alias("less"))
    kept = turns.where((base == F.col("conv_id")) | (F.col("pos") >= h)).join(short, "conv_id", "left")
    return kept.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "d1", "d2", "bytes").unionByName(lent)


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, bytes, cum): every prefix of every conversation of ``ids``, the empty one included.

    k1, k2: key of the prefix, p1, p2: of the one before; bytes: of the last text; cum: of all texts.
    """
    at = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), F.floor(F.col("pos") / BLOCK).alias("block"), F.xxhash64("pos", "d1", "d2").alias("h1"), F.xxhash64(F.lit(1), "pos", "d1", "d2").alias("h2"), "bytes")
    up = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id").orderBy("block").rowsBetween(*BEFORE)
    sums = at.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"), F.sum("bytes").alias("b"))
    carry = sums.select("conv_id", "block", F.bit_xor("x1").over(whole).alias("x1"), F.bit_xor("x2").over(whole).alias("x2"), F.sum("b").over(whole).alias("b")).where("b is not null")
    run = at.select("conv_id", "block", "depth", "h1", "h2", "bytes", F.bit_xor("h1").over(up).alias("r1"), F.bit_xor("h2").over(up).alias("r2"), F.sum("bytes").over(up).alias("rb")).join(carry, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("long")
    k1, k2 = F.col("r1").bitwiseXOR(F.coalesce("x1", zero)), F.col("r2").bitwiseXOR(F.coalesce("x2", zero))
    run = run.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("h1")).alias("p1"), k2.bitwiseXOR(F.col("h2")).alias("p2"), "bytes", (F.col("rb") + F.coalesce("b", zero)).alias("cum"))
    return run.unionByName(ids.select("conv_id", *(zero.alias(c) for c in ("depth", "k1", "k2", "p1", "p2", "bytes", "cum"))))


class Parentheses:
    """An ordered forest as a balanced sequence of parentheses (1 opens, 0 closes), in which blocks keep the least excess.

    ``close`` finds where each opening parenthesis ends: in its own block by a scan, otherwise in the next block whose least excess
    falls below that of the opening one, found through a tree of block minima.
    """

    def __init__(self, bits: np.ndarray, width: int = 64):
        self.bits, self.width = bits, width
        excess = np.cumsum(np.where(bits == 1, 1, -1))
        blocks = max(1, -(-len(bits) // width))
        self.excess = np.concatenate([excess, np.full(blocks * width - len(bits), np.iinfo(np.int64).max)])
        self.tree = [self.excess.reshape(blocks, width).min(axis=1)]
        while len(self.tree[-1]) > 1:
            low = self.tree[-1]
            self.tree.append(np.minimum(low[::2], np.append(low[1::2], np.iinfo(np.int64).max)[: len(low[::2])]))
        #: Pairs "()" that begin before each place.
        self.pairs = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))]) if len(bits) else np.zeros(1, np.int64)

    def close(self, at: int) -> int:
        """Place of the parenthesis that closes the one at ``at``: the first later one with a smaller excess."""
        below, block = self.excess[at] - 1, at // self.width
        end = (block + 1) * self.width
        found = np.flatnonzero(self.excess[at + 1 : end] <= below)
        if len(found):
            return at + 1 + int(found[0])
        level, i = 0, block
        while True:  # up to the first block to the right that goes so low
            if i % 2 == 0 and i + 1 < len(self.tree[level]) and self.tree[level][i + 1] <= below:
                i += 1
                break
            level, i = level + 1, i // 2
        while level:
            level, i = level - 1, 2 * i
            if self.tree[level][i] > below:
                i += 1
        return i * self.width + int(np.flatnonzero(self.excess[i * self.width : (i + 1) * self.width] <= below)[0])

    def leaves(self, at: int, end: int) -> int:
        """Pairs "()" in at .. end, both included."""
        return int(self.pairs[end] - self.pairs[at])


def encode(parents: np.ndarray, saved: np.ndarray, extra_leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(children, leaves, saved of the subtree) of each node of a forest, whose ``parents`` hold places or -1.

    ``saved`` is each node's own; ``extra_leaves`` (0 or more) are leaves that hang on a node outside the forest: a childless node with
    some is no leaf itself.
    """
    n = len(parents)
    order = np.argsort(parents, kind="stable")
    first = np.searchsorted(parents[order], np.arange(-1, n + 1))
    bits, opened, at_node = np.zeros(2 * n, np.int8), np.empty(n, np.int64), np.empty(n, np.int64)
    stack, place, count = [*order[first[0] : first[1]][::-1]], 0, 0
    while stack:
        v = stack.pop()
        if v >= 0:
            bits[place], opened[v], at_node[count] = 1, place, v
            count += 1
            stack.append(-1)
            stack.extend(order[first[v + 1] : first[v + 2]][::-1])
        place += 1
    assert place == 2 * n, "a parent that is its own descendant"
    forest = Parentheses(bits)
    children = first[2 : n + 2] - first[1 : n + 1]
    outside = (children == 0) & (extra_leaves > 0)
    total = np.concatenate([[0], np.cumsum(saved[at_node])])
    hung = np.concatenate([[0], np.cumsum((extra_leaves - outside)[at_node])])
    ranks = np.cumsum(bits)  # opening parentheses up to each place: preorder numbers
    leaves, sums = np.empty(n, np.int64), np.empty(n, np.int64)
    for v in range(n):
        at = int(opened[v])
        end = forest.close(at)
        lo, hi = ranks[at] - 1, ranks[end]
        leaves[v] = forest.leaves(at, end) + hung[hi] - hung[lo]
        sums[v] = total[hi] - total[lo]
    return children, leaves, sums


def _encoded(chains: pd.DataFrame) -> pd.DataFrame:
    """One shard (or the spine): ``chains(conv_id, n_convs, pc, pn, own, hung, more, add)`` to their counts and sums."""
    chains = chains.sort_values(["conv_id", "n_convs"], ascending=[True, False]).reset_index(drop=True)
    names = {k: i for i, k in enumerate(zip(chains.conv_id, chains.n_convs, strict=True))}
    parents = np.array([names.get(k, -1) for k in zip(chains.pc, chains.pn, strict=True)], np.int64)
    children, leaves, sums = encode(parents, (chains.own + chains["add"]).to_numpy(np.int64), chains.more.to_numpy(np.int64))
    return pd.DataFrame({"conv_id": chains.conv_id, "n_convs": chains.n_convs, "pc": chains.pc, "pn": chains.pn, "n_children": children + chains.hung, "n_leaves": leaves, "total": sums})


ENCODED = "conv_id long, n_convs long, pc long, pn long, n_children long, n_leaves long, total long"


def chains_of(nodes: DataFrame) -> DataFrame:
    """(conv_id, n_convs, head, tail, before, own, hk, tk): chains of ``nodes``. Nodes of one smallest member and one number of members lie on one path and have the same members.

    head, tail: first and last depth; before: bytes of all texts before the head; own: what the chain saves; hk, tk: keys of the head's parent and of the tail.
    """
    found = nodes.groupBy("conv_id", "n_convs").agg(F.min(F.struct("depth", "p1", "p2", (F.col("cum") - F.col("bytes")).alias("before"))).alias("h"), F.max(F.struct("depth", "k1", "k2", "cum")).alias("t"))
    key = lambda depth, a, b: F.struct(depth.alias("d"), F.col(a).alias("a"), F.col(b).alias("b"))
    return found.select("conv_id", "n_convs", F.col("h.depth").alias("head"), F.col("t.depth").alias("tail"), F.col("h.before").alias("before"), ((F.col("n_convs") - 1) * (F.col("t.cum") - F.col("h.before"))).alias("own"), key(F.col("h.depth") - 1, "h.p1", "h.p2").alias("hk"), key(F.col("t.depth"), "t.k1", "t.k2").alias("tk"))


def ends(paths: DataFrame) -> DataFrame:
    """(tk, ends_sha256): per node in which conversations end, the SHA-256 of their ids, ascending, joined by commas.

    Ids are dealt by ranges of (node, id) and joined to pieces of at most BLOCK; a node's pieces then pass through its hash in order, so no
    task holds more than a piece of a node.
    """
    last = materialize(paths.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("l")).select("l.*", "conv_id"), "lasts")
    key = ["depth", "k1", "k2"]

    def rows(batches) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def out(found, columns):
        chunk = []
        for row in found:
            chunk.append(row)
            if len(chunk) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunk, strict=True)], names=columns)
                chunk = []
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*chunk, strict=True)], names=columns)

    def pieces(batches):
        def cut():
            for node, members in groupby(rows(batches), lambda r: r[:3]):
                held = []
                for r in members:
                    held.append(r[3])
                    if len(held) == BLOCK:
                        yield *node, held[0], ",".join(map(str, held))
                        held = []
                if held:
                    yield *node, held[0], ",".join(map(str, held))

        return out(cut(), [*key, "first", "ids"])

    def digests(batches):
        def hashed():
            for node, parts in groupby(rows(batches), lambda r: r[:3]):
                digest, more = hashlib.sha256(), b""
                for r in parts:
                    digest.update(more + r[4].encode())
                    more = b","
                yield *node, digest.hexdigest()

        return out(hashed(), [*key, "ends_sha256"])

    dealt = last.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    kind = "depth long, k1 long, k2 long, "
    joined = dealt.mapInArrow(pieces, kind + "first long, ids string").repartition(*key).sortWithinPartitions(*key, "first")
    return joined.mapInArrow(digests, kind + "ends_sha256 string").select(F.struct(F.col("depth").alias("d"), F.col("k1").alias("a"), F.col("k2").alias("b")).alias("tk"), "ends_sha256")


def trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 5, cycle: int = 0, least_limit: int = 64, spine_share: int = 4096, shard_chains: int = 20_000) -> DataFrame:
    """One row per distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``family`` and ``cycle`` rebuild conversations (see ``rebuilt``); a cycle of 0 takes them as they are. Chains with more members than
    ``least_limit`` and a ``spine_share``-th of all conversations are the spine, which therefore has at most spine_share nodes a level. A shard has about
    ``shard_chains`` chains, or the largest subtree below the spine if that is more. Null ids take no part; null roles and texts are empty; ties of turns go
    by role and a hash of the text; repeated rows are turns of their own. An empty table gives no rows. Other columns are ignored.
    """
    own = materialize(numbered(turns, conv_col, turn_col, role_col, text_col), "numbered")
    ids = own.select("conv_id").distinct()
    paths = materialize(prefixes(rebuilt(own, family, cycle), ids), "prefixes")
    nodes = materialize(paths.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("bytes").alias("bytes"), F.first("cum").alias("cum")), "nodes")
    chains = materialize(chains_of(nodes), "chains")
    n_convs, n_chains = ids.count(), chains.count()
    limit = max(least_limit, -(-n_convs // spine_share))

    # A head's parent is the tail of another chain; the spine's tails, of many children each, are looked up by salted keys.
    tails = chains.select(F.col("tk").alias("hk"), F.col("conv_id").alias("pc"), F.col("n_convs").alias("pn"))
    linked = spread_join(chains.where("head > 0").select("conv_id", "n_convs", "own", "hk"), tails, "hk").drop("hk").unionByName(chains.where("head = 0").select("conv_id", "n_convs", "own", F.lit(None).cast("long").alias("pc"), F.lit(None).cast("long").alias("pn")))
    linked = materialize(linked, "linked")

    # Where each conversation leaves the spine; nodes of more than limit members are at most rows / limit.
    heavy = F.broadcast(nodes.where(F.col("n_convs") > limit).select("depth", "k1", "k2"))
    tops = paths.join(heavy, ["depth", "k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("top"))
    shards = max(1, n_chains // shard_chains)
    none = F.lit(0).cast("long")
    light = linked.where(F.col("n_convs") <= limit).join(tops, "conv_id").withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)))
    light = light.select("shard", "conv_id", "n_convs", F.coalesce("pc", none).alias("pc"), F.coalesce("pn", none).alias("pn"), "own", none.alias("hung"), none.alias("more"), none.alias("add"))
    done = materialize(light.groupBy("shard").applyInPandas(lambda key, pdf: _encoded(pdf), ENCODED), "shards")

    spine = linked.where(F.col("n_convs") > limit)
    hanging = done.where(F.col("pn") > limit).groupBy("pc", "pn").agg(F.count("*").alias("hung"), F.sum("n_leaves").alias("more"), F.sum("total").alias("add"))
    spine = spine.join(hanging.select(F.col("pc").alias("conv_id"), F.col("pn").alias("n_convs"), "hung", "more", "add"), ["conv_id", "n_convs"], "left")
    spine = spine.select(F.lit(0).alias("shard"), "conv_id", "n_convs", F.coalesce("pc", none).alias("pc"), F.coalesce("pn", none).alias("pn"), "own", *(F.coalesce(c, none).alias(c) for c in ("hung", "more", "add")))
    merged = spine.groupBy("shard").applyInPandas(lambda key, pdf: _encoded(pdf), ENCODED)

    counted = done.unionByName(merged)
    full = chains.select("conv_id", "n_convs", "head", "tail", "before", "tk").join(counted, ["conv_id", "n_convs"]).join(ends(paths), "tk", "left")
    full = materialize(full.select(F.struct("conv_id", "n_convs").alias("chain"), "head", "tail", "before", "pc", "pn", "n_children", "n_leaves", "total", "ends_sha256"), "chained")
    each = spread_join(nodes.select(F.struct("conv_id", "n_convs").alias("chain"), "depth", "bytes", "cum"), full, "chain")
    at_tail: Column = F.col("depth") == F.col("tail")
    return each.select(
        F.col("chain.conv_id").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("head"), F.col("chain.conv_id")).when(F.col("depth") > 0, F.col("pc")).alias("parent_conv_id"),
        F.col("chain.n_convs").alias("n_convs"),
        F.when(at_tail, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("total") - (F.col("chain.n_convs") - 1) * (F.col("cum") - F.col("bytes") - F.col("before"))).alias("saved_tokens"),
        F.when(at_tail, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )

"""MinHash near-duplicates with sequential Bayesian verification (BayesLSH).

1. Each text becomes a set of word shingles (64-bit hashes); equal sets form one class, and only one
   member of a class goes on.
2. Classes get a MinHash signature; its bands are hashed to bucket keys.
3. In a first round every class is paired with one class: of the smallest members of its buckets, the one that it
   shares most buckets with. In a second round only what a bucket still holds in different components is compared: all
   pairs in buckets of at most ``pair_limit`` classes, block by block in larger ones, so that hot buckets lose nothing
   and never become rows of pairs.
4. Candidates are verified sequentially: signatures (a byte of each hash) are compared batch by batch, and a pair is
   dropped once the posterior probability that its similarity reaches the threshold is under ``miss``. Bytes that agree
   by chance only keep a pair longer. What is left of the second round is compared on further hashes, made only for texts that share a bucket.
5. Survivors are verified on their full shingle sets, with integers only.
6. Components of the confirmed links give one representative (the smallest id) per group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.shared import arrow_map, drop, materialize, name, spread_join


@dataclass(frozen=True)
class MinHashConfig:
    """shingle: words of a shingle. Links need intersection * 100 >= percent * union. bands x rows: signature.
    more: further hashes, made only for texts that share a bucket. batch: hashes compared at each look. miss: posterior probability under which a pair is dropped.
    pair_limit: bucket size up to which all pairs are candidates. block: classes in a block of a larger bucket.
    hot: rows of a class from which on it is looked up in a broadcast table."""

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6
    more: int = 1024
    batch: int = 32
    miss: float = 1e-5
    pair_limit: int = 24
    block: int = 256
    hot: int = 20_000
    seed: int = 7

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's constants): every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. Words are runs of anything but ASCII white space, A-Z lower-cased.

    A text of fewer words than ``size`` is one shingle of all its words; no text or no words gives an empty set.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, U64)
    if len(_WORDS) > 400_000:
        _WORDS.clear()
    known = _WORDS
    hashes = np.empty(len(words), U64)
    for i, w in enumerate(words):
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        hashes[i] = h
    n = min(size, len(words))
    mixed = np.full(len(words) - n + 1, n, U64)
    for k in range(n):
        mixed = _mix(mixed * U64(0x9E3779B97F4A7C15) + hashes[k : len(words) - n + 1 + k])
    return np.unique(mixed)


@lru_cache(4)
def _seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def signature(shingles: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n minima of permutations a * x + b of 32-bit values; the shingle hashes are mixed already."""
    a, b = _seeds(n, seed)
    out, low = np.full(n, 0xFFFFFFFF, np.uint32), shingles.astype(np.uint32)
    for at in range(0, len(low), 1024):
        out = np.minimum(out, (a[:, None] * low[None, at : at + 1024] + b[:, None]).min(axis=1))
    return _mix(out.astype(U64)).astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key per band, salted by the band's number."""
    rows = sig.reshape(bands, -1).astype(U64)
    key = np.arange(1, bands + 1, dtype=U64)
    for k in range(rows.shape[1]):
        key = _mix(key * U64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


@lru_cache(16)
def least_matches(hashes: int, batch: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """For each look at n hashes, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def plausible(left: np.ndarray, right: np.ndarray, cfg: MinHashConfig) -> np.ndarray:
    """Which of the signature pairs (rows) survive every look; later looks only see what earlier ones left."""
    alive, matches, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for n, least in least_matches(left.shape[1], cfg.batch, cfg.percent / 100, cfg.miss):
        matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def shingled(docs: DataFrame, id_col: str, text_col: str, cfg: MinHashConfig) -> DataFrame:
    """(id, n, class_key, sig, keys, text_key) of every row; text_key is Spark's xxhash64 of the text, class_key is a 128-bit digest of the whole set, null if it is empty."""

    def rows(ids, texts, text_keys):
        for i, text, t in zip(ids, texts, text_keys, strict=True):
            s = shingle_set(text, cfg.shingle)
            if not len(s):
                yield i, 0, None, None, None, t
                continue
            sig = signature(s, cfg.hashes, cfg.seed)
            yield i, len(s), xxhash.xxh3_128_digest(s.tobytes()), sig.astype(np.uint8).tobytes(), band_keys(sig, cfg.bands).tolist(), t

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("class_key", pa.binary()), ("sig", pa.binary()), ("keys", pa.list_(pa.int64())), ("text_key", pa.int64())])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col), F.xxhash64(name(text_col))), rows, "id long, n long, class_key binary, sig binary, keys array<long>, text_key long", schema)


def _size_ok(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _survivors(pairs: DataFrame, sigs: DataFrame, cfg: MinHashConfig, hashes: int) -> DataFrame:
    """Candidate pairs (a, b) that pass the sequential comparison of their signatures ``sigs(rep, sig)``."""
    joined = spread_join(pairs, sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, hashes) for c in (2, 3))
            keep = pa.array(plausible(left, right, cfg))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _bags(reps: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, cfg: MinHashConfig) -> DataFrame:
    """(rep, bag, sig): full sets and cfg.more further hashes of one text of each class in ``reps(rep)``, in one pass over the texts."""
    wanted = reps.select("rep").distinct().join(classes, "rep").select("rep", F.col("first_id").alias("id"), F.col("first_text").alias("text_key"))
    wanted = materialize(wanted, "wanted")
    ids = materialize(wanted.select("id").distinct(), "wanted-ids")  # ids alone: their size is known, so that Spark can broadcast few of them; only what they keep is joined by text
    texts = docs.select(name(id_col).cast("long").alias("id"), name(text_col).alias("text")).join(ids, "id", "left_semi")
    texts = texts.withColumn("text_key", F.xxhash64("text")).join(wanted, ["id", "text_key"]).select("rep", "text")

    def run(batches):
        seen = set()  # rows that repeat an id with its text give one bag a task
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for i, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if i not in seen:
                        seen.add(i)
                        s = shingle_set(text, cfg.shingle)
                        out.append((i, s.tobytes(), signature(s, cfg.more, cfg.seed + 1).astype(np.uint8).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["rep", "bag", "sig"])

    bags = materialize(texts.mapInArrow(run, "rep long, bag binary, sig binary"), "bags")
    if bags.groupBy("rep").count().where("count > 1").isEmpty():
        return bags
    once = materialize(bags.dropDuplicates(["rep"]), "bags")
    drop(bags)
    return once


def _confirmed(pairs: DataFrame, bags: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """Pairs whose full sets meet the threshold."""
    joined = spread_join(pairs, bags.select(F.col("rep").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("rep").alias("b"), F.col("bag").alias("y")), "b").select("a", "b", "x", "y")

    def check(a, b, x, y):
        for i, j, left, right in zip(a, b, x, y, strict=True):
            left, right = np.frombuffer(left, U64), np.frombuffer(right, U64)
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= cfg.percent * (len(left) + len(right) - both):
                yield i, j

    return arrow_map(joined, check, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _block_survivors(hot: DataFrame, sigs: DataFrame, keys: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """All plausible pairs of different components inside the buckets of ``hot(key, rep, n, cnt, comp, home)``.

    Members of a bucket are dealt by (in the home component?, size class, hash) to blocks of about cfg.block; blocks
    meet if their size classes can hold similar sets and not both are of the home component. A pair that shares several
    buckets is compared in the first of them only (if that is a small one, among its pairs), and only survivors become rows.
    """
    step = 100 / cfg.percent
    dealt = hot.select("key", "rep", "n", "comp", (F.col("comp") == F.col("home")).alias("at_home"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step))).alias("cls"), F.pmod(F.xxhash64("rep"), F.ceil(F.col("cnt") / F.lit(cfg.block))).alias("slot")).join(sigs.select("rep", "sig"), "rep").join(keys.select("rep", "keys"), "rep")
    blocks = materialize(dealt.groupBy("key", "at_home", "cls", "slot").agg(F.collect_list(F.struct("rep", "n", "comp", "sig", "keys")).alias("m")), "blocks")
    left, right = (blocks.select("key", F.col("at_home").alias(f"h{s}"), F.col("cls").alias(f"c{s}"), F.col("slot").alias(f"s{s}")) for s in "ab")
    # Pairs of blocks are made from their names; each block's members then go to its own pairs, so that a hot bucket is many tasks' work.
    met = left.join(right, "key").where("not (ha and hb) and abs(ca - cb) <= 1 and struct(ha, ca, sa) <= struct(hb, cb, sb)")
    for s in "ab":
        met = met.join(blocks.select("key", F.col("at_home").alias(f"h{s}"), F.col("cls").alias(f"c{s}"), F.col("slot").alias(f"s{s}"), F.col("m").alias(f"m{s}")), ["key", f"h{s}", f"c{s}", f"s{s}"])
    met = met.select("key", "ma", "mb")

    def rows(shared, left, right):
        for key, x, y in zip(shared, left, right, strict=True):
            rx, ry = (np.array([m["rep"] for m in side]) for side in (x, y))
            nx, ny = (np.array([m["n"] for m in side]) for side in (x, y))
            cx, cy = (np.array([m["comp"] for m in side]) for side in (x, y))
            sx, sy = (np.frombuffer(b"".join(m["sig"] for m in side), np.uint8).reshape(-1, cfg.more) for side in (x, y))
            kx, ky = (np.array([m["keys"] for m in side], np.int64) for side in (x, y))
            for i in range(len(rx)):
                to = np.flatnonzero((cy != cx[i]) & (kx[i][(ky == kx[i]).argmax(axis=1)] == key) & (np.minimum(ny, nx[i]) * 100 >= np.maximum(ny, nx[i]) * cfg.percent))
                if len(to):
                    for j in to[plausible(np.broadcast_to(sx[i], (len(to), cfg.more)), sy[to], cfg)]:
                        yield int(min(rx[i], ry[j])), int(max(rx[i], ry[j]))

    return arrow_map(met, rows, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]), chunk=1).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: MinHashConfig = MinHashConfig()) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, class_id, component_id, kept, text_key), text_key being Spark's xxhash64 of the text.

    class_id: smallest id with the same shingle set; component_id: smallest id reached over links; kept: id is its
    component's. Null or empty texts, and texts of white space, have n_shingles 0 and stay alone. A row with a null id takes the component of
    its text, if others have it too, but links nothing, and is kept. Repeated rows fall into one class; rows that repeat an id with other texts
    are linked each by its own text. Other columns, of whatever name, are ignored. An empty table gives no rows.
    """
    every = materialize(shingled(docs, id_col, text_col, cfg), "shingled")
    classes = every.where("class_key is not null and id is not null").groupBy("class_key").agg(F.min(F.struct("id", "text_key")).alias("first"), F.count("*").alias("members"))
    # A class goes by a number of its own, as an id may be the smallest of several classes; the number holds once the table is written. Numbers follow
    # the smallest ids, so that what others were copied from, which mostly comes first, is what they are compared with first.
    first = classes.select("class_key", F.col("first.id").alias("first_id"), F.col("first.text_key").alias("first_text"), "members")
    classes = materialize(first.orderBy("first_id", "class_key").withColumn("rep", F.monotonically_increasing_id()), "classes")
    # Joined by class and id, so that a class of a third of all rows is spread over its ids.
    reps = materialize(every.join(classes.select("class_key", F.col("first_id").alias("id"), "rep"), ["class_key", "id"]).select("rep", "n", "sig", "keys").dropDuplicates(["rep"]), "reps")
    sigs = reps.select("rep", "sig")

    rows = reps.select("rep", "n", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("cnt"), F.min(F.struct("rep", "n")).alias("pivot")).where("cnt > 1")
    shared = materialize(rows.join(buckets, "key").select("key", "rep", "n", "cnt", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "buckets")

    stars = shared.where((F.col("rep") > F.col("pivot")) & _size_ok("n", "pivot_n", cfg.percent)).groupBy("rep", "pivot").agg(F.count("*").alias("bands"))
    best = materialize(stars.groupBy("rep").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("first"))).alias("m")).select((-F.col("m.first")).alias("a"), F.col("rep").alias("b")), "best")
    bags = _bags(shared, classes, docs, id_col, text_col, cfg)
    links = materialize(_confirmed(materialize(_survivors(best, sigs, cfg, cfg.hashes), "survivors"), bags, cfg), "confirmed")
    found = materialize(components(links), "components")

    rep_of, pivot_of = (found.select(F.col("node").alias(c), F.col("component").alias(f"{c}_comp")) for c in ("rep", "pivot"))
    label = shared.join(rep_of, "rep", "left").join(pivot_of, "pivot", "left").select("key", "rep", "n", "cnt", F.coalesce("rep_comp", "rep").alias("comp"), F.coalesce("pivot_comp", "pivot").alias("home"))
    label = materialize(label, "labelled")
    still = label.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = materialize(label.join(still, "key", "left_semi"), "open")
    small = rest.where(F.col("cnt") <= cfg.pair_limit)
    other = small.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("comp_b"))
    pairs = small.join(other, "key").where((F.col("rep") < F.col("b")) & (F.col("comp") != F.col("comp_b")) & _size_ok("n", "nb", cfg.percent)).select(F.col("rep").alias("a"), "b").distinct()
    some = materialize(_survivors(materialize(pairs, "pairs"), sigs, cfg, cfg.hashes), "survivors")
    more = _survivors(some, bags, cfg, cfg.more)
    hot = rest.where(F.col("cnt") > cfg.pair_limit)
    if not hot.isEmpty():
        more = more.unionByName(_block_survivors(hot, bags, reps, cfg)).distinct()
    more = materialize(_confirmed(materialize(more, "likely"), bags, cfg), "confirmed")
    if not more.isEmpty():
        found = materialize(components(links.unionByName(more)), "components")
    drop(reps, shared, best, bags, links, label, rest, some, more)

    # A component is named by the smallest id of its classes.
    linked = found.join(classes.select(F.col("rep").alias("node"), "first_id"), "node")
    named = spread_join(linked.select("node", "component"), linked.groupBy("component").agg(F.min("first_id").alias("least_id")), "component")
    known = classes.join(named.select(F.col("node").alias("rep"), "least_id"), "rep", "left").select("class_key", "members", F.col("first_id").alias("rep"), F.coalesce("least_id", "first_id").alias("component"))
    # Large classes, of which n rows have n / cfg.hot at most, are looked up in place; their rows, and those without words, are joined to nothing.
    large = F.broadcast(known.where(F.col("members") > cfg.hot).select("class_key", F.col("rep").alias("large_rep"), F.col("component").alias("large_component")))
    small = known.where(F.col("members") <= cfg.hot).select(F.col("class_key").alias("small_key"), "rep", "component")
    out = every.select("id", "n", "class_key", "text_key").join(large, "class_key", "left")
    out = out.withColumn("small_key", F.when(F.col("large_rep").isNotNull() | F.col("class_key").isNull(), F.concat(F.lit(b"\0"), F.coalesce("id", F.lit(0)).cast("string").cast("binary"))).otherwise(F.col("class_key"))).join(small, "small_key", "left")
    rep, component = F.coalesce("large_rep", "rep", "id"), F.coalesce("large_component", "component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), rep.alias("class_id"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), "text_key")

"""Byte-level BPE with a segment tree over byte positions.

Each pre-token's bytes are the leaves of a segment tree; a leaf holds the rank of the pair that starts there with its
position, an inner node the least of its (up to FAN) children, so that the root is the leftmost pair of least rank. A
merge joins two live neighbours and updates the leaves of three positions and the nodes over them, so that a
pre-token of n bytes takes O(n log n). Results are remembered per pre-token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusloom.llm.shared import arrow_map, ddl, name

NONE = 1 << 60
#: Children of a node, as a power of two: wide enough that a node's least child is found by one built-in call.
FAN_BITS = 4


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: merge the leftmost pair of least rank until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    shift, fan = n.bit_length(), 1 << FAN_BITS
    at = (1 << shift) - 1
    leaves = [(get(piece[k : k + 2], NONE) << shift) | k for k in range(n - 1)]
    levels = [leaves]
    while len(levels[-1]) > fan:
        low = levels[-1]
        levels.append([min(low[k : k + fan]) for k in range(0, len(low), fan)])
    top, none = levels[-1], NONE << shift
    over = list(zip(levels, levels[1:]))  # pairs of a level and the one above; none for a short pre-token
    after = list(range(1, n + 1))  # the end of the live token that starts at a position
    before = list(range(-1, n))  # the start of the live token before it
    root = min(top, default=none)
    while root < none:
        left = root & at
        right = after[left]
        after[left] = end = after[right]
        before[end] = left
        leaves[left] = get(piece[left : after[end]], NONE) << shift | left if end < n else none
        if right < n - 1:
            leaves[right] = none
        start = before[left]
        if left:
            leaves[start] = get(piece[start:end], NONE) << shift | start
        if over:
            changed = {left, max(start, 0), min(right, n - 2)}
            for low, high in over:
                changed = {k >> FAN_BITS for k in changed}
                for k in changed:
                    high[k] = min(low[k << FAN_BITS : (k + 1) << FAN_BITS])
        root = min(top)
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : after[k]]])
        k = after[k]
    return out


class ByteBPE:
    """Encoder and decoder for a rank file and a pre-token pattern.

    Ids of pre-tokens are remembered in two generations of at most ``remember`` each: when the young one is full, it becomes the
    old one, and what is asked for again moves back, so that frequent pre-tokens are never merged twice.
    """

    def __init__(self, path: str, pattern: str, remember: int = 500_000):
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.tokens}
        self.split = regex.compile(pattern).findall
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}
        self.remember = remember

    def _new(self, piece: str) -> list[int]:
        ids = self.young.get(piece) or self.old.get(piece) or merge(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= 64:
            if len(self.young) >= self.remember:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null counts as empty."""
        known, new, out = self.young.get, self._new, []
        for piece in self.split(text or ""):
            out += known(piece) or new(piece)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text. Null and empty texts give an empty list; other columns are ignored."""

    def rows(keys, texts):
        c = codec(path, pattern)
        for k, t in zip(keys, texts, strict=True):
            yield k, c.encode(t)

    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, f"{ddl(id_col, 'long')}, ids array<int>", pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))]))


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, data binary) from ``encoded(id, ids)``; a null list decodes to no bytes."""

    def rows(keys, ids):
        c = codec(path, pattern)
        for k, x in zip(keys, ids, strict=True):
            yield k, c.decode(x or [])

    return arrow_map(encoded.select(name(id_col).cast("long"), "ids"), rows, f"{ddl(id_col, 'long')}, data binary", pa.schema([(id_col, pa.int64()), ("data", pa.binary())]))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids in decimal with commas, and of the decoded bytes.

    One narrow pass, so that neither ids nor bytes cross to the JVM. Null and empty texts have no tokens; repeated rows repeat; other columns are ignored.
    """

    def rows(keys, texts):
        c = codec(path, pattern)
        for k, t in zip(keys, texts, strict=True):
            ids = c.encode(t)
            yield k, len(ids), hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    schema = pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, f"{ddl(id_col, 'long')}, n_tokens long, ids_sha256 string, decoded_sha256 string", schema)

"""Packing documents into sequences: first-fit decreasing with a tournament tree, in randomised groups.

Documents become token ids; a document longer than a sequence is cut into full pieces and a rest. Pieces are dealt to
groups by a hash of the document, so that each group is a random sample of the lengths, and every group is packed on
its own. The group count follows the number of rows, so a group stays small at any scale.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import arrow_map, ddl, name


@dataclass(frozen=True)
class PackConfig:
    """length: tokens of a sequence. end_id: closes each document. group_rows: documents of a group, on average. remember: pieces that a worker keeps, of about 200 bytes each."""

    length: int = 2048
    end_id: int = 1
    group_rows: int = 20_000
    seed: int = 11
    remember: int = 100_000


class TournamentTree:
    """Capacities of up to ``size`` open bins; each inner node holds the larger of its two children."""

    def __init__(self, size: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, size):
            self.leaves *= 2
        self.best = [0] * self.leaves + [capacity if k < size else 0 for k in range(self.leaves)]
        for k in range(self.leaves - 1, 0, -1):
            self.best[k] = max(self.best[2 * k], self.best[2 * k + 1])

    def first_fit(self, need: int) -> int:
        """The leftmost bin with room for ``need``; takes it. -1 if there is none."""
        best, k = self.best, 1
        if best[1] < need:
            return -1
        while k < self.leaves:
            k *= 2
            if best[k] < need:
                k += 1
        bin_ = k - self.leaves
        best[k] -= need
        k //= 2
        while k:
            top = max(best[2 * k], best[2 * k + 1])
            if best[k] == top:
                break
            best[k] = top
            k //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, longest first, ties in the given order. Every length must fit a bin."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    tree = TournamentTree(len(lengths), capacity)
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), {}
    for k in order:
        b = tree.first_fit(lengths[k])
        bins[k], offsets[k] = b, filled.get(b, 0)
        filled[b] = offsets[k] + lengths[k]
    return bins, offsets


#: How a vocabulary file must normalise and split for its texts to be merged piece by piece.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Characters for which normalising is lower-casing alone, and how the vocabulary's pattern splits them when lower-cased.
PLAIN = re.compile(r"[\t-\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ\t-\r ]+")
SPACE = re.compile(r"[\t-\r ]+")


@lru_cache(2)
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces, found by ``ids`` when first asked for. At most twice ``most`` are kept: a full generation stays as the older one, from which what is asked for comes back."""

    def __init__(self, ids: Callable[[str], bytes], most: int):
        super().__init__()
        self.ids, self.most, self.older = ids, max(1, most), {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.ids(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class WordTokenizer:
    """Token ids of whole texts by the vocabulary file's own model, without special tokens; their strings are ordinary text.

    The vocabulary drops white space, so that pieces of a plain text (ASCII but the apostrophe, and Latin-1 letters) are merged by
    the library's model one by one and remembered. Other texts are cut at ASCII white space, and words that aren't
    plain go through the library whole. With a file that normalises or splits in another way, all texts do.
    """

    def __init__(self, path: str, remember: int = 100_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        spec = json.loads(self.whole.to_str())
        self.piecewise = (spec["normalizer"], spec["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and not spec["model"]["dropout"]
        self.model, self.remember = self.whole.model, remember
        self.known = _Pieces(self._ids, remember // 2)  # ids of four bytes each: workers are reused, so this stays in all of them

    def _ids(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece):
            shown = piece if piece.isascii() else "".join(map(_byte_letters().__getitem__, piece.encode()))
            ids = [t.id for t in self.model.tokenize(shown)]
        else:
            ids = self.whole.encode(piece, add_special_tokens=False).ids
        return pack_ids("<%dI" % len(ids), *ids)

    def encode(self, text: str | None) -> np.ndarray:
        if not self.piecewise:
            return np.array(self.whole.encode(text or "", add_special_tokens=False).ids, np.uint32)
        text, ids = text or "", self.known.__getitem__
        if PLAIN.fullmatch(text):
            return np.frombuffer(bytearray().join(map(ids, PIECES.findall(text.lower()))), np.uint32)
        out: list[bytes] = []
        for part in SPACE.split(text):
            out += map(ids, PIECES.findall(part.lower())) if PLAIN.fullmatch(part) else [ids(part)]
        return np.frombuffer(bytearray().join(out), np.uint32)


@lru_cache(2)
def tokenizer(path: str, remember: int) -> WordTokenizer:
    return WordTokenizer(path, remember)


def tokenize_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cfg: PackConfig = PackConfig(), digest: bool = False) -> DataFrame:
    """Pieces (id, start, length, doc_tokens, ids) of every document, of at most cfg.length tokens, the closing id included.

    A null or empty text is the closing id alone. digest: ``ids_crc32`` (of little-endian 32-bit ids) takes the place of ``ids``.
    """

    def rows(ids, texts):
        encode = tokenizer(path, cfg.remember).encode
        for i, text in zip(ids, texts, strict=True):
            tokens = np.append(encode(text), np.uint32(cfg.end_id)).astype("<u4")
            for start in range(0, len(tokens), cfg.length):
                piece = tokens[start : start + cfg.length]
                yield i, start, len(piece), len(tokens), zlib.crc32(piece.tobytes()) if digest else piece.tolist()

    last, kind = ("ids_crc32 long", ("ids_crc32", pa.int64())) if digest else ("ids array<int>", ("ids", pa.list_(pa.int32())))
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), kind])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, f"{ddl(id_col, 'long')}, start long, length long, doc_tokens long, {last}", schema)


def pack(pieces: DataFrame, n_docs: int, id_col: str = "doc_id", cfg: PackConfig = PackConfig()) -> DataFrame:
    """Give each piece of ``pieces`` (with id, start and length of 1 to cfg.length) a sequence_id and an offset in it.

    n_docs only sets the number of groups. Sequence ids are group * 2**32 + bin. All columns of ``pieces`` stay, but columns that are
    called sequence_id or offset are replaced. Pieces are dealt by id, start and length, so that a repeated id is spread.
    Ties are packed in the order of (id, start), so a rerun gives the same rows; an empty table gives no rows.
    """
    groups = max(1, -(-n_docs // cfg.group_rows))
    pieces = pieces.drop("sequence_id", "offset")
    names, kinds = pieces.columns, [f.dataType.simpleString() for f in pieces.schema]
    plain = [f"c{k}" for k in range(len(names))]  # whatever the columns are called
    own, start, length = (plain[names.index(x)] for x in (id_col, "start", "length"))
    dealt = pieces.toDF(*plain).withColumn("dealt", F.pmod(F.xxhash64(own, start, length, F.lit(cfg.seed)), F.lit(groups)))
    schema = ", ".join(ddl(c, k) for c, k in zip(plain, kinds, strict=True)) + ", sequence_id long, offset long"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([own, start], kind="stable").drop(columns="dealt")
        bins, offsets = first_fit_decreasing(pdf[length].tolist(), cfg.length)
        return pdf.assign(sequence_id=np.array(bins, np.int64) + int(key[0]) * 2**32, offset=np.array(offsets, np.int64))

    return dealt.groupBy("dealt").applyInPandas(one, schema).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", cfg: PackConfig = PackConfig(), digest: bool = False) -> DataFrame:
    """Tokenise and pack a table of documents; see tokenize_pieces and pack. Other columns are ignored."""
    return pack(tokenize_pieces(docs, path, id_col, text_col, cfg, digest), docs.count(), id_col, cfg)

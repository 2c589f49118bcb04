"""Media columns: byte payloads as motion-JPEG in AVI, and timed clips of such files.

A frame is a baseline JPEG of 8 x 8 blocks in three components (4:4:4). Its entropy-coded unit is the quantised DCT
coefficient, and payload bytes are stored as such units, so that nothing is lost: every coefficient is coded with run 0
and size 8, whose eight further bits are the byte (0..127 stand for -255..-128, 128..255 for themselves). A restart
after each group of three blocks starts DC prediction anew, so a group holds 192 bytes on its own. The code table
gives the symbols used a code of eight bits, so that frames are packed and unpacked as arrays.

Readers parse the RIFF chunks and the idx1 index, decode the frames, compare luminance histograms of neighbouring frames
with an adaptive threshold, and yield the shots as clips with times.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.shared import arrow_map, name

GROUP = 192  # payload bytes of one group of three blocks


@dataclass(frozen=True)
class AviConfig:
    """groups: three-block groups of a frame, in one row. fps: frames a second. bins, window, sharpness: of the shot
    detector, which cuts where a histogram difference exceeds mean + sharpness * deviation of the window before it."""

    groups: int = 16
    fps: int = 25
    bins: int = 16
    window: int = 8
    sharpness: float = 3.0
    least: float = 0.25


#: Symbol codes of eight bits each (no code is all ones): run 0 / size 8 and, for empty blocks, size 0 (end of block).
SIZE_8, EMPTY = 0x08, 0x00
CODES = {SIZE_8: 0x00, EMPTY: 0x01}


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int) -> bytes:
    return bytes([kind]) + bytes([0] * 7 + [2] + [0] * 8) + bytes([SIZE_8, EMPTY])


@lru_cache(8)
def _head(groups: int) -> bytes:
    quant = _segment(0xDB, bytes([0]) + bytes([1] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * groups, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"\xff\xd8" + quant + frame + _segment(0xC4, _table(0x00) + _table(0x10)) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


_EMPTY_BLOCKS = bytes([CODES[EMPTY], CODES[EMPTY]] * 3)  # DC difference 0, end of block; three blocks


def encode_frame(payload: bytes, groups: int) -> bytes:
    """A JPEG of ``groups`` groups; groups beyond the payload (a multiple of 192 bytes) are empty."""
    out, n = [_head(groups)], len(payload) // GROUP
    coded = np.zeros((n, GROUP, 2), np.uint8)
    coded[:, :, 0] = CODES[SIZE_8]
    coded[:, :, 1] = np.frombuffer(payload, np.uint8).reshape(n, GROUP)
    for k in range(groups):
        out.append(coded[k].tobytes().replace(b"\xff", b"\xff\x00") if k < n else _EMPTY_BLOCKS)
        if k < groups - 1:
            out.append(bytes([0xFF, 0xD0 + k % 8]))
    out.append(b"\xff\xd9")
    return b"".join(out)


_RST = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def decode_frame(jpeg: bytes) -> tuple[bytes, np.ndarray]:
    """(payload bytes, coefficients as (groups with data, 3, 64)) of a frame made by encode_frame."""
    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a JPEG frame")
    at = 2
    while jpeg[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    scan = jpeg[at:-2]
    for r in _RST[1:]:
        scan = scan.replace(r, _RST[0])
    parts = [p.replace(b"\xff\x00", b"\xff") for p in scan.split(_RST[0])]
    full = [p for p in parts if p != _EMPTY_BLOCKS]
    if any(len(p) != 2 * GROUP for p in full):
        raise ValueError("a group of blocks is damaged")
    coded = np.frombuffer(b"".join(full), np.uint8).reshape(len(full), GROUP, 2)
    if coded[:, :, 0].any():
        raise ValueError("an unknown code")
    units = coded[:, :, 1]
    values = units.astype(np.int16)
    return units.tobytes(), np.where(values < 128, values - 255, values).reshape(len(full), 3, 64)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", name + body)


def encode_avi(payload: bytes, cfg: AviConfig = AviConfig()) -> bytes:
    """A complete AVI file: headers, frames, idx1. The payload's length must be a positive multiple of 192."""
    size = cfg.groups * GROUP
    frames = [encode_frame(payload[k : k + size], cfg.groups) for k in range(0, len(payload), size)]
    width, most = 8 * cfg.groups, max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // cfg.fps, most * cfg.fps, 0, 0x10, len(frames), 0, 1, most, width, 8, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, cfg.fps, 0, len(frames), most, -1, 0, 0, 0, width, 8)
    image = struct.pack("<IiiHH4sIiiII", 40, width, 8, 1, 24, b"MJPG", width * 8 * 3, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", main) + _list(b"strl", _chunk(b"strh", stream) + _chunk(b"strf", image)))
    movi, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        movi.append(c)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + header + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def frames_of(avi: bytes) -> tuple[list[bytes], float]:
    """(JPEG frames in the order of the idx1 index, frames a second) of an AVI file."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end = 12, 8 + struct.unpack_from("<I", avi, 4)[0]
    movi = entries = None
    fps = 0.0
    while at + 8 <= end:
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and avi[at + 8 : at + 12] == b"hdrl":
            fps = 1_000_000 / struct.unpack_from("<I", avi, at + 20)[0]
        elif name == b"idx1":
            entries = [struct.unpack_from("<4sIII", avi, k) for k in range(at + 8, at + 8 + size, 16)]
        at += 8 + size + size % 2
    if movi is None or entries is None:
        raise ValueError("the file has no frames or no index")
    return [avi[movi + o + 8 : movi + o + 8 + n] for name, _, o, n in entries if name == b"00dc"], fps


def _zigzag() -> np.ndarray:
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * i + j for i, j in order])


@lru_cache(1)
def _inverse() -> np.ndarray:
    """Zigzag coefficients to 64 samples: the inverse DCT as one matrix."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    return np.ascontiguousarray(np.kron(c, c)[_zigzag()].astype(np.float32))


def histogram(coefficients: np.ndarray, bins: int) -> np.ndarray:
    """Shares of the decoded first component's (luminance) samples in equal bins of 0 to 255."""
    if not len(coefficients):
        return np.zeros(bins)
    y = np.clip(coefficients[:, 0, :].astype(np.float32) @ _inverse() + 128, 0, 255).astype(np.uint8)
    return np.bincount((y.ravel().astype(np.int32) * bins) >> 8, minlength=bins) / y.size


def shots(histograms: list[np.ndarray], cfg: AviConfig = AviConfig()) -> list[tuple[int, int]]:
    """(first, end) frames of each shot. A cut lies where the difference exceeds the least one and what the window before it leads to expect."""
    if not histograms:
        return []
    d = np.abs(np.diff(np.array(histograms), axis=0)).sum(axis=1) / 2
    cuts, seen = [], []
    for k, x in enumerate(d.tolist()):
        near = seen[-cfg.window :]
        mean = sum(near) / len(near) if near else 0.0
        dev = (sum((v - mean) ** 2 for v in near) / len(near)) ** 0.5 if near else 0.0
        if x > max(cfg.least, mean + cfg.sharpness * dev):
            cuts.append(k + 1)
            seen = []
        else:
            seen.append(x)
    edges = [0, *cuts, len(histograms)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def clips_of(avi: bytes, cfg: AviConfig = AviConfig()) -> tuple[bytes, list[tuple[int, int, float, float]]]:
    """(payload, clips as (first frame, end frame, start and end in seconds)) of a stored file."""
    frames, fps = frames_of(avi)
    payload, hists = [], []
    for f in frames:
        data, coefficients = decode_frame(f)
        payload.append(data)
        hists.append(histogram(coefficients, cfg.bins))
    return b"".join(payload), [(a, b, a / fps, b / fps) for a, b in shots(hists, cfg)]


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the UTF-8 text, the payload: these and blanks up to a positive multiple of 192)."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + b" " * (-len(data) % GROUP if data else GROUP)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: AviConfig = AviConfig()) -> DataFrame:
    """(id, n_bytes, media binary): every row's whole text as an AVI file. Null and empty texts are one group of blanks."""

    def rows(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            n, payload = padded(t)
            yield i, n, encode_avi(payload, cfg)

    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return arrow_map(docs.select(name(id_col).cast("long"), name(text_col)), rows, "id long, n_bytes long, media binary", schema, chunk=64).withColumnRenamed("id", id_col)


def _read(file: bytes | None, cfg: AviConfig) -> tuple[bytes | None, list, str | None]:
    """(payload, clips, error): a null file has neither; a damaged one is reported instead of ending the job."""
    if file is None:
        return None, [], None
    try:
        return *clips_of(file, cfg), None
    except (ValueError, IndexError, struct.error) as e:
        return None, [], f"{type(e).__name__}: {e}"


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", cfg: AviConfig = AviConfig()) -> DataFrame:
    """Timed clip rows (id, clip, first_frame, end_frame, start_s, end_s, error) of a media column; null media give none, a
    damaged file gives one row with nothing but its id and the error."""

    def rows(ids, files):
        for i, f in zip(ids, files, strict=True):
            _, found, error = _read(f, cfg)
            for k, c in enumerate(found):
                yield i, k, *c, None
            if error:
                yield i, None, None, None, None, None, error

    schema = pa.schema([("id", pa.int64()), ("clip", pa.int64()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("error", pa.string())])
    return arrow_map(media.select(name(id_col).cast("long"), name(media_col)), rows, "id long, clip long, first_frame long, end_frame long, start_s double, end_s double, error string", schema, chunk=64).withColumnRenamed("id", id_col)


def digests(media: DataFrame, id_col: str = "doc_id", cfg: AviConfig = AviConfig()) -> DataFrame:
    """Read ``media(id, n_bytes, media)`` back: sizes and digests of payload and file, the clips as 'start-end' seconds joined by '|', and an
    error, null for a sound file. Null media have nulls; a damaged file keeps its own size and digest. Other columns are ignored."""

    def rows(ids, sizes, files):
        for i, n, f in zip(ids, sizes, files, strict=True):
            payload, found, error = _read(f, cfg)
            of_payload = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) if payload is not None else (None, None, None)
            of_file = (len(f), hashlib.sha256(f).hexdigest()) if f is not None else (None, None)
            yield i, n, *of_payload, *of_file, "|".join(f"{a:.2f}-{b:.2f}" for _, _, a, b in found) if payload is not None else None, error

    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
    kind = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    return arrow_map(media.select(name(id_col).cast("long"), "n_bytes", "media"), rows, kind, schema, chunk=64).withColumnRenamed("id", id_col)

import base64
import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from corpusloom.llm import byte_bpe, html_text, media_avi, packing, warc

TEXTS = [None, "", " ", "a", "Hello, wörld! It's 42 — ok?  \n\n x", "日本語のテキスト 🎉🎉", "x" * 3000, "the " * 5000, "\x00\x01 é́", "<|endoftext|> a"]
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_library(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab cdeé'1. \n") for _ in range(rng.randint(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    encoded = byte_bpe.encode(docs, RANKS, P.PATTERN)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: enc.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(encoded, RANKS, P.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, enc.encode_ordinary(texts[r.doc_id] or ""))).encode()).hexdigest()
    assert byte_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


def test_first_fit_decreasing_against_plain_scan():
    rng = random.Random(1)
    for _ in range(50):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        room, want = [], {}
        for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            b = next((j for j, r in enumerate(room) if r >= lengths[k]), len(room))
            if b == len(room):
                room.append(100)
            want[k] = (b, 100 - room[b])
            room[b] -= lengths[k]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        assert {k: (bins[k], offsets[k]) for k in want} == want


def test_word_pieces_equal_library():
    path, rng = P.path("word_bpe_49k.json"), random.Random(8)
    lib = Tokenizer.from_file(path)
    lib.encode_special_tokens = True
    own = packing.WordTokenizer(path, remember=50)
    for _ in range(400):
        text = "".join(rng.choice(list("abzAZ019 éÉßÿÀ×÷.,!%$*'\"-_\n\t\x0b\x1c\x00\x7f\xa0\u0301ªµ²½İΣςﬁ世🎉") + ["'s", "'LL", "<|endoftext|>", "words ", "STRASSE"]) for _ in range(rng.randint(0, 30)))
        assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_is_whole(spark):
    path = P.path("word_bpe_49k.json")
    texts = TEXTS[:-1] + [f"word{i} " * (i * 7 % 900) for i in range(80)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, "a", 0)], "doc_id long, text string, sequence_id int")
    cfg = packing.PackConfig(group_rows=20)
    rows = packing.pack_documents(docs.where("doc_id <> 3"), path, cfg=cfg).collect()
    lib = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        if i == 3:
            continue
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [x for r in own for x in r.ids]
        assert ids == lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and {r.doc_tokens for r in own} == {len(ids)}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 2048
    digested = packing.pack_documents(docs, path, cfg=cfg, digest=True).collect()
    assert len(digested) == len(rows) + 2
    crc = {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows}
    assert all(crc[r.doc_id, r.start] == r.ids_crc32 for r in digested if r.doc_id != 3)
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_warc_round_trip(spark):
    big, small = "<p>é" + "x" * 2000, "y"
    pages = spark.createDataFrame([(1, "http://a/", big, 1), (2, "http://b/\r\n x", big, 1), (3, None, big, 1), (4, "u", small, 1), (5, "u", small, 1), (6, "u", None, 1), (7, "u", "", 1), (8, "u", "z" * 999, 1), (9, "u", "z" * 999, 1), (10, "u", "q" * 70_000, 1), (None, "u", "lone" * 300, 1)], "page_id long, url string, html string, digest int")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert len(got) == 11
    for r in pages.collect():
        data = (r.html or "").encode()
        assert (got[r.page_id].payload_bytes, got[r.page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {k: (r.record_type, r.refers_to) for k, r in got.items() if r.record_type != "response"} == {1: ("revisit", 3), 2: ("revisit", 3)}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_files_are_plain_gzip_members(spark, tmp_path):
    huge = "h" * (17 << 20)
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", huge), (3, "w", "b")], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3
    back = warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()
    assert {r.page_id: bytes(r.payload) for r in back} == {1: b"a", 2: huge.encode(), 3: b"b"}


def test_warc_damage_is_found():
    good = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").digest(), None, False)
    assert warc.read_record(good)[2] == 3
    with pytest.raises(ValueError):
        warc.read_record(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.inflate_members(warc.member(good)[:-9]))


def test_avi_round_trip(spark):
    docs = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(TEXTS)] + [(None, "a", None), (3, "a", None)], "doc_id long, text string, media binary")
    rows = media_avi.digests(media_avi.store(docs)).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        data = ("a" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media_avi.digests(media_avi.store(docs.limit(0))).count() == 0


def test_avi_frames_bytes_and_shots(spark):
    rng = np.random.default_rng(0)
    payload = bytes(range(256)) * 3 + b"\xff" * 192 + rng.integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    avi = media_avi.encode_avi(payload)
    assert media_avi.clips_of(avi)[0] == payload
    frames, fps = media_avi.frames_of(avi)
    assert fps == 25 and all(f[:2] == b"\xff\xd8" and f[-2:] == b"\xff\xd9" for f in frames)
    dark, bright = np.zeros(16), np.zeros(16)
    dark[2], bright[12] = 1, 1
    assert media_avi.shots([dark] * 5 + [bright] * 4) == [(0, 5), (5, 9)] and media_avi.shots([]) == []
    shown = media_avi.clips(spark.createDataFrame([(1, avi), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.doc_id, r.start_s) for r in shown][:1] == [(1, 0.0)] and shown[-1].end_frame == len(frames)


def test_avi_samples_equal_a_direct_transform():
    z = np.zeros((1, 3, 64), np.int16)
    z[0, 0, 0] = 80  # DC only: a flat block of 80 / 8
    assert media_avi.histogram(z, 16).argmax() == (128 + 10) * 16 >> 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use cookies, please accept them all now.</div>
{open}<h1>Head &amp; line</h1><p>First   para
graph &eacute; with <b>bold</b> text.</p><p>Short.</p><ul><li>One</li><li>Two</li></ul>{close}
<aside>Side <p>bar</p></aside><section id="comments"><p>I like this a lot and write a very long comment here.</p></section>
<form><input><p>Mail</p></form><script>var t="</p>";</script><footer>&copy; me</footer></body></html>"""
WANT = "Head & line\n\nFirst para graph é with bold text.\n\nShort.\n\nOne\n\nTwo"


@pytest.mark.parametrize(("a", "b"), [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ("<article><div>", "</div></article>")])
def test_main_text(a, b):
    assert html_text.main_text(PAGE.replace("{open}", a).replace("{close}", b)) == WANT


def test_short_blocks_of_the_main_region_stay():
    body = "A long paragraph of the main text, as an example. " * 9
    blocks = ["Head", body.strip(), "Short.", "One", body.strip(), "End."]
    page = "<body><div><a href=/a>All of the pages</a></div><div><h1>Head</h1></div>" + f"<div><p>{body}</p></div><div><p>Short.</p></div><section><ul><li>One</li></ul></section><div><a href=/b>More on this</a></div><div><p>{body}</p></div><div>End.</div>" + "<div><a href=/c>Imprint of the site</a></div><div>Far.</div></body>"
    assert html_text.main_text(page) == "\n\n".join(blocks)


def test_main_text_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 1), (3, None, "<p>", 1), (4, "u", "<article><p><b>A<br>b<p>c</p><!-- x --><p>d", 1), (None, "u", "<nav>only</nav>", 1), (6, "u", "<article><p>" + "w " * 60_000, 1)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert [got[k].text for k in (1, 2, 3, 4, None)] == ["", "", "", "A b\n\nc\n\nd", ""] and got[6].n_chars == 119_999
    assert html_text.extract(pages.limit(0)).count() == 0


def test_nested_articles_and_subject_words():
    own = "Legal matters of the article are told in full here, at some length. " * 3
    page = f"<body><article><h1>T</h1><div class='legal'><p>{own}</p></div><div class='alert'>Hey!</div><div><a href=a>a</a> <a href=b>b</a> <a href=c>c</a></div></article><section class='comments'><article class='comment'><p>Reader comment one.</p></article></section><aside><article><p>Related teaser.</p></article></aside></body>"
    assert html_text.main_text(page) == f"T\n\n{own.strip()}"


@pytest.mark.parametrize("part", ["<a", "<a '>' ", "<!", '<p class="', "<!--", "<nav>", "<script>", "<p>x ", "</div>"])
def test_scanning_is_linear(part):
    began = time.monotonic()
    html_text.main_text(part * (1_000_000 // len(part)))
    assert time.monotonic() - began < 20


def test_passages_against_plain_loop():
    rng = random.Random(5)
    for _ in range(200):
        lines = [html_text.Line("x" * rng.choice([0, 0, 0, 0, 3, 9]), 0, False) for _ in range(rng.randint(0, 25))]
        want, start = [], None
        for k in range(len(lines) + 1):
            on = k < len(lines) and any(x.text for x in lines[max(0, k - 2) : k + 1])
            if on and start is None:
                start = k
            elif not on and start is not None:
                want.append((start, k, sum(len(x.text) for x in lines[start:k])))
                start = None
        assert html_text.passages(lines, 3) == want


def test_archives_are_rolled_by_bytes(spark, tmp_path):
    rng = random.Random(2)
    pages = spark.createDataFrame([(i, "u", rng.randbytes(3000).hex()) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"), max_bytes=50_000)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 60_000
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 200


def test_hot_payload_keeps_its_links(spark):
    pages = spark.createDataFrame([(i, "u", "h" * 2000 if i % 3 else f"{i}" * 2000) for i in range(60)] + [(90, "u", "0" * 2000)], "page_id long, url string, html string")
    got = {r.id: r.response_id for r in warc.plan_records(pages, hot=10).collect()}
    assert got == {i: 59 if i % 3 else 90 if i == 0 else None for i in range(60)} | {90: 90}


def test_damaged_and_null_media(spark):
    good = media_avi.encode_avi(b"a" * 192)
    media = spark.createDataFrame([(1, 192, good), (2, 192, good[:80]), (3, 0, None), (4, 1, b"no")], "doc_id long, n_bytes long, media binary")
    got = {r.doc_id: r for r in media_avi.digests(media).collect()}
    assert got[1].error is None and got[1].payload_bytes == 192 and got[3].error is None and got[3].payload_bytes is None
    assert got[2].error and got[4].error and got[4].media_bytes == 2
    assert {r.doc_id for r in media_avi.clips(media).collect() if r.error} == {2, 4}


def test_clashing_and_odd_names(spark):
    docs = spark.createDataFrame([(1, "a b", 0, 0)], "`doc id.x` long, `the text` string, sequence_id int, __group int")
    path = P.path("word_bpe_49k.json")
    pieces = packing.tokenize_pieces(docs, path, "doc id.x", "the text").selectExpr("*", "0 as __group", "7 as offset")
    assert [(r["doc id.x"], r.offset, r["__group"]) for r in packing.pack(pieces, 1, "doc id.x").collect()] == [(1, 0, 0)]
    assert byte_bpe.round_trip(docs, RANKS, P.PATTERN, "doc id.x", "the text").count() == 1
    assert html_text.extract(docs, "doc id.x", "the text", "the text").collect()[0]["text"] == "a b"


def test_remembered_pieces_are_four_bytes_an_id():
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    text = " ".join(f"word{k}" for k in range(2000))
    ids = own.encode(text)
    assert len(ids) and (own.encode("").size, own.encode(None).size) == (0, 0) and ids.flags.writeable
    assert sum(map(len, own.known.values())) <= 4 * len(ids) and all(isinstance(v, bytes) for v in own.known.values())


def test_frequent_pieces_stay_when_the_memory_is_full():
    own = packing.WordTokenizer(P.path("word_bpe_49k.json"), remember=40)
    asked, ids = [], own.known.ids
    own.known.ids = lambda piece: asked.append(piece) or ids(piece)
    for k in range(500):
        own.encode(f"often word{chr(97 + k % 26)}{chr(97 + k // 26)}x")
    assert asked.count("often") == 1 and len(asked) == 501
    assert len(own.known) + len(own.known.older) <= 40
    assert packing.tokenizer(P.path("word_bpe_49k.json"), 7).known.most == 3

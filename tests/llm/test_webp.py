import random
import struct

import numpy as np
import pytest

from loomkv.llm import webp as W


def wrapped(w):
    data = w.value.to_bytes(-(-w.size // 8), "little")
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def header(width, height):
    w = W.Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    return w


def simple(w, *symbols):
    """A simple prefix code with one symbol or two."""
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    w.put(symbols[0], 8)
    if len(symbols) == 2:
        w.put(symbols[1], 8)


def one_colour(w, a, r, g, b):
    """Codes without bits, so that every pixel is the same; no cache."""
    w.put(0, 1)
    for s in (g, r, b, a, 0):
        simple(w, s)


def test_hand_made_literals():
    w = header(2, 2)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    simple(w, 10, 20), simple(w, 1), simple(w, 5, 7), simple(w, 255), simple(w, 0)
    for green, blue in ((0, 0), (1, 1), (1, 0), (0, 1)):
        w.put(green, 1), w.put(blue, 1)
    assert W.decode(wrapped(w)) == (2, 2, [0xFF010A05, 0xFF011407, 0xFF011405, 0xFF010A07])


def test_hand_made_subtract_green():
    w = header(1, 1)
    w.put(1, 1), w.put(2, 2), w.put(0, 1), w.put(0, 1), w.put(0, 1)
    simple(w, 200), simple(w, 100), simple(w, 57), simple(w, 9), simple(w, 0)
    assert W.decode(wrapped(w)) == (1, 1, [9 << 24 | 44 << 16 | 200 << 8 | 1])


def test_hand_made_cross_colour():
    """green 64; to red 32 gives 64, to blue -32 gives -64, red to blue 16 on the new red -100 gives -50."""
    w = header(1, 1)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    one_colour(w, 255, 16, 256 - 32, 32)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    simple(w, 64), simple(w, 92), simple(w, 200), simple(w, 255), simple(w, 0)
    assert W.decode(wrapped(w)) == (1, 1, [0xFF << 24 | 156 << 16 | 64 << 8 | (200 - 64 - 50)])


@pytest.mark.parametrize("mode,want", [(1, [1, 2, 2, 3]), (2, [1, 2, 2, 3]), (4, [1, 2, 2, 2]), (7, [1, 2, 2, 3]), (11, [1, 2, 2, 3]), (12, [1, 2, 2, 4])])
def test_hand_made_predictor(mode, want):
    """Two by two pixels, all differences one in blue; the last is predicted by the mode, from left 2, top 2, corner 1."""
    w = header(2, 2)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    one_colour(w, 255, 0, mode, 0)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    for s in (0, 0, 1, 0, 0):
        simple(w, s)
    assert [p & 255 for p in W.decode(wrapped(w))[2]] == want


def test_hand_made_palette():
    """Two colours, eight to a pixel; the second is the sum of the deltas."""
    w = header(3, 1)
    w.put(1, 1), w.put(3, 2), w.put(1, 8)
    w.put(0, 1)
    simple(w, 1, 2), simple(w, 3), simple(w, 4), simple(w, 250), simple(w, 0)
    w.put(0, 1), w.put(1, 1)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    simple(w, 0b101), simple(w, 0), simple(w, 0), simple(w, 255), simple(w, 0)
    first, second = 250 << 24 | 3 << 16 | 1 << 8 | 4, 244 << 24 | 6 << 16 | 3 << 8 | 8
    assert W.decode(wrapped(w)) == (3, 1, [second, first, second])


def normal_green(w, lengths, alphabet):
    """A normal code from (symbol, length), by code lengths 0 to 2 of two bits each."""
    w.put(0, 1), w.put(12 - 4, 4)
    for s in W.LENGTH_ORDER[:12]:
        w.put(2 if s in (0, 1, 2, 18) else 0, 3)
    w.put(0, 1)
    codes = {0: 0b00, 1: 0b10, 2: 0b01, 18: 0b11}
    at = 0
    for s, n in [*lengths, (alphabet, None)]:
        while s - at >= 11:
            k = min(s - at, 138)
            w.put(codes[18], 2), w.put(k - 11, 7)
            at += k
        while at < s:
            w.put(codes[0], 2)
            at += 1
        if n:
            w.put(codes[n], 2)
            at += 1


def test_hand_made_reference_and_cache():
    """A literal, a run of three from one pixel back, and the literal out of a cache of two colours."""
    w = header(5, 1)
    w.put(0, 1)
    w.put(1, 1), w.put(1, 4), w.put(0, 1)
    p = 0xFF010203
    at = (p * W.HASH & 0xFFFFFFFF) >> 31
    normal_green(w, [(2, 2), (258, 2), (280 + at, 1)], 282)
    simple(w, 1), simple(w, 3), simple(w, 255), simple(w, 1)
    w.put(0b01, 2)
    w.put(0b11, 2)
    w.put(0, 1)
    assert W.decode(wrapped(w)) == (5, 1, [p] * 5)


def test_round_trips():
    random.seed(3)
    seen = set()
    for _ in range(600):
        s = random.getrandbits(62)
        width, p, data = W.painted(s)
        assert W.decode(data) == (width, len(p) // width, p)
        seen.add(s >> 1 & 15)
    assert len(seen) == 16
    rng = np.random.default_rng(1)
    wide = (rng.integers(0, 1 << 32, 90 * 60) * (rng.random(5400) < 0.2)).tolist()
    for t in ((), (0,), (1,), (2,), (0, 1, 2), (2, 1, 0)):
        assert W.decode(W.encode(wide, 90, t, 7, 4, 8, 3)) == (90, 60, wide)
    for n in (1, 2, 3, 4, 5, 16, 17, 256):
        few = (rng.integers(0, n, 700) * 0x01010101).tolist()
        for t in ((3,), (3, 0)):
            assert W.decode(W.encode(few, 35, t, n)) == (35, 20, few)


def test_damage_and_edges(spark):
    good = W.painted(12345)[2]
    big = W.encode([0xFF00FF00] * 300_000, 600)
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF"), (5, good[:-8]), (6, good[:20] + b"\xff" * 40), (7, big), (None, good), (1, good)]
    got = W.media(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, webp binary, damage string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id != 1}
    width, height, p = W.decode(good)
    assert by[None].width == width and [x & 0xFFFFFFFF for x in by[None].pixels] == p and by[None].damage is None
    assert (by[2].width, by[2].damage) == (None, None) and all(by[k].pixels is None and by[k].damage for k in (3, 4, 5, 6))
    assert (by[7].width, by[7].height, set(by[7].pixels)) == (600, 500, {0xFF00FF00 - (1 << 32)})
    for k in range(len(good)):
        for data in (good[:k], good[:k] + bytes([good[k] ^ 0x55]) + good[k + 1 :]):
            try:
                W.decode(data)
            except W.Damaged:
                pass


def test_query(spark):
    from loomkv.llm.queries import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in QUERIES["op10_media"](spark, "/root/testdata/sf0.001").collect()}
    seeds = {r.page_id: r.s for r in pages.select("page_id", W.F.xxhash64("page_id", "url", "html").alias("s")).collect()}
    assert len(got) == len(seeds)
    for k, s in seeds.items():
        width, p, _ = W.painted(s & 0x7FFFFFFFFFFFFFFF)
        assert got[k].width == width and [x & 0xFFFFFFFF for x in got[k].pixels] == p
    assert W.media(W.with_media(pages.limit(0))).count() == 0

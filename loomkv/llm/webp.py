"""op10: lossless WebP into pixel arrays.

decode() reads the RIFF container and the VP8L stream in it: prefix codes (simple, normal, and groups of
them chosen by an entropy image), back-references with the two-dimensional distance codes, the colour
cache, and the inverse of the predictor, cross-colour, subtract-green and palette transforms.

No table holds such images, so encode() makes one for every row of pages, seeded by the row, with every
feature of the format somewhere among them.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7))
HASH = 0x1E35A7BD
MOST_PIXELS = 1 << 26
BLACK = 0xFF000000


class Damaged(ValueError):
    """The bytes are no whole lossless image."""


class Bits:
    """Bits of a byte string, lowest first; a window of some hundred bytes at a time."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.window, self.have = data, 0, 0, 0

    def fill(self) -> None:
        """At least 64 bits, or zeros past the end, which over() tells."""
        part = self.data[self.at : self.at + 256]
        self.at += 256
        self.window |= int.from_bytes(part, "little") << self.have
        self.have += 2048

    def read(self, n: int) -> int:
        if self.have < 64:
            self.fill()
        out = self.window & ((1 << n) - 1)
        self.window >>= n
        self.have -= n
        return out

    def over(self) -> bool:
        return self.at * 8 - self.have > len(self.data) * 8


def table(lengths: list[int]) -> tuple[list[int], int]:
    """By the next bits: 16 times the symbol plus the bits that it takes; and how many bits to look at."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        raise Damaged("a prefix code without symbols")
    if len(used) == 1:
        return [used[0][1] << 4], 0
    used.sort()
    most = used[-1][0]
    if sum(1 << (most - n) for n, _ in used) != 1 << most:
        raise Damaged("a prefix code that is not full")
    out, code, size = [0] * (1 << most), 0, 1 << most
    before = used[0][0]
    for n, s in used:
        code <<= n - before
        before = n
        step = 1 << n
        out[int(format(code, f"0{n}b")[::-1], 2) :: step] = [s << 4 | n] * (size // step)
        code += 1
    return out, most


def _read_code(bits: Bits, alphabet: int) -> tuple[list[int], int]:
    lengths = [0] * alphabet
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= alphabet or len(set(symbols)) < len(symbols):
            raise Damaged("a symbol outside its alphabet")
        for s in symbols:
            lengths[s] = 1
        return table(lengths)
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[LENGTH_ORDER[k]] = bits.read(3)
    codes, look = table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if left > alphabet:
        raise Damaged("more code lengths than symbols")
    mask, at, before = (1 << look) - 1, 0, 8
    while at < alphabet and left:
        left -= 1
        if bits.have < 64:
            bits.fill()
        e = codes[bits.window & mask]
        n = e & 15
        bits.window >>= n
        bits.have -= n
        e >>= 4
        if e < 16:
            lengths[at] = e
            at += 1
            before = e or before
            continue
        count, value = (3 + bits.read(2), before) if e == 16 else (3 + bits.read(3), 0) if e == 17 else (11 + bits.read(7), 0)
        if at + count > alphabet:
            raise Damaged("code lengths past the alphabet")
        if value:
            lengths[at : at + count] = [value] * count
        at += count
    return table(lengths)


def _blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


def _pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """The pixels of one entropy-coded image, row by row, as ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Damaged("a colour cache of over 11 bits")
    shift, cache = 32 - cache_bits, [0] * (1 << cache_bits) if cache_bits else []
    meta, meta_bits, groups, wide = [], 0, 1, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        wide = _blocks(width, meta_bits)
        meta = [(p >> 8) & 0xFFFF for p in _pixels(bits, wide, _blocks(height, meta_bits), False)]
        groups = max(meta) + 1
    codes = []
    for _ in range(groups):
        codes.append([_read_code(bits, n) for n in (280 + len(cache), 256, 256, 256, 40)])
        if bits.over():
            raise Damaged("the data end early")
    size, out = width * height, []
    (green, g_bits), (red, r_bits), (blue, b_bits), (alpha, a_bits), (far, f_bits) = codes[0]
    g_mask, r_mask, b_mask, a_mask = (1 << g_bits) - 1, (1 << r_bits) - 1, (1 << b_bits) - 1, (1 << a_bits) - 1
    block = (1 << meta_bits) - 1
    window, have = bits.window, bits.have
    n, x, y, cached, fresh = 0, 0, 0, 0, True
    while n < size:
        if meta and (fresh or not x & block):
            (green, g_bits), (red, r_bits), (blue, b_bits), (alpha, a_bits), (far, f_bits) = codes[meta[(y >> meta_bits) * wide + (x >> meta_bits)]]
            g_mask, r_mask, b_mask, a_mask = (1 << g_bits) - 1, (1 << r_bits) - 1, (1 << b_bits) - 1, (1 << a_bits) - 1
            fresh = False
        if have < 96:
            bits.window, bits.have = window, have
            bits.fill()
            window, have = bits.window, bits.have
            if bits.over():
                raise Damaged("the data end early")
        e = green[window & g_mask]
        k = e & 15
        window >>= k
        have -= k
        e >>= 4
        if e < 256:
            r = red[window & r_mask]
            window >>= r & 15
            b = blue[window & b_mask]
            window >>= b & 15
            a = alpha[window & a_mask]
            window >>= a & 15
            have -= (r & 15) + (b & 15) + (a & 15)
            out.append((a >> 4) << 24 | (r >> 4) << 16 | e << 8 | b >> 4)
            n += 1
            x += 1
        elif e < 280:
            e -= 256
            if e < 4:
                count = e + 1
            else:
                k = (e - 2) >> 1
                count = ((2 + (e & 1)) << k) + (window & ((1 << k) - 1)) + 1
                window >>= k
                have -= k
            e = far[window & ((1 << f_bits) - 1)]
            k = e & 15
            window >>= k
            have -= k
            e >>= 4
            if e < 4:
                back = e + 1
            else:
                k = (e - 2) >> 1
                back = ((2 + (e & 1)) << k) + (window & ((1 << k) - 1)) + 1
                window >>= k
                have -= k
            if back > 120:
                back -= 120
            else:
                dx, dy = NEAR[back - 1]
                back = max(1, dx + dy * width)
            if back > n or n + count > size:
                raise Damaged("a reference outside the image")
            if back >= count:
                out += out[n - back : n - back + count]
            else:
                part = out[n - back :]
                out += (part * (count // back + 1))[:count]
            n += count
            x += count
            fresh = True
        else:
            if cached < n:
                for p in out[cached:n]:
                    cache[((p * HASH) & 0xFFFFFFFF) >> shift] = p
                cached = n
            out.append(cache[e - 280])
            n += 1
            x += 1
        if x >= width:
            y += x // width
            x %= width
            fresh = True
    bits.window, bits.have = window, have
    if bits.over():
        raise Damaged("the data end early")
    return out


def _mean(a: int, b: int) -> int:
    """Of each channel, rounded down."""
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _select(left: int, top: int, corner: int) -> int:
    d = 0
    for k in (0, 8, 16, 24):
        c = corner >> k & 255
        d += abs((left >> k & 255) - c) - abs((top >> k & 255) - c)
    return left if d > 0 else top


def _sum(left: int, top: int, corner: int) -> int:
    out = 0
    for k in (0, 8, 16, 24):
        v = (left >> k & 255) + (top >> k & 255) - (corner >> k & 255)
        out |= (0 if v < 0 else 255 if v > 255 else v) << k
    return out


def _half(mean: int, corner: int) -> int:
    out = 0
    for k in (0, 8, 16, 24):
        a = mean >> k & 255
        d = a - (corner >> k & 255)
        v = a + (d + (d < 0) >> 1)
        out |= (0 if v < 0 else 255 if v > 255 else v) << k
    return out


#: By mode, of the left, top, top-right and top-left pixel; all that is above 13 is as 0.
MODES = (
    lambda l, t, r, c: BLACK,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _mean(_mean(l, r), t),
    lambda l, t, r, c: _mean(l, c),
    lambda l, t, r, c: _mean(l, t),
    lambda l, t, r, c: _mean(c, t),
    lambda l, t, r, c: _mean(t, r),
    lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),
    lambda l, t, r, c: _select(l, t, c),
    lambda l, t, r, c: _sum(l, t, c),
    lambda l, t, r, c: _half(_mean(l, t), c),
    lambda l, t, r, c: BLACK,
    lambda l, t, r, c: BLACK,
)


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _subtract(a: int, b: int) -> int:
    return _add(a, _add(~b & 0xFFFFFFFF, 0x01010101))


def unpredict(p: list[int], width: int, height: int, bits: int, modes: list[int]) -> list[int]:
    """Pixels of the differences from what the modes of blocks of 2**bits predict."""
    wide, q = _blocks(width, bits), [0] * len(p)
    q[0] = before = _add(p[0], BLACK)
    for k in range(1, width):
        q[k] = before = _add(p[k], before)
    for y in range(1, height):
        at = y * width
        q[at] = before = _add(p[at], q[at - width])
        row = [MODES[(m >> 8) & 15] for m in modes[(y >> bits) * wide : (y >> bits) * wide + wide]]
        for x in range(1, width):
            k = at + x
            q[k] = before = _add(p[k], row[x >> bits](before, q[k - width], q[k - width + 1], q[k - width - 1]))
    return q


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _crossed(p: list[int], width: int, height: int, bits: int, elements: list[int], back: bool) -> list[int]:
    """Undo (back) or apply the cross-colour transform, by the elements of blocks of 2**bits."""
    a = np.array(p, np.int64).reshape(height, width)
    e = np.array(elements, np.int64).reshape(-1, _blocks(width, bits))[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]
    green = _signed(a >> 8 & 255)
    to_red, to_blue, red_to_blue = _signed(e & 255), _signed(e >> 8 & 255), _signed(e >> 16 & 255)
    sign = 1 if back else -1
    red = (a >> 16 & 255) + sign * (to_red * green >> 5) & 255
    blue = (a & 255) + sign * ((to_blue * green >> 5) + (red_to_blue * _signed(red if back else a >> 16 & 255) >> 5)) & 255
    return ((a & 0xFF00FF00) | red << 16 | blue).ravel().tolist()


def _greened(p: list[int], sign: int) -> list[int]:
    a = np.array(p, np.int64)
    g = a >> 8 & 255
    return ((a & 0xFF00FF00) | ((a >> 16 & 255) + sign * g & 255) << 16 | ((a & 255) + sign * g & 255)).tolist()


def _colours(p: list[int], width: int, height: int, packed: int, palette: list[int]) -> list[int]:
    """Colours of the numbers, 2**packed of which share a pixel's green; those past the palette are transparent black."""
    per = 8 >> packed
    g = np.array(p, np.int64).reshape(height, -1) >> 8 & 255
    x = np.arange(width)
    index = g[:, x >> packed] >> ((x & (1 << packed) - 1) * per) & (1 << per) - 1
    return np.append(palette, np.zeros(256, np.int64))[index].ravel().tolist()


def _chunk(data: bytes) -> bytes:
    """The lossless stream in the container."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Damaged("no WebP container")
    at = 12
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if kind == b"VP8L":
            if at + 8 + size > len(data):
                raise Damaged("the data end early")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise Damaged("no lossless stream")


def decode(data: bytes) -> tuple[int, int, list[int]]:
    """(width, height, pixels as ARGB numbers, row by row); Damaged if the bytes are no whole lossless image."""
    bits = Bits(_chunk(data))
    if bits.read(8) != 0x2F:
        raise Damaged("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Damaged("an unknown version")
    if width * height > MOST_PIXELS:
        raise Damaged(f"over {MOST_PIXELS} pixels")
    undo, inner, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Damaged("a transform that comes twice")
        seen.add(kind)
        if kind < 2:
            size = bits.read(3) + 2
            undo.append((kind, inner, size, _pixels(bits, _blocks(inner, size), _blocks(height, size), False)))
        elif kind == 2:
            undo.append((kind, inner, 0, []))
        else:
            size = bits.read(8) + 1
            palette = _pixels(bits, size, 1, False)
            for k in range(1, size):
                palette[k] = _add(palette[k], palette[k - 1])
            packed = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, inner, packed, palette))
            inner = _blocks(inner, packed)
    p = _pixels(bits, inner, height, True)
    for kind, wide, size, values in reversed(undo):
        if kind == 0:
            p = unpredict(p, wide, height, size, values)
        elif kind == 1:
            p = _crossed(p, wide, height, size, values, True)
        elif kind == 2:
            p = _greened(p, 1)
        else:
            p = _colours(p, wide, height, size, values)
    return width, height, p


class Writer:
    def __init__(self) -> None:
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def _lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Lengths of a prefix code of at most so many bits."""
    if len(counts) == 1:
        return {s: 1 for s in counts}
    least = 1
    while True:
        heap = [(max(n, least), s, [s]) for s, n in counts.items()]
        heapq.heapify(heap)
        out = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                out[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(out.values()) <= most:
            return out
        least = 2 * least + 1


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Bits, first one lowest, and their number, of each symbol."""
    if len(lengths) == 1:
        return {s: (0, 0) for s in lengths}
    out, code, before = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - before
        before = n
        out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
        code += 1
    return out


def _write_code(w: Writer, counts: dict[int, int], alphabet: int, cut: bool) -> dict[int, tuple[int, int]]:
    """A prefix code for the counts, a simple one where that can be; cut: says how many code lengths come, else zeros fill the alphabet."""
    symbols = sorted(counts) or [0]
    if len(symbols) <= 2 and symbols[-1] < 256:
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(int(symbols[0] > 1), 1)
        w.put(symbols[0], 8 if symbols[0] > 1 else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return _codes(dict.fromkeys(symbols, 1))
    w.put(0, 1)
    lengths = _lengths(counts, 15)
    items: list[tuple[int, int, int]] = []
    at = 0
    for s in symbols if cut else [*symbols, alphabet]:
        gap = s - at
        while gap:
            n = min(gap, 138) if gap >= 11 else min(gap, 10) if gap >= 3 else 1
            items.append((18, n - 11, 7) if n >= 11 else (17, n - 3, 3) if n >= 3 else (0, 0, 0))
            gap -= n
        if s < alphabet:
            items.append((lengths[s], 0, 0))
        at = s + 1
    packed: list[tuple[int, int, int]] = []
    k = 0
    while k < len(items):  # a run of equal lengths becomes one of them and repeats of 3 to 6
        run = 1
        while k + run < len(items) and items[k + run] == items[k] and 0 < items[k][0] < 16:
            run += 1
        packed.append(items[k])
        left = run - 1
        while left >= 3:
            packed.append((16, min(left, 6) - 3, 2))
            left -= min(left, 6)
        packed += [items[k]] * left
        k += run
    own: dict[int, int] = {}
    for c, _, _ in packed:
        own[c] = own.get(c, 0) + 1
    own_lengths = _lengths(own, 7)
    n = max(4, *(k + 1 for k, s in enumerate(LENGTH_ORDER) if s in own_lengths))
    w.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.put(own_lengths.get(s, 0), 3)
    w.put(int(cut), 1)
    if cut:
        size = max(0, ((len(packed) - 2).bit_length() + 1) // 2 - 1)
        w.put(size, 3)
        w.put(len(packed) - 2, 2 + 2 * size)
    own_codes = _codes(own_lengths)
    for c, extra, bits in packed:
        w.put(*own_codes[c])
        w.put(extra, bits)
    return _codes(lengths)


def _prefixed(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number, of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * n + 2 + (v >> n & 1), v & ((1 << n) - 1), n


def _write_pixels(w: Writer, p: list[int], width: int, main: bool, cache_bits: int = 0, meta_bits: int = 0, references: bool = True) -> None:
    """One entropy-coded image; meta_bits: two groups of codes, chosen for blocks in the manner of a chess board."""
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    height, shift = len(p) // width, 32 - cache_bits
    wide = _blocks(width, meta_bits) if meta_bits else 0
    if main:
        w.put(int(meta_bits > 0), 1)
        if meta_bits:
            w.put(meta_bits - 2, 3)
            high = _blocks(height, meta_bits)
            _write_pixels(w, [((x + y) & 1) << 8 for y in range(high) for x in range(wide)], wide, False)
    groups = 2 if meta_bits and wide * _blocks(height, meta_bits) > 1 else 1
    near = {dx + dy * width: k + 1 for k, (dx, dy) in reversed(list(enumerate(NEAR))) if dx + dy * width >= 1} if references else {}
    counts: list[list[dict[int, int]]] = [[{} for _ in range(5)] for _ in range(groups)]
    ops, seen, cache, at = [], {}, {}, 0
    while at < len(p):
        group = ((at % width >> meta_bits) + (at // width >> meta_bits)) & 1 if groups == 2 else 0
        own, n = counts[group], 0
        if references and (start := seen.get(tuple(p[at : at + 3]))) is not None and at + 3 <= len(p):
            while at + n < len(p) and n < 4096 and p[start + n] == p[at + n]:
                n += 1
        if n >= 3:
            back = at - start
            items = [(0, 256 + (x := _prefixed(n))[0]), (-1, x[1], x[2]), (4, (d := _prefixed(near.get(back, back + 120)))[0]), (-1, d[1], d[2])]
        else:
            n, v = 1, p[at]
            if cache_bits and cache.get(h := (v * HASH & 0xFFFFFFFF) >> shift) == v:
                items = [(0, 280 + h)]
            else:
                items = [(0, v >> 8 & 255), (1, v >> 16 & 255), (2, v & 255), (3, v >> 24)]
        for item in items:
            if item[0] >= 0:
                own[item[0]][item[1]] = own[item[0]].get(item[1], 0) + 1
        ops.append((group, items))
        for k in range(at, at + n):
            if references:
                seen[tuple(p[k : k + 3])] = k
            if cache_bits:
                cache[(p[k] * HASH & 0xFFFFFFFF) >> shift] = p[k]
        at += n
    codes = [[_write_code(w, c, n, bool(len(p) & 1)) for c, n in zip(own, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))] for own in counts]
    for group, items in ops:
        for item in items:
            if item[0] < 0:
                w.put(item[1], item[2])
            else:
                w.put(*codes[group][item[0]][item[1]])


def encode(p: list[int], width: int, transforms: tuple[int, ...] = (), seed: int = 0, block_bits: int = 2, cache_bits: int = 0, meta_bits: int = 0, references: bool = True) -> bytes:
    """A lossless image of the ARGB numbers. transforms: of 0 predictor, 1 cross-colour, 2 subtract green, 3 palette (of up to 256 colours), in that order of writing."""
    rng, height, w, inner = np.random.default_rng(seed), len(p) // width, Writer(), width
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(any(v >> 24 != 255 for v in p)), 1)
    w.put(0, 3)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        blocks = _blocks(inner, block_bits) * _blocks(height, block_bits)
        if kind == 0:
            modes = [int(m) << 8 | BLACK for m in rng.integers(0, 14, blocks)]
            w.put(block_bits - 2, 3)
            _write_pixels(w, modes, _blocks(inner, block_bits), False)
            wide = _blocks(inner, block_bits)
            q = list(p)
            for k in range(len(p)):
                x, y = k % inner, k // inner
                l, t = p[k - 1] if x else 0, p[k - inner] if y else 0
                guess = (l if x else BLACK) if not y else t if not x else MODES[modes[(y >> block_bits) * wide + (x >> block_bits)] >> 8 & 15](l, t, p[k - inner + 1], p[k - inner - 1])
                q[k] = _subtract(p[k], guess)
            p = q
        elif kind == 1:
            elements = [int(v) | BLACK for v in rng.integers(0, 1 << 24, blocks)]
            w.put(block_bits - 2, 3)
            _write_pixels(w, elements, _blocks(inner, block_bits), False)
            p = _crossed(p, inner, height, block_bits, elements, False)
        elif kind == 2:
            p = _greened(p, -1)
        else:
            palette = sorted(set(p))
            w.put(len(palette) - 1, 8)
            deltas = [palette[0], *(_subtract(b, a) for a, b in zip(palette, palette[1:]))]
            _write_pixels(w, deltas, len(palette), False)
            packed = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            number, per, wide = {v: k for k, v in enumerate(palette)}, 8 >> packed, _blocks(inner, packed)
            q = [BLACK] * (wide * height)
            for k, v in enumerate(p):
                x, y = k % inner, k // inner
                q[y * wide + (x >> packed)] |= number[v] << (8 + (x & (1 << packed) - 1) * per)
            p, inner = q, wide
    w.put(0, 1)
    _write_pixels(w, p, inner, True, cache_bits, meta_bits, references)
    data = w.value.to_bytes(-(-w.size // 8), "little")
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + padded


def painted(seed: int) -> tuple[int, list[int], bytes]:
    """(width, pixels, image) of a seed: 1 to 12 pixels a side, some with a small palette, and any features of the format."""
    rng = np.random.default_rng(seed)
    width, height, colours = (int(x) for x in rng.integers((1, 1, 1), (13, 13, 40)))
    palette = rng.integers(0, 1 << 32, colours, dtype=np.int64)
    if seed & 1:
        palette |= BLACK
    at = rng.integers(0, colours, width * height)
    run = rng.random(width * height) < 0.4
    at = at[np.maximum.accumulate(np.where(run, 0, np.arange(width * height)))]
    p = palette[at].tolist()
    few = seed >> 1 & 1
    transforms = tuple(k for k, on in ((3, few), (0, seed >> 2 & 1), (1, seed >> 3 & 1 and not few), (2, seed >> 4 & 1 and not few)) if on)
    if seed >> 5 & 1:
        transforms = transforms[:1] * few + transforms[few:][::-1]
    return width, p, encode(p, width, transforms, seed, 2 + (seed >> 6 & 1), (seed >> 7 & 3) * 2, 2 * (seed >> 9 & 1), bool(seed >> 10 & 3))


SCHEMA = "page_id long, width int, height int, pixels array<int>, damage string"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wide, high, pixels, damage = [], [], [], []
        for data in batch.column(1):
            w = h = p = d = None
            if (raw := data.as_py()) is not None:
                try:
                    w, h, p = decode(raw)
                    p = np.array(p, np.uint32).view(np.int32)
                except Damaged as e:
                    d = str(e)
            wide.append(w), high.append(h), pixels.append(p), damage.append(d)
        yield pa.record_batch({"page_id": batch.column(0), "width": pa.array(wide, pa.int32()), "height": pa.array(high, pa.int32()), "pixels": pa.array(pixels, pa.list_(pa.int32())), "damage": pa.array(damage, pa.string())})


def media(images: DataFrame) -> DataFrame:
    """(page_id, width, height, pixels, damage), one row for every row (page_id, webp).

    pixels are signed 32-bit ARGB numbers, row by row. Bytes that are no whole lossless image, empty ones and
    images of over MOST_PIXELS pixels give nulls and say why in damage; null bytes give nulls throughout. Other
    columns are neither read nor returned; a null page_id stays null and repeated rows stay.
    """
    return images.select(F.col("page_id").cast("long").alias("page_id"), F.col("webp").cast("binary").alias("webp")).mapInArrow(_decoded, SCHEMA)


def _painted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        images = [painted(s & 0x7FFFFFFFFFFFFFFF)[2] for s in batch.column(1).to_pylist()]
        yield pa.record_batch({"page_id": batch.column(0), "webp": pa.array(images, pa.binary())})


def with_media(pages: DataFrame) -> DataFrame:
    """(page_id, webp): an image for every row of pages, seeded by page_id, url and html."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("page_id", "url", "html").alias("seed")).mapInArrow(_painted, "page_id long, webp binary")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(with_media(spark.read.parquet(f"{sf_dir}/pages.parquet")))

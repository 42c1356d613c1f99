"""Lossless WebP (VP8L) in NumPy: a whole decoder, and a writer for plain samples.

The decoder reads prefix codes (simple and normal), meta prefix groups, back-references with the
two-dimensional distance codes, the colour cache, and inverts all four transforms. One image goes
pixel by pixel; many small ones go in step, the k-th pixel of all of them at once (decode_many).
Images whose pixels are literals under prefix codes of 0 or 8 bits each need no loop over pixels.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_MULTIPLIER = 0x1E35A7BD
LITERALS, LENGTH_CODES, DISTANCE_CODES = 256, 24, 40
MOST_SIDE = 1 << 14
#: Groups of codes that are kept to be met again.
MOST_KNOWN = 64
#: Images that go in step: pixels at most, bits of a code at most (four codes are read from 57 bits), images at least.
STEP_PIXELS, STEP_BITS, STEP_IMAGES = 4096, 14, 16

_known: dict[tuple[int, int], list] = {}

REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), axis=1, bitorder="little")[:, 0]


class BadImage(ValueError):
    """The bytes aren't a lossless WebP image."""


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 8, 0
        self.end = 8 * len(data)

    def read(self, n: int) -> int:
        a = self.at
        self.at = a + n
        if self.at > self.end:
            raise BadImage("the stream ends early")
        return int.from_bytes(self.data[a >> 3 : (a >> 3) + 5], "little") >> (a & 7) & ((1 << n) - 1)


class Code:
    """A canonical prefix code; table maps the next `most` bits to (symbol, bits)."""

    def __init__(self, lengths: tuple[int, ...]):
        used = [s for s, n in enumerate(lengths) if n]
        self.only, self.words = None, None
        self.plain = set(lengths[:LITERALS]) == {8} and not any(lengths[LITERALS:])
        if len(used) <= 1:
            self.only, self.most = (used or [0])[0], 0
            return
        self.most = max(lengths)
        if sum(1 << (self.most - n) for n in lengths if n) != 1 << self.most:
            raise BadImage("a prefix code isn't complete")
        self.symbols, self.bits = np.zeros(1 << self.most, np.int32), np.zeros(1 << self.most, np.uint8)
        code = 0
        for n in range(1, self.most + 1):
            for s in used:
                if lengths[s] == n:
                    back = int(format(code, f"0{n}b")[::-1], 2)
                    self.symbols[back :: 1 << n], self.bits[back :: 1 << n] = s, n
                    code += 1
            code <<= 1
        self.symbols, self.bits = self.symbols.tolist(), self.bits.tolist()

    def table(self) -> np.ndarray:
        """Symbol and, from bit 16, its bits for each value of the next `most` bits."""
        if self.words is None:
            self.words = np.array([self.only], np.uint64) if self.only is not None else np.array(self.symbols, np.uint64) | np.array(self.bits, np.uint64) << np.uint64(16)
        return self.words

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        a = bits.at
        peek = int.from_bytes(bits.data[a >> 3 : (a >> 3) + 4], "little") >> (a & 7) & ((1 << self.most) - 1)
        bits.at = a + self.bits[peek]
        if bits.at > bits.end:
            raise BadImage("the stream ends early")
        return self.symbols[peek]


@lru_cache(maxsize=256)
def code_of(lengths: tuple[int, ...]) -> Code:
    return Code(lengths)


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        found = [first, bits.read(8)] if two else [first]
        for s in found:
            if s >= size:
                raise BadImage("a symbol is out of range")
            lengths[s] = 1
        return code_of(tuple(lengths))
    order = [0] * len(LENGTH_ORDER)
    for s in LENGTH_ORDER[: 4 + bits.read(4)]:
        order[s] = bits.read(3)
    code = code_of(tuple(order))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if most > size:
        raise BadImage("too many code lengths")
    if code.only is not None and code.only < 16:
        n = min(most, size)
        return code_of((code.only,) * n + (0,) * (size - n))
    s, last = 0, 8
    while s < size and most:
        most -= 1
        n = code.read(bits)
        if n < 16:
            lengths[s] = n
            s, last = s + 1, n or last
            continue
        value, times = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
        if s + times > size:
            raise BadImage("a run of code lengths is too long")
        lengths[s : s + times] = [value] * times
        s += times
    return code_of(tuple(lengths))


def read_number(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def blocks(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


@dataclass
class Head:
    """What stands before an image's pixels: colour cache, prefix groups and their codes."""

    cache_bits: int
    groups: list[list[int]] | None
    group_bits: int
    codes: list[list[Code]]


def read_codes(bits: Bits, cache_bits: int, n: int) -> list[list[Code]]:
    """n groups of five codes. Writers repeat themselves: the last single groups read are met again by their bits."""
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    if n > 1:
        return [[read_code(bits, s) for s in sizes] for _ in range(n)]
    a = bits.at
    word = lambda k: int.from_bytes(bits.data[a >> 3 : (a + k + 7) >> 3], "little") >> (a & 7) & ((1 << k) - 1)
    key = (cache_bits, word(64))
    for k, value, codes in _known.get(key, ()):
        if a + k <= bits.end and word(k) == value:
            bits.at = a + k
            return codes
    codes = [[read_code(bits, s) for s in sizes]]
    if len(_known) >= MOST_KNOWN:
        _known.clear()
    _known[key] = [(bits.at - a, word(bits.at - a), codes), *_known.get(key, ())[:3]]
    return codes


def read_head(bits: Bits, width: int, height: int, main: bool) -> Head:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    groups, group_bits = None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups = (read_pixels(bits, blocks(width, group_bits), blocks(height, group_bits), False) >> 8 & 0xFFFF).reshape(blocks(height, group_bits), -1).tolist()
    return Head(cache_bits, groups, group_bits, read_codes(bits, cache_bits, 1 + max(map(max, groups)) if groups else 1))


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as ARGB words, before the transforms are inverted."""
    return read_body(bits, width, height, read_head(bits, width, height, main))


def read_body(bits: Bits, width: int, height: int, head: Head) -> np.ndarray:
    cache_bits, groups, group_bits, codes = head.cache_bits, head.groups, head.group_bits, head.codes
    count = width * height
    if groups is None and not cache_bits and (plain := read_plain(bits, codes[0], count)) is not None:
        return plain
    out = [0] * count
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    at = stored = 0
    green, red, blue, alpha, distance = codes[0]
    while at < count:
        if groups is not None:
            green, red, blue, alpha, distance = codes[groups[at // width >> group_bits][at % width >> group_bits]]
        s = green.read(bits)
        if s < LITERALS:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < LITERALS + LENGTH_CODES:
            length = read_number(bits, s - LITERALS)
            back = read_number(bits, distance.read(bits))
            if back > len(DISTANCES):
                back -= len(DISTANCES)
            else:
                x, y = DISTANCES[back - 1]
                back = max(1, x + y * width)
            if back > at or at + length > count:
                raise BadImage("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            while stored < at:
                v = out[stored]
                cache[(v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = v
                stored += 1
            out[at] = cache[s - LITERALS - LENGTH_CODES]
            at += 1
    return np.array(out, np.uint32)


def read_plain(bits: Bits, codes: list[Code], count: int) -> np.ndarray | None:
    """All pixels at once where each channel's code has 0 or 8 bits and only literals; else None."""
    if any(c.only is None and not c.plain for c in codes[:4]):
        return None
    if codes[0].only is not None and codes[0].only >= LITERALS:
        return None
    wide = [c for c in range(4) if codes[c].only is None]
    n = count * len(wide)
    if bits.at + 8 * n > bits.end:
        raise BadImage("the stream ends early")
    raw, shift = np.frombuffer(bits.data, np.uint8, n + 1, bits.at >> 3), bits.at & 7
    got = REVERSED[(raw[:-1] >> shift | raw[1:] << (8 - shift)) if shift else raw[:-1]].reshape(count, len(wide))
    bits.at += 8 * n
    argb = np.empty((count, 4), np.uint8)  # little-endian words: blue, green, red, alpha
    for channel, place in zip(range(4), (1, 2, 0, 3), strict=True):
        argb[:, place] = got[:, wide.index(channel)] if channel in wide else codes[channel].only
    return argb.view("<u4")[:, 0].astype(np.uint32, copy=False)


def channels(argb: np.ndarray) -> np.ndarray:
    """(n, 4) int32: alpha, red, green, blue."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int32)


def words(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & 0xFF
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predicted(mode: int, left, top, right, corner):
    """The prediction for a pixel from its left, top, top-right and top-left neighbours, by channel."""
    half = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return half(half(left, right), top)
    if mode == 6:
        return half(left, corner)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(corner, top)
    if mode == 9:
        return half(top, right)
    if mode == 10:
        return half(half(left, corner), half(top, right))
    if mode == 11:
        near = left + top - corner
        return np.where(np.abs(near - left).sum(-1, keepdims=True) < np.abs(near - top).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        mean = half(left, top)
        return np.clip(mean + ((mean - corner) / 2).astype(np.int32), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0], np.int32), left.shape)


def add_predictions(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c = channels(argb).reshape(height * width, 4)
    modes = (modes >> 8 & 0xF).reshape(blocks(height, bits), -1)
    c[0] = c[0] + [255, 0, 0, 0] & 0xFF
    c[:width] = np.cumsum(c[:width], 0) & 0xFF
    c[::width] = np.cumsum(c[::width], 0) & 0xFF
    # A pixel needs its left, top-left, top and top-right ones (the last pixel's is the first of its own row): those with
    # the same x + 2y don't need each other.
    for t in range(3, width + 2 * height - 2) if width > 1 else ():
        y = np.arange(max(1, (t - width + 2) // 2), min(height - 1, (t - 1) // 2) + 1)
        x = t - 2 * y
        k, mode = y * width + x, modes[y >> bits, x >> bits]
        for m in np.unique(mode):
            at = k[mode == m]
            c[at] = c[at] + predicted(int(m), c[at - 1], c[at - width], c[at - width + 1], c[at - width - 1]) & 0xFF
    return words(c)


def delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8)) >> 5


def cross_colour(argb: np.ndarray, width: int, height: int, elements: np.ndarray, bits: int, sign: int = 1) -> np.ndarray:
    """sign 1 inverts the transform, -1 applies it."""
    c = channels(argb)
    e = channels(elements).reshape(blocks(height, bits), -1, 4)
    e = e[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits].reshape(-1, 4)
    old = c[:, 1].copy()
    c[:, 1] = c[:, 1] + sign * delta(e[:, 3], c[:, 2]) & 0xFF
    red = c[:, 1] if sign == 1 else old
    c[:, 3] = c[:, 3] + sign * (delta(e[:, 2], c[:, 2]) + delta(e[:, 1], red)) & 0xFF
    return words(c)


def add_green(argb: np.ndarray, sign: int = 1) -> np.ndarray:
    c = channels(argb)
    c[:, 1] += sign * c[:, 2]
    c[:, 3] += sign * c[:, 2]
    return words(c)


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpack_palette(argb: np.ndarray, width: int, height: int, palette: np.ndarray, bits: int) -> np.ndarray:
    green = (argb >> 8 & 0xFF).reshape(height, -1)
    x, each = np.arange(width), 8 >> bits
    index = green[:, x >> bits] >> ((x & (1 << bits) - 1) * each).astype(np.uint32) & (1 << each) - 1
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index].reshape(-1)


@dataclass
class Opened:
    """A VP8L chunk read up to its main image."""

    bits: Bits
    width: int
    height: int
    now: int
    undo: list[tuple]

    def finish(self, argb: np.ndarray) -> np.ndarray:
        """Pixels (height, width, 4) RGBA of the main image's words."""
        for kind, wide, image, size in reversed(self.undo):
            if kind == 0:
                argb = add_predictions(argb, wide, self.height, image, size)
            elif kind == 1:
                argb = cross_colour(argb, wide, self.height, image, size)
            elif kind == 2:
                argb = add_green(argb)
            else:
                argb = unpack_palette(argb, wide, self.height, image, size)
        little = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(self.height, self.width, 4)
        return little[:, :, [2, 1, 0, 3]]


def open_stream(data: bytes) -> Opened:
    if data[:1] != b"\x2f":
        raise BadImage("no VP8L signature")
    bits = Bits(data)
    bits.at = 8
    width, height, _ = bits.read(14) + 1, bits.read(14) + 1, bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform comes twice")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            undo.append((kind, now, read_pixels(bits, blocks(now, size), blocks(height, size), False), size))
        elif kind == 2:
            undo.append((kind, now, None, 0))
        else:
            n = bits.read(8) + 1
            palette = words(np.cumsum(channels(read_pixels(bits, n, 1, False)), 0))
            undo.append((kind, now, palette, bundle_bits(n)))
            now = blocks(now, bundle_bits(n))
    return Opened(bits, width, height, now, undo)


def chunk(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no WebP container")
    at, end = 12, 8 + struct.unpack_from("<I", data, 4)[0]
    while at + 8 <= min(end, len(data)):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise BadImage("no VP8L chunk")


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) RGBA of a WebP file with one lossless image."""
    image = open_stream(chunk(data))
    return image.finish(read_pixels(image.bits, image.now, image.height, True))


def decode_many(found: list[bytes]) -> list[np.ndarray | Exception]:
    """decode() of each file, or the error it raises; small images with one group of codes go in step."""
    out: list = [None] * len(found)
    lanes = []
    for i, data in enumerate(found):
        try:
            image = open_stream(chunk(data))
            head = read_head(image.bits, image.now, image.height, True)
            if head.groups is None and image.now * image.height <= STEP_PIXELS and all((c.most <= STEP_BITS) for c in head.codes[0]):
                lanes.append((i, image, head))
            else:
                out[i] = image.finish(read_body(image.bits, image.now, image.height, head))
        except (BadImage, ValueError, IndexError, struct.error) as e:
            out[i] = e
    if len(lanes) >= STEP_IMAGES:
        lanes.sort(key=lambda lane: -lane[1].now * lane[1].height)
        bodies = read_in_step([lane[1:] for lane in lanes])
    else:
        bodies = [None] * len(lanes)
    for (i, image, head), argb in zip(lanes, bodies, strict=True):
        try:
            if argb is None:
                argb = read_body(image.bits, image.now, image.height, head)
            out[i] = argb if isinstance(argb, Exception) else image.finish(argb)
        except (BadImage, ValueError, IndexError) as e:
            out[i] = e
    return out


def numbers(prefix: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """read_number for many: values and their extra bits, taken from the low bits of v."""
    extra = np.maximum(prefix.astype(np.int64) - 2, 0) >> 1
    e = extra.astype(np.uint64)
    high = np.where(prefix < 4, prefix, (np.uint64(2) + (prefix & np.uint64(1))) << e)
    return (high + (v & ((np.uint64(1) << e) - np.uint64(1)))).astype(np.int64) + 1, e


def read_in_step(lanes: list[tuple[Opened, Head]]) -> list[np.ndarray | Exception]:
    """The main images' words, largest first in lanes: the k-th pixel of every image is read at once."""
    u = np.uint64
    counts = np.array([i.now * i.height for i, _ in lanes])
    wide = np.array([i.now for i, _ in lanes])
    sizes = np.array([len(i.bits.data) for i, _ in lanes])
    base = np.cumsum(sizes) - sizes
    flat = b"".join(i.bits.data for i, _ in lanes) + b"\0" * 8
    words_at = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))
    pos = base * 8 + np.array([i.bits.at for i, _ in lanes])
    end = base * 8 + np.array([i.bits.end for i, _ in lanes])
    tables, start, total = [], {}, 0
    for _, head in lanes:
        for code in head.codes[0]:
            if id(code) not in start:
                start[id(code)] = total
                tables.append(code.table())
                total += len(tables[-1])
    table = np.concatenate(tables)
    off = np.array([[start[id(c)] for c in h.codes[0]] for _, h in lanes], np.uint64).T.copy()
    mask = np.array([[(1 << c.most) - 1 for c in h.codes[0]] for _, h in lanes], np.uint64).T.copy()
    shift = np.array([32 - h.cache_bits for _, h in lanes], np.uint64)
    cache = np.zeros((len(lanes), 1 << max(h.cache_bits for _, h in lanes)), np.uint32)
    xs, ys = (np.array(d) for d in zip(*DISTANCES, strict=True))
    out = np.zeros((int(counts[0]), len(lanes)), np.uint32)
    left, back, broken = np.zeros(len(lanes), np.int64), np.ones(len(lanes), np.int64), np.zeros(len(lanes), bool)
    lane = np.arange(len(lanes))
    active = np.searchsorted(-counts, -np.arange(int(counts[0])), "left")
    low, sixteen = u(0xFFFF), u(16)
    for k in range(int(counts[0])):
        m = int(active[k])
        p = np.minimum(pos[:m], len(flat) * 8 - 64)
        v = words_at[p >> 3] >> (p & 7).astype(np.uint64)
        entry = table[off[0, :m] + (v & mask[0, :m])]
        s, n = entry & low, entry >> sixteen
        v = v >> n
        first, px = n, None
        for channel, place in ((1, 16), (2, 0), (3, 24)):
            entry = table[off[channel, :m] + (v & mask[channel, :m])]
            bits = entry >> sixteen
            v = v >> bits
            n = n + bits
            part = (entry & low) << u(place)
            px = part if px is None else px | part
        px = (px | s << u(8)).astype(np.uint32)
        other = np.flatnonzero((s >= LITERALS) | (left[:m] > 0))
        if len(other):
            going = left[other] > 0
            fresh = other[~going]
            sym = s[fresh]
            n[other[going]] = 0
            n[fresh] = first[fresh]
            kept = sym >= LITERALS + LENGTH_CODES
            hit = fresh[kept]
            px[hit] = cache[hit, (sym[kept] - u(LITERALS + LENGTH_CODES)).astype(np.int64)]
            copy = fresh[~kept]
            if len(copy):
                c = np.minimum(pos[copy], len(flat) * 8 - 64)
                rest = words_at[c >> 3] >> (c & 7).astype(np.uint64) >> first[copy]
                length, e1 = numbers(sym[~kept] - u(LITERALS), rest)
                rest = rest >> e1
                entry = table[off[4, copy] + (rest & mask[4, copy])]
                e2 = entry >> sixteen
                distance, e3 = numbers(entry & low, rest >> e2)
                n[copy] += e1 + e2 + e3
                near = distance <= len(DISTANCES)
                d = np.where(near, distance, 1) - 1
                distance = np.where(near, np.maximum(1, xs[d] + ys[d] * wide[copy]), distance - len(DISTANCES))
                bad = (distance > k) | (k + length > counts[copy])
                broken[copy] |= bad
                back[copy], left[copy] = np.where(bad, 0, distance), np.where(bad, 1, length)
            copying = other[left[other] > 0]
            px[copying] = out[k - back[copying], copying]
            left[copying] -= 1
        out[k, :m] = px
        cache[lane[:m], (px.astype(np.uint64) * u(CACHE_MULTIPLIER) & u(0xFFFFFFFF)) >> shift[:m]] = px
        pos[:m] += n.astype(np.int64)
    broken |= pos > end
    return [BadImage("a broken stream") if broken[i] else out[: counts[i], i] for i in lane]


class Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def done(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body

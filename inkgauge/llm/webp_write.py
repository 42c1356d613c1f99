"""A lossless WebP writer for small images, in NumPy: transforms, back-references, a colour cache and prefix codes.

The transform and the code book with the least bits are taken. Books are fixed by rules, not fitted to any data, so
that equal pixels have equal files everywhere and a reader meets the same codes again.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from inkgauge.llm.webp import (
    CACHE_MULTIPLIER, DISTANCE_CODES, DISTANCES, LENGTH_CODES, LENGTH_ORDER, LITERALS, Writer, blocks, bundle_bits, channels, container,
)

#: Bits of the colour cache, bits of a code at most, bits of a tile's side, least pixels of a match.
CACHE_BITS, MOST_CODE, TILE_BITS, LEAST_MATCH = 6, 12, 4, 3


def lengths_of(counts: Counter, size: int, most: int = 15) -> list[int]:
    """Code lengths by Huffman, flattened until none is over most."""
    out = [0] * size
    if len(counts) <= 1:
        for s in counts:
            out[s] = 1
        return out
    weight = dict(counts)
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(weight.items()))]
        heapq.heapify(heap)
        depth, k = Counter(), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(depth.values()) <= most:
            for s, d in depth.items():
                out[s] = d
            return out
        weight = {s: n // 2 + 1 for s, n in weight.items()}


def codes_of(lengths: list[int]) -> dict[int, tuple[int, int]]:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        return {used[0]: (0, 0)}
    code, out = 0, {}
    for n in range(1, 16):
        for s in used:
            if lengths[s] == n:
                out[s] = (int(format(code, f"0{n}b")[::-1], 2), n)
                code += 1
        code <<= 1
    return out


def put_code(w: Writer, lengths: list[int]) -> dict:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        wide = used[0] > 1
        w.put(int(wide), 1)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {used[0]: (0, 0)}
    w.put(0, 1)
    runs, i, last = [], 0, 8
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n, v = j - i, lengths[i]
        if v == 0 and n >= 3:
            k = min(n, 138)
            runs.append((17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            i += k
        elif v and v == last and n >= 3:
            k = min(n, 6)
            runs.append((16, k - 3, 2))
            i += k
        else:
            runs.append((v, 0, 0))
            last = v or last
            i += 1
    order = lengths_of(Counter(r[0] for r in runs), 19, 7)
    n = max(k + 1 for k, s in enumerate(LENGTH_ORDER) if order[s])
    n = max(n, 4)
    w.put(n - 4, 4)
    for s in LENGTH_ORDER[:n]:
        w.put(order[s], 3)
    w.put(0, 1)
    code = codes_of(order)
    for s, extra, bits in runs:
        w.put(*code[s])
        w.put(extra, bits)
    return codes_of(lengths)


def number(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, extra) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, high - 1, v - ((2 + second) << (high - 1))


def weights(kind: str) -> list[int]:
    """How often each byte is taken to occur, by rules."""
    if kind == "even":
        return [64] * 256
    if kind == "rest":  # of a prediction: small steps up or down
        return [max(1, 2048 >> min(min(b, 256 - b), 11)) for b in range(256)]
    ascii_part = [4 if 32 <= b < 127 else 1 for b in range(128)]
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 24), ("etaoinshr", 72), ("0123456789", 8), (" ", 160), ("\n", 16), ("\0", 8)):
        for c in letters:
            ascii_part[ord(c)] = n
    if kind == "wide":  # UTF-8 of many bytes
        return [max(1, n // 3) for n in ascii_part] + [24] * 64 + [1, 1] + [8] * 30 + [16] * 16 + [2] * 5 + [1] * 11
    return ascii_part + [1] * 128


@dataclass
class Book:
    """Codes of the five alphabets: (symbol values, symbol bits) arrays, and how they are written."""

    codes: list[tuple[np.ndarray, np.ndarray]]
    cost: np.ndarray
    written: Writer


@lru_cache(maxsize=8)
def book(kind: str) -> Book:
    """kind "index" is for palette indices: only green differs."""
    cache = 1 << CACHE_BITS
    literal = weights("even" if kind == "index" else kind)
    green = literal + [4] * LENGTH_CODES + [max(2, sum(literal) // (16 * cache))] * cache
    single = lambda s: Counter({s: 1})
    three = [single(0), single(0), single(255)] if kind == "index" else [Counter(dict(enumerate(literal)))] * 3
    counts = [Counter(dict(enumerate(green))), *three, Counter(dict.fromkeys(range(DISTANCE_CODES), 1))]
    w = Writer()
    w.put(1, 1)
    w.put(CACHE_BITS, 4)
    w.put(0, 1)
    codes = []
    for n, size in zip(counts, (len(green), 256, 256, 256, DISTANCE_CODES), strict=True):
        value, bits = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        for s, (v, b) in put_code(w, lengths_of(n, size, MOST_CODE)).items():
            value[s], bits[s] = v, b
        codes.append((value, bits))
    return Book(codes, codes[1][1].astype(np.int64), w)


KINDS = ("text", "wide", "even", "rest")


@lru_cache(maxsize=1)
def all_costs() -> np.ndarray:
    return np.stack([book(k).cost for k in KINDS])


def before(values: np.ndarray) -> np.ndarray:
    """The last earlier place of each value, -1 where there is none."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def copies(argb: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(place, length, how far back), greedily from the first pixel on."""
    n = len(argb) - LEAST_MATCH + 1
    if n < 2:
        return
    # Odd factors spread the sum of three words over 64 bits; places with one sum are compared.
    a = argb.astype(np.uint64)
    found = before(a[:n] * np.uint64(0x9E3779B97F4A7C15) + a[1 : n + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + a[2 : n + 2] * np.uint64(0x165667B19E3779F9))
    at = 0
    for i in np.flatnonzero(found >= 0).tolist():
        if i < at:
            continue
        j = int(found[i])
        other = np.flatnonzero(argb[i:] != argb[j : j + len(argb) - i])
        length = int(other[0]) if len(other) else len(argb) - i
        if length >= LEAST_MATCH:
            yield i, length, i - j
            at = i + length


@lru_cache(maxsize=16)
def distance_codes(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(DISTANCES):
        out.setdefault(max(1, x + y * width), k + 1)
    return out


def body_bits(argb: np.ndarray, width: int, b: Book) -> np.ndarray:
    """The bits of all pixels, one a byte."""
    samples = argb.view(np.uint8).reshape(-1, 4)
    colours = [samples[:, k] for k in (1, 2, 0, 3)]
    value, bits = (x[colours[0]].copy() for x in b.codes[0])
    for c, (v, n) in zip(colours[1:], b.codes[1:4], strict=True):
        value |= v[c] << bits
        bits += n[c]
    place = (argb.astype(np.uint64) * np.uint64(CACHE_MULTIPLIER) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)
    last = before(place)
    # A cache place starts as 0, but a pixel that is 0 and wasn't met is written as a literal.
    hit = (last >= 0) & (argb[last] == argb)
    s = (place[hit] + np.uint64(LITERALS + LENGTH_CODES)).astype(np.int64)
    value[hit], bits[hit] = b.codes[0][0][s], b.codes[0][1][s]
    near = distance_codes(width)
    for i, length, back in copies(argb):
        v = n = 0
        for k, base, x in ((0, LITERALS, length), (4, 0, near.get(back, back + len(DISTANCES)))):
            prefix, extra, more = number(x)
            v |= int(b.codes[k][0][base + prefix]) << n
            n += int(b.codes[k][1][base + prefix])
            v |= more << n
            n += extra
        bits[i : i + length] = 0
        value[i], bits[i] = v, n
    every = np.arange(int(bits.max(initial=0)), dtype=np.uint64)
    return (value[:, None] >> every & np.uint64(1)).astype(np.uint8)[every < bits[:, None]]


def put_one(w: Writer, argb: int) -> None:
    """A sub-image of one colour: no cache, five codes of one symbol."""
    w.put(0, 1)
    for s in (argb >> 8 & 255, argb >> 16 & 255, argb & 255, argb >> 24, 0):
        w.put(0b101, 3)
        w.put(s, 8)


@lru_cache(maxsize=1)
def even_codes() -> tuple[Writer, np.ndarray]:
    """A palette's codes, 8 bits a sample and no cache, and the bits of each sample."""
    w = Writer()
    w.put(0, 1)
    even = lengths_of(Counter(dict.fromkeys(range(256), 1)), LITERALS + LENGTH_CODES)
    for k in range(4):
        code = put_code(w, even if k == 0 else even[:256])
    put_code(w, [0] * DISTANCE_CODES)
    return w, np.array([code[s][0] for s in range(256)])


def residual(c: np.ndarray, mode: int) -> np.ndarray:
    """Samples (height, width, 4), alpha last, less their prediction: 1 left, 2 top, 7 the mean of both."""
    guess = np.empty_like(c)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
    left, top = c[1:, :-1], c[:-1, 1:]
    guess[1:, 1:] = left if mode == 1 else top if mode == 2 else (left & top) + ((left ^ top) >> 1)
    return c - guess


def slope(x: np.ndarray, xx: float, y: np.ndarray) -> int:
    """The multiplier of a colour transform that takes most of x out of y, both signed; xx is x by itself."""
    return max(-128, min(127, round(32 * float(x @ y) / max(xx, 1.0))))


def less_colour(c: np.ndarray) -> tuple[int, np.ndarray]:
    """(multipliers as an element of the colour transform, samples blue, green, red, alpha without what they foretell)."""
    blue, green, red = c.view(np.int8)[:, :3].T.astype(np.float32)
    gg, rr = float(green @ green), float(red @ red)
    to_red, to_blue, red_to_blue = slope(green, gg, red), slope(green, gg, blue), slope(red, rr, blue)
    out = c.copy()
    if to_red or to_blue or red_to_blue:
        g, r = c.view(np.int8)[:, 1].astype(np.int16), c.view(np.int8)[:, 2].astype(np.int16)
        out[:, 2] -= (to_red * g >> 5).astype(np.uint8)
        out[:, 0] -= ((to_blue * g >> 5) + (red_to_blue * r >> 5)).astype(np.uint8)
    return (red_to_blue & 0xFF) << 16 | (to_blue & 0xFF) << 8 | to_red & 0xFF, out


def plans(argb: np.ndarray, width: int, height: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(prediction, colour element or 0, samples that are left): as they are, predictions, colours, predictions then colours."""
    c = argb.view(np.uint8).reshape(height, width, 4)
    tries = [(None, c.reshape(-1, 4)), *((m, residual(c, m).reshape(-1, 4)) for m in (1, 2, 7))]
    for mode, rest in tries:
        yield mode, 0, rest
    for mode, rest in tries[:2]:
        e, less = less_colour(rest)
        if e:
            yield mode, e, less


def as_palette(argb: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(colours, words of packed indices, their width), or None for more than 256 colours."""
    colours = np.unique(argb)
    if len(colours) > 256:
        return None
    index = np.searchsorted(colours, argb)
    pack = bundle_bits(len(colours))
    now, each = blocks(width, pack), 8 >> pack
    full = np.zeros((height, now << pack), np.uint32)
    full[:, :width] = index.reshape(height, width)
    green = (full.reshape(height, now, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * np.uint32(each))).sum(-1, dtype=np.uint32)
    return colours, (np.uint32(0xFF000000) | green << np.uint32(8)).reshape(-1), now


def encode(rgba: np.ndarray) -> bytes:
    """A WebP file of pixels (height, width, 4) RGBA: the same pixels always give the same bytes."""
    height, width = rgba.shape[:2]
    argb = np.ascontiguousarray(rgba.reshape(-1, 4)[:, [2, 1, 0, 3]]).view("<u4")[:, 0]
    costs = all_costs()
    best, packed = None, as_palette(argb, width, height)
    for plan in plans(argb, width, height):
        bits = costs @ np.bincount(plan[2].reshape(-1), minlength=256)
        k = int(np.argmin(bits))
        if best is None or bits[k] < best[0]:
            best = (bits[k], KINDS[k], plan)
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    if packed is not None and 32 * len(packed[0]) + 8 * len(packed[1]) < best[0]:
        colours, argb, now = packed
        w.put(0b111, 3)
        w.put(len(colours) - 1, 8)
        c = channels(colours)
        codes, turned = even_codes()
        w.put(codes.value, codes.n)
        steps = turned[(np.diff(c, axis=0, prepend=0) & 0xFF)[:, [2, 1, 3, 0]]].astype(np.uint8).tobytes()
        w.put(int.from_bytes(steps, "little"), 8 * len(steps))
        kind, width = "index", now
    else:
        _, kind, (mode, e, rest) = best
        argb = np.ascontiguousarray(rest).view("<u4")[:, 0]
        for used, number_, image in ((mode is not None, 0, 0xFF000000 | (mode or 0) << 8), (e, 1, 0xFF000000 | e)):
            if used:
                w.put(1, 1)
                w.put(number_, 2)
                w.put(TILE_BITS - 2, 3)
                put_one(w, image)
    w.put(0, 1)
    b = book(kind)
    w.put(b.written.value, b.written.n)
    head = np.unpackbits(np.frombuffer(w.done(), np.uint8), bitorder="little")[: w.n]
    return container(np.packbits(np.concatenate([head, body_bits(argb, width, b)]), bitorder="little").tobytes())

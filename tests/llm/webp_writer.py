"""A small lossless WebP writer with every feature the decoder must undo: for round trips only."""

from __future__ import annotations

from collections import Counter

import numpy as np

from inkgauge.llm import webp
from inkgauge.llm.webp import CACHE_MULTIPLIER, DISTANCE_CODES, Writer, add_green, blocks, bundle_bits, channels, container, cross_colour, predicted, words
from inkgauge.llm.webp_write import lengths_of, number, put_code


def symbols_of(argb: list[int], width: int, cache_bits: int, matches: bool) -> list[tuple]:
    """Literals, ("copy", length, distance code) and ("cache", index)."""
    out, i, seen = [], 0, {}
    cache, stored = [None] * (1 << cache_bits), 0
    while i < len(argb):
        if matches and i and (j := seen.get(tuple(argb[i : i + 3]))) is not None and i + 3 <= len(argb):
            n = 0
            while i + n < len(argb) and argb[i + n] == argb[j + n] and n < 4096:
                n += 1
            back = i - j
            near = [k + 1 for k, (x, y) in enumerate(webp.DISTANCES) if max(1, x + y * width) == back]
            out.append(("copy", n, near[0] if near else back + len(webp.DISTANCES)))
            for k in range(i, i + n):
                seen[tuple(argb[k : k + 3])] = k
            i += n
            continue
        if cache_bits:
            while stored < i:
                cache[(argb[stored] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[stored]
                stored += 1
            at = (argb[i] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)
            if cache[at] == argb[i]:
                out.append(("cache", at))
                seen[tuple(argb[i : i + 3])] = i
                i += 1
                continue
        out.append(("pixel", argb[i]))
        seen[tuple(argb[i : i + 3])] = i
        i += 1
    return out


def put_pixels(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, matches: bool = False, group_bits: int = 0) -> None:
    argb = [int(v) for v in argb]
    height = len(argb) // width
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = None
    if main:
        w.put(int(group_bits > 0), 1)
        if group_bits:
            w.put(group_bits - 2, 3)
            wide, high = blocks(width, group_bits), blocks(height, group_bits)
            groups = np.arange(wide * high) % 3
            put_pixels(w, (groups << 8).astype(np.uint32), wide, False)
    found = symbols_of(argb, width, cache_bits, matches)
    at, stats = 0, {}
    placed = []
    for s in found:
        g = 0 if groups is None else int(groups[(at // width >> group_bits) * blocks(width, group_bits) + (at % width >> group_bits)])
        placed.append((g, s))
        c = stats.setdefault(g, [Counter() for _ in range(5)])
        if s[0] == "pixel":
            v = s[1]
            for k, x in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                c[k][x] += 1
            at += 1
        elif s[0] == "cache":
            c[0][256 + 24 + s[1]] += 1
            at += 1
        else:
            c[0][256 + number(s[1])[0]] += 1
            c[4][number(s[2])[0]] += 1
            at += s[1]
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    n = 1 if groups is None else int(groups.max()) + 1
    codes = [[put_code(w, lengths_of(stats.get(g, [Counter()] * 5)[k], sizes[k])) for k in range(5)] for g in range(n)]
    for g, s in placed:
        c = codes[g]
        if s[0] == "pixel":
            v = s[1]
            for k, x in enumerate((v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24)):
                w.put(*c[k][x])
        elif s[0] == "cache":
            w.put(*c[0][256 + 24 + s[1]])
        else:
            for k, base, value in ((0, 256, s[1]), (4, 0, s[2])):
                prefix, bits, extra = number(value)
                w.put(*c[k][base + prefix])
                w.put(extra, bits)


def subtract_predictions(argb: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c = channels(argb)
    out = c.copy()
    for y in range(height):
        for x in range(width):
            k = y * width + x
            if k == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0:
                p = c[k - 1]
            elif x == 0:
                p = c[k - width]
            else:
                mode = int(modes[(y >> bits) * blocks(width, bits) + (x >> bits)]) >> 8 & 15
                p = predicted(mode, c[k - 1], c[k - width], c[k - width + 1], c[k - width - 1])
            out[k] = c[k] - p & 255
    return words(out)


def encode(rgba: np.ndarray, transforms: str = "", seed: int = 0, **options) -> bytes:
    """transforms: any of p(redictor), c(ross-colour), g(reen), i(ndexed palette), each at most once, in order."""
    rng = np.random.default_rng(seed)
    height, width = rgba.shape[:2]
    r, g, b, a = (rgba[..., k].reshape(-1).astype(np.uint32) for k in range(4))
    argb = a << 24 | r << 16 | g << 8 | b
    w = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)
    now = width
    for t in transforms:
        w.put(1, 1)
        w.put("pcgi".index(t), 2)
        if t in "pc":
            bits = 2
            w.put(bits - 2, 3)
            wide, high = blocks(now, bits), blocks(height, bits)
            if t == "p":
                image = (np.arange(wide * high) % 14 << 8).astype(np.uint32)
                argb = subtract_predictions(argb, now, height, image, bits)
            else:
                image = rng.integers(0, 1 << 24, wide * high).astype(np.uint32)
                argb = cross_colour(argb, now, height, image, bits, -1)
            put_pixels(w, image, wide, False)
        elif t == "g":
            argb = add_green(argb, -1)
        else:
            palette, index = np.unique(argb, return_inverse=True)
            w.put(len(palette) - 1, 8)
            steps = channels(palette)
            steps[1:] = steps[1:] - channels(palette)[:-1]
            put_pixels(w, words(steps), len(palette), False)
            bits = bundle_bits(len(palette))
            wide, each = blocks(now, bits), 8 >> bits
            packed = np.zeros((height, wide), np.uint32)
            for x in range(now):
                packed[:, x >> bits] |= index.reshape(height, now)[:, x].astype(np.uint32) << np.uint32((x & (1 << bits) - 1) * each)
            argb, now = (packed << 8 | 0xFF000000).reshape(-1).astype(np.uint32), wide
    w.put(0, 1)
    put_pixels(w, argb, now, True, **options)
    return container(w.done())

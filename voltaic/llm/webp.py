"""Lossless WebP as a store for bytes: images are written and read in batches, all images of a batch in step.

Every image of a batch is one lane. The decoder keeps one bit position a lane and lets numpy take the next
prefix code, back-reference or colour-cache entry of every lane at once, so Python's cost is paid for each
step of the longest image and not for each pixel. The transforms are then inverted for all lanes together.

A payload of 4 * 144 * h bytes becomes an RGBA image of width 144. Payloads over MAX_ROWS rows become several
WebP files, one after the other; each states its own length in its RIFF header.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_BYTES, WIDTH, MAX_ROWS = 576, 144, 448
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Longest prefix code that the encoder makes.
LIMIT = 11
_BATCH_BYTES = 2 << 20

# Fixed values of the format: the order of code length codes, and the (x, y) offsets of the 120 short distances.
CODE_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
_NEAR = np.array(NEAR)
CACHE_FACTOR = 0x1E35A7BD


def _reversal(bits: int) -> np.ndarray:
    """The numbers under 2 ** bits with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same for the next start."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


# ---------------------------------------------------------------- reading


class _Lanes:
    """Stored images, one bit position each, over a common buffer of 32-bit words."""

    def __init__(self, blobs: list[bytes]):
        sizes = np.array([len(b) for b in blobs], np.int64)
        room = (sizes + 3) // 4 * 4 + 8
        base = np.cumsum(room) - room
        buffer = bytearray(int(room.sum()) + 8)
        for at, blob in zip(base.tolist(), blobs, strict=True):
            buffer[at : at + len(blob)] = blob
        words = np.frombuffer(buffer, "<u4").astype(np.uint64)
        self.words = (words[:-1] | (words[1:] << np.uint64(32))).view(np.int64)
        self.pos, self.end = base * 8, (base + sizes) * 8
        self.bad = np.zeros(len(blobs), bool)

    def window(self, pos: np.ndarray) -> np.ndarray:
        """At least the 33 bits from each position on, as the low bits."""
        return self.words.take(pos >> 5, mode="clip") >> (pos & 31)

    def read(self, lanes: np.ndarray, bits) -> np.ndarray:
        pos = self.pos[lanes]
        self.pos[lanes] = pos + bits
        return self.window(pos) & ((1 << np.asarray(bits, np.int64)) - 1)


def _code_tables(lengths: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Lookup tables for rows of code lengths: flat table of symbol | length << 16, its bits a row, rows that are no code."""
    n = len(lengths)
    used = lengths > 0
    count = used.sum(1)
    bits = max(1, int(lengths.max(initial=0)))
    kraft = np.where(used, 1 << (bits - np.minimum(lengths, bits).astype(np.int64)), 0).sum(1)
    bad = (count > 1) & (kraft != 1 << bits)
    order = np.argsort(np.where(used, lengths, 255).astype(np.uint8), axis=1, kind="stable")
    ordered = np.take_along_axis(lengths, order, 1).astype(np.int64)
    share = np.where(ordered > 0, 1 << (bits - ordered), 0)
    entry = order | ordered << 16
    alone = (count <= 1) | bad
    share[alone] = 0
    share[alone, 0] = 1 << bits  # a code of one symbol takes no bits
    entry[alone, 0] = order[alone, 0] * (count[alone] > 0)
    table = np.repeat(entry.ravel(), share.ravel()).reshape(n, 1 << bits).astype(np.int32)
    return table[:, _reversal(bits)].ravel(), bits, bad


def _read_code_lengths(lanes: _Lanes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The next prefix code of each lane in at, as lengths of its symbols; size: of the lane's alphabet."""
    out = np.zeros((len(at), int(size.max())), np.uint8)
    simple = lanes.read(at, 1) == 1
    if simple.any():
        k = np.flatnonzero(simple)
        two, wide = lanes.read(at[k], 1), lanes.read(at[k], 1)
        first = lanes.read(at[k], np.where(wide == 1, 8, 1))
        out[k, np.minimum(first, out.shape[1] - 1)] = 1
        k2 = k[two == 1]
        out[k2, np.minimum(lanes.read(at[k2], 8), out.shape[1] - 1)] = 1
    k = np.flatnonzero(~simple)
    if not len(k):
        return out
    who = at[k]
    given = 4 + lanes.read(who, 4)
    meta = np.zeros((len(k), 19), np.uint8)
    for i in range(19):
        m = np.flatnonzero(given > i)
        meta[m, CODE_ORDER[i]] = lanes.read(who[m], 3)
    limit = size[k].copy()
    m = np.flatnonzero(lanes.read(who, 1) == 1)
    limit[m] = 2 + lanes.read(who[m], 2 + 2 * lanes.read(who[m], 3))
    table, bits, bad = _code_tables(meta)
    lanes.bad[who] |= bad
    fill, last = np.zeros(len(k), np.int64), np.full(len(k), 8, np.int64)
    left = np.arange(len(k))
    while len(left := left[(fill[left] < size[k[left]]) & (limit[left] > 0)]):
        limit[left] -= 1
        pos = lanes.pos[who[left]]
        window = lanes.window(pos)
        e = table[(left << bits) + (window & ((1 << bits) - 1))]
        symbol, used = e & 0xFFFF, e >> 16
        window = window >> used
        plain = symbol < 16
        p = left[plain]
        out[k[p], fill[p]] = symbol[plain]
        last[p] = np.where(symbol[plain] > 0, symbol[plain], last[p])
        extra = np.array([2, 3, 7])[np.maximum(symbol - 16, 0)]
        run = np.where(plain, 1, np.where(symbol == 18, 11, 3) + (window & ((1 << extra) - 1)))
        lanes.pos[who[left]] = pos + used + np.where(plain, 0, extra)
        again = np.flatnonzero(symbol == 16)
        if len(again):
            r = left[again]
            n = np.minimum(run[again], size[k[r]] - fill[r])
            out[np.repeat(k[r], n), _ranges(fill[r], n)] = np.repeat(last[r], n)
        fill[left] += run
    return out


def _number(lanes: _Lanes, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """A length or distance code: its prefix symbol, then extra bits."""
    extra = np.maximum(symbol - 2, 0) >> 1
    low = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << extra)
    return low + lanes.read(at, np.where(symbol < 4, 0, extra)) + 1


def _read_pixels(lanes: _Lanes, at: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray]:
    """The next entropy-coded image of each lane in at. main: it may be split among several groups of prefix codes."""
    n = len(at)
    if not n:
        return []
    cache_bits = np.zeros(n, np.int64)
    k = np.flatnonzero(lanes.read(at, 1) == 1)
    cache_bits[k] = lanes.read(at[k], 4)
    groups, meta, meta_bits = np.ones(n, np.int64), None, np.zeros(n, np.int64)
    if main and len(k := np.flatnonzero(lanes.read(at, 1) == 1)):
        meta_bits[k] = lanes.read(at[k], 3) + 2
        across, down = (width[k] + (1 << meta_bits[k]) - 1) >> meta_bits[k], (height[k] + (1 << meta_bits[k]) - 1) >> meta_bits[k]
        parts = _read_pixels(lanes, at[k], across, down, False)
        meta = [np.zeros(1, np.int64)] * n
        for i, part in zip(k.tolist(), parts, strict=True):
            meta[i] = (part.astype(np.int64) >> 8) & 0xFFFF
            groups[i] = meta[i].max() + 1
    base = np.cumsum(groups) - groups
    rows = int(groups.sum())
    sizes = [256 + 24 + np.where(cache_bits > 0, 1 << cache_bits, 0), *[np.full(n, x) for x in (256, 256, 256, 40)]]
    codes = [np.zeros((rows, int(s.max())), np.uint8) for s in sizes]
    for g in range(int(groups.max())):
        k = np.flatnonzero(groups > g)
        for code, size in zip(codes, sizes, strict=True):
            got = _read_code_lengths(lanes, at[k], size[k])
            code[base[k] + g, : got.shape[1]] = got
    out = [np.zeros(0, np.uint32)] * n
    # the tables of 15-bit codes are large, so few such lanes go together
    together = max(1, min(n, (2 << 20) >> int(max(c.max(initial=0) for c in codes))))
    for first in range(0, n, together):
        part = np.arange(first, min(n, first + together))
        lo, hi = base[part[0]], base[part[-1]] + groups[part[-1]]
        got = _read_tokens(lanes, at[part], width[part], height[part], cache_bits[part], [c[lo:hi] for c in codes], base[part] - lo, meta and [meta[i] for i in part], meta_bits[part])
        for i, pixels in zip(part.tolist(), got, strict=True):
            out[i] = pixels
    return out


def _read_tokens(lanes, at, width, height, cache_bits, codes, base, meta, meta_bits) -> list[np.ndarray]:
    built = [_code_tables(c) for c in codes]
    for i in range(len(at)):
        if any(b[2][base[i] : (base[i + 1] if i + 1 < len(at) else len(b[2]))].any() for b in built if b[2].any()):
            lanes.bad[at[i]] = True
    (tg, bg, _), (tr, br, _), (tb, bb, _), (ta, ba, _), (td, bd, _) = built
    mg, mr, mb, ma, md = ((1 << b) - 1 for b in (bg, br, bb, ba, bd))
    total = width * height
    start = np.cumsum(total) - total
    out = np.zeros(int(total.sum()), np.uint32)
    slots = 1 << cache_bits
    cached = bool(cache_bits.any())
    cache, cache_at = np.zeros(int(slots.sum()), np.uint32), np.cumsum(slots) - slots
    if meta is not None:
        meta_at = np.cumsum([len(m) for m in meta]) - [len(m) for m in meta]
        meta_flat, meta_across = np.concatenate(meta), (width + (1 << meta_bits) - 1) >> meta_bits
    left = np.flatnonzero(total > 0)
    x, pos, group = np.zeros(len(left), np.int64), lanes.pos[at[left]], base[left]
    size, lane_start = total[left], start[left]
    while len(left):
        if meta is not None:
            row, column = np.divmod(x, width[left])
            group = base[left] + meta_flat[meta_at[left] + (row >> meta_bits[left]) * meta_across[left] + (column >> meta_bits[left])]
        window = lanes.window(pos)
        e = tg.take((group << bg) + (window & mg))
        symbol, used = e & 0xFFFF, e >> 16
        window >>= used
        r = tr.take((group << br) + (window & mr))
        after = pos + used
        here = after + (r >> 16)
        window = lanes.window(here)
        b = tb.take((group << bb) + (window & mb))
        window >>= b >> 16
        a = ta.take((group << ba) + (window & ma))
        pixel = ((a.astype(np.int64) & 0xFF) << 24) | ((r & 0xFF) << 16) | ((symbol & 0xFF) << 8) | (b & 0xFF)
        step = 1
        pos = here + (b >> 16) + (a >> 16)
        if symbol.max() >= 256:
            step = np.ones(len(left), np.int64)
            k = np.flatnonzero(symbol >= 280)
            if len(k):
                pos[k] = after[k]
                pixel[k] = cache[cache_at[left[k]] + np.minimum(symbol[k] - 280, slots[left[k]] - 1)]
            k = np.flatnonzero((symbol >= 256) & (symbol < 280))
            if len(k):
                who = at[left[k]]
                lanes.pos[who] = after[k]
                length = _number(lanes, who, symbol[k].astype(np.int64) - 256)
                d = td[(group[k] << bd) + (lanes.window(lanes.pos[who]) & md)]
                lanes.pos[who] += d >> 16
                code = _number(lanes, who, (d & 0xFFFF).astype(np.int64))
                near = _NEAR[np.clip(code, 1, 120) - 1]
                distance = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[left[k]]))
                pos[k] = lanes.pos[who]
                lanes.bad[who[distance > x[k]]] = True
                distance = np.clip(distance, 1, np.maximum(1, x[k]))
                length = np.minimum(length, size[k] - x[k])
                within = _ranges(np.zeros(len(k), np.int64), length)
                target = np.repeat(lane_start[k] + x[k], length)
                pixels = out[np.maximum(0, target - np.repeat(distance, length) + within % np.repeat(distance, length))]
                out[target + within] = pixels
                if cached:
                    bits = np.repeat(cache_bits[left[k]], length)
                    cache[np.repeat(cache_at[left[k]], length) + (((pixels.astype(np.int64) * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - bits))] = pixels
                pixel[k] = out[lane_start[k] + x[k]]
                step[k] = length
        out[lane_start + x] = pixel
        if cached:
            k = slice(None) if isinstance(step, int) else np.flatnonzero(symbol - 256 & 0xFFFF >= 24)
            cache[cache_at[left[k]] + (((pixel[k] * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits[left[k]]))] = pixel[k]
        x = x + step
        done = x >= size
        if done.any():
            lanes.pos[at[left[done]]] = pos[done]
            keep = ~done
            left, x, pos, group, size, lane_start = left[keep], x[keep], pos[keep], group[keep], size[keep], lane_start[keep]
        elif (pos > lanes.end[at[left]]).any():  # the bytes ran out
            gone = pos > lanes.end[at[left]] + 64
            lanes.bad[at[left[gone]]] = True
            keep = ~gone
            left, x, pos, group, size, lane_start = left[keep], x[keep], pos[keep], group[keep], size[keep], lane_start[keep]
    return np.split(out, np.cumsum(total)[:-1])


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) as blue, green, red, alpha."""
    return np.ascontiguousarray(pixels).view(np.uint8).reshape(*pixels.shape, 4)


def _predictions(mode: np.ndarray, left, top, top_right, top_left) -> np.ndarray:
    """(n, 4) predictions; every neighbour is (n, 4) of small integers."""
    average = lambda p, q: (p + q) >> 1
    out = np.zeros_like(left)
    out[:, 3] = 255
    for m in np.unique(mode):
        k = mode == m
        lf, t, tr, tl = left[k], top[k], top_right[k], top_left[k]
        if m == 11:
            closer = np.abs(t - tl).sum(1) < np.abs(lf - tl).sum(1)
            out[k] = np.where(closer[:, None], lf, t)
        elif 1 <= m <= 13:
            out[k] = {
                1: lambda: lf, 2: lambda: t, 3: lambda: tr, 4: lambda: tl,
                5: lambda: average(average(lf, tr), t), 6: lambda: average(lf, tl), 7: lambda: average(lf, t), 8: lambda: average(tl, t), 9: lambda: average(t, tr),
                10: lambda: average(average(lf, tl), average(t, tr)), 12: lambda: np.clip(lf + t - tl, 0, 255),
                13: lambda: np.clip(average(lf, t) + np.trunc((average(lf, t) - tl) / 2).astype(lf.dtype), 0, 255),
            }[int(m)]()
    return out


def _predict(pixels: list[np.ndarray], width, height, modes: list[np.ndarray], bits, undo: bool) -> list[np.ndarray]:
    """Add (undo) or subtract the predictions, one pixel of every image at a time."""
    total = width * height
    start = np.cumsum(total) - total
    flat = _channels(np.concatenate(pixels)).astype(np.int16)
    seen = flat if undo else flat.copy()
    across = (width + (1 << bits) - 1) >> bits
    mode_at = np.cumsum([len(m) for m in modes]) - [len(m) for m in modes]
    mode_flat = (np.concatenate(modes).astype(np.int64) >> 8) & 15
    for x in range(int(total.max(initial=0))):
        k = np.flatnonzero(total > x)
        row, column = np.divmod(x, width[k])
        i, w = start[k] + x, width[k]
        mode = mode_flat[mode_at[k] + (row >> bits[k]) * across[k] + (column >> bits[k])]
        mode = np.where(row == 0, np.where(column == 0, 0, 1), np.where(column == 0, 2, mode))
        at = lambda back: seen[np.maximum(i - back, 0)]
        guess = _predictions(mode, at(1), at(w), at(w - 1), at(w + 1))
        flat[i] = (flat[i] + guess if undo else flat[i] - guess) & 0xFF
    return np.split(flat.astype(np.uint8).view(np.uint32).ravel(), np.cumsum(total)[:-1])


def _cross(pixels: list[np.ndarray], width, height, elements: list[np.ndarray], bits, undo: bool) -> list[np.ndarray]:
    total = width * height
    flat = _channels(np.concatenate(pixels)).astype(np.int32)
    within = _ranges(np.zeros(len(total), np.int64), total)
    row, column = np.divmod(within, np.repeat(width, total))
    b, across = np.repeat(bits, total), np.repeat((width + (1 << bits) - 1) >> bits, total)
    at = np.repeat(np.cumsum([len(e) for e in elements]) - [len(e) for e in elements], total)
    element = _channels(np.concatenate(elements))[at + (row >> b) * across + (column >> b)].view(np.int8).astype(np.int32)
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int32)
    blue, green, red = flat[:, 0], flat[:, 1], flat[:, 2]
    sign = 1 if undo else -1
    new_red = (red + sign * ((element[:, 0] * signed(green)) >> 5)) & 0xFF
    true_red = new_red if undo else red
    flat[:, 0] = (blue + sign * (((element[:, 1] * signed(green)) >> 5) + ((element[:, 2] * signed(true_red)) >> 5))) & 0xFF
    flat[:, 2] = new_red
    return np.split(flat.astype(np.uint8).view(np.uint32).ravel(), np.cumsum(total)[:-1])


def _packing(colours: np.ndarray) -> np.ndarray:
    """log2 of the palette indexes in one stored pixel."""
    return np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0)


def decode(blobs: list[bytes]) -> list[tuple[int, int, np.ndarray] | None]:
    """(width, height, ARGB pixels as 32-bit numbers) of each lossless WebP file; None for what is none."""
    n = len(blobs)
    heads = [b[:4] == b"RIFF" and b[8:16] == b"WEBPVP8L" and b[20:21] == b"\x2f" for b in blobs]
    lanes = _Lanes([b if ok else bytes(32) for b, ok in zip(blobs, heads, strict=True)])
    everyone = np.flatnonzero(heads)
    lanes.bad[~np.array(heads, bool)] = True
    lanes.pos += 21 * 8
    width, height = np.ones(n, np.int64), np.ones(n, np.int64)
    width[everyone], height[everyone] = lanes.read(everyone, 14) + 1, lanes.read(everyone, 14) + 1
    opaque = np.ones(n, bool)
    opaque[everyone] = lanes.read(everyone, 1) == 0
    lanes.bad[everyone] |= lanes.read(everyone, 3) != 0
    stored = width.copy()  # of the image as it is coded; palettes pack several pixels in one
    undo: list[list] = [[] for _ in range(n)]
    left = everyone
    while len(left := left[lanes.read(left, 1) == 1]):
        kind = lanes.read(left, 2)
        for k in (PREDICTOR, CROSS_COLOUR):
            if len(who := left[kind == k]):
                bits = lanes.read(who, 3) + 2
                side = (1 << bits) - 1
                for i, b, part in zip(who.tolist(), bits.tolist(), _read_pixels(lanes, who, (stored[who] + side) >> bits, (height[who] + side) >> bits, False), strict=True):
                    undo[i].append((k, int(stored[i]), b, part))
        for i in left[kind == SUBTRACT_GREEN].tolist():
            undo[i].append((SUBTRACT_GREEN, int(stored[i]), 0, None))
        if len(who := left[kind == PALETTE]):
            colours = lanes.read(who, 8) + 1
            for i, c, part in zip(who.tolist(), _packing(colours).tolist(), _read_pixels(lanes, who, colours, np.ones(len(who), np.int64), False), strict=True):
                undo[i].append((PALETTE, int(stored[i]), c, np.cumsum(_channels(part), axis=0, dtype=np.uint8).view(np.uint32).ravel()))
                stored[i] = (stored[i] + (1 << c) - 1) >> c
        many = [i for i in left.tolist() if len(undo[i]) > 4]
        lanes.bad[many] = True
        left = np.array([i for i in left.tolist() if len(undo[i]) <= 4], np.int64)
    pixels: list = [None] * n
    for i, part in zip(everyone.tolist(), _read_pixels(lanes, everyone, stored[everyone], height[everyone], True), strict=True):
        pixels[i] = part
    while any(undo):
        for k in (PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE):
            who = [i for i in range(n) if undo[i] and undo[i][-1][0] == k]
            if not who:
                continue
            steps = [undo[i].pop() for i in who]
            w, bits, h = np.array([s[1] for s in steps]), np.array([s[2] for s in steps]), height[who]
            if k == SUBTRACT_GREEN:
                got = []
                for i in who:
                    c = _channels(pixels[i]).copy()
                    c[:, 0] += c[:, 1]
                    c[:, 2] += c[:, 1]
                    got.append(c.view(np.uint32).ravel())
            elif k == PALETTE:
                got = []
                for i, (_, full, packed, colours) in zip(who, steps, strict=True):
                    green = _channels(pixels[i])[:, 1].reshape(int(height[i]), -1)
                    size = 8 >> packed
                    index = (green[:, :, None] >> (np.arange(1 << packed) * size).astype(np.uint8)) & np.uint8((1 << size) - 1)
                    index = index.reshape(int(height[i]), -1)[:, :full].ravel()
                    got.append(np.append(colours, np.zeros(256 - len(colours), np.uint32))[index])
            else:
                got = (_predict if k == PREDICTOR else _cross)([pixels[i] for i in who], w, h, [s[3] for s in steps], bits, True)
            for i, part in zip(who, got, strict=True):
                pixels[i] = part
    lanes.bad |= lanes.pos > lanes.end
    for i in np.flatnonzero(opaque):
        if pixels[i] is not None:
            pixels[i] = pixels[i] | np.uint32(0xFF000000)
    return [None if lanes.bad[i] else (int(width[i]), int(height[i]), pixels[i]) for i in range(n)]


# ---------------------------------------------------------------- writing


class _Writer:
    """Fields of bits, appended to many images at once."""

    def __init__(self, n: int):
        self.n, self.used, self.fields = n, np.zeros(n, np.int64), []

    def add(self, image: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """image ascends; several fields of one image are in order."""
        image, bits = np.asarray(image, np.int64), np.asarray(bits, np.int64)
        ends = np.cumsum(bits)
        before = ends - bits
        first = np.searchsorted(image, np.arange(self.n))
        starts = before[np.minimum(first, len(before) - 1)] if len(before) else np.zeros(self.n, np.int64)
        self.fields.append((image, before - starts[image] + self.used[image], np.asarray(value).astype(np.uint64), bits))
        self.used += np.bincount(image, bits, self.n).astype(np.int64)

    def same(self, value: int, bits: int) -> None:
        self.add(np.arange(self.n), np.full(self.n, value, np.uint64), np.full(self.n, bits))

    def files(self) -> list[bytes]:
        room = (self.used + 63) // 64 + 1
        base = np.cumsum(room) - room
        words = np.zeros(int(room.sum()) + 1, np.uint64)
        for image, offset, value, bits in self.fields:
            keep = bits > 0
            at = base[image[keep]] * 64 + offset[keep]
            word, shift, value = at >> 6, (at & 63).astype(np.uint64), value[keep]
            if not len(word):
                continue
            first = np.flatnonzero(np.diff(word, prepend=-1))
            words[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
            over = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
            words[word[first] + 1] |= np.bitwise_or.reduceat(over, first)
        raw = words.tobytes()
        out = []
        for at, used in zip((base * 8).tolist(), ((self.used + 7) // 8).tolist(), strict=True):
            data = raw[at : at + used]
            chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (used & 1)
            out.append(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
        return out


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Huffman code lengths for every row of counts, rows in step; none over limit."""
    counts = counts.astype(np.int64)
    n, size = counts.shape
    out = np.zeros((n, size), np.uint8)
    todo = np.flatnonzero((counts > 0).sum(1) > 1)
    out[(counts > 0) & ((counts > 0).sum(1) == 1)[:, None]] = 1
    while len(todo):
        c = counts[todo]
        far = np.int64(1) << 60
        order = np.argsort(np.where(c > 0, c, far), axis=1, kind="stable")
        leaf = np.concatenate([np.take_along_axis(np.where(c > 0, c, far), order, 1), np.full((len(todo), 2), far)], 1)
        symbols = (c > 0).sum(1)
        most = int(symbols.max())
        inner = np.full((len(todo), most + 2), far)
        above_leaf, above_inner = np.zeros((len(todo), most + 2), np.int64), np.zeros((len(todo), most + 2), np.int64)
        next_leaf, next_inner, r = np.zeros(len(todo), np.int64), np.zeros(len(todo), np.int64), np.arange(len(todo))
        for step in range(most - 1):
            on = symbols - 1 > step
            weight = np.zeros(len(todo), np.int64)
            for _ in range(2):
                a, b = leaf[r, next_leaf], inner[r, next_inner]
                from_leaf = a <= b
                weight += np.minimum(a, b)
                k = r[from_leaf & on]
                above_leaf[k, next_leaf[k]] = step
                next_leaf[k] += 1
                k = r[~from_leaf & on]
                above_inner[k, next_inner[k]] = step
                next_inner[k] += 1
            inner[on, step] = weight[on]
        depth = np.zeros((len(todo), most + 2), np.int64)
        for step in range(most - 3, -1, -1):
            k = symbols - 2 > step
            depth[k, step] = depth[r[k], above_inner[k, step]] + 1
        leaf_depth = np.take_along_axis(depth, above_leaf[:, :most], 1) + 1
        leaf_depth[np.arange(most)[None, :] >= symbols[:, None]] = 0
        got = np.zeros((len(todo), size), np.uint8)
        np.put_along_axis(got, order[:, :most], np.minimum(leaf_depth, 255).astype(np.uint8), 1)
        out[todo] = got
        todo = todo[got.max(1) > limit]
        counts[todo] = (counts[todo] + 1) >> 1
    return out


def _codes(lengths: np.ndarray, limit: int) -> np.ndarray:
    """The canonical codes of rows of lengths, their bits reversed as the format stores them."""
    order = np.argsort(np.where(lengths > 0, lengths, 255).astype(np.uint8), axis=1, kind="stable")
    ordered = np.take_along_axis(lengths, order, 1).astype(np.int64)
    share = np.where(ordered > 0, 1 << (limit - ordered), 0)
    code = np.cumsum(share, 1) - share
    out = np.zeros(lengths.shape, np.int64)
    np.put_along_axis(out, order, _reversal(limit)[np.minimum(code, (1 << limit) - 1)], 1)
    return out


#: The encoder's one code for code lengths: lengths 5 to 8, zero and short zero runs are frequent.
_META = np.zeros(19, np.uint8)
_META[[17, 0, 5, 6, 7, 8]] = 3
_META[[18, 1, 2, 3, 4, 9, 10, 11]] = 5
_META_CODES = _codes(_META[None], 5)[0]
_META_HEAD = sum(int(_META[s]) << (5 + 3 * i) for i, s in enumerate(CODE_ORDER[:15])) | (15 - 4) << 1


def _add_code(out: _Writer, lengths: np.ndarray, who: np.ndarray) -> None:
    """Append the description of one prefix code to each image in who."""
    used = (lengths > 0).sum(1)
    simple = used <= 1
    out.add(who[simple], 1 | 1 << 2 | lengths[simple].argmax(1).astype(np.uint64) << np.uint64(3), np.full(simple.sum(), 11))
    rows = np.flatnonzero(~simple)
    if not len(rows):
        return
    size = lengths.shape[1]
    out.add(who[rows], np.full(len(rows), _META_HEAD, np.uint64), np.full(len(rows), 51))
    flat = lengths[rows].ravel()
    zero = flat == 0
    column = np.arange(len(flat)) % size
    begins = np.flatnonzero(zero & (np.r_[True, ~zero[:-1]] | (column == 0)))
    ends = np.flatnonzero(zero & (np.r_[~zero[1:], True] | (column == size - 1)))
    run = ends - begins + 1
    full, rest = run // 138, run % 138
    many, few, single = rest >= 11, (rest >= 3) & (rest < 11), (rest > 0) & (rest < 3)
    last = begins + full * 138
    lit = np.flatnonzero(~zero)
    at = np.concatenate([lit, np.repeat(begins, full) + _ranges(np.zeros(len(full), np.int64), full) * 138, last[many], last[few], _ranges(last[single], rest[single])])
    symbol = np.concatenate([flat[lit].astype(np.int64), np.full(full.sum(), 18), np.full(many.sum(), 18), np.full(few.sum(), 17), np.zeros(rest[single].sum(), np.int64)])
    extra = np.concatenate([np.zeros(len(lit), np.int64), np.full(full.sum(), 127), rest[many] - 11, rest[few] - 3, np.zeros(rest[single].sum(), np.int64)])
    order = np.argsort(at, kind="stable")
    at, symbol, extra = at[order], symbol[order], extra[order]
    bits = _META[symbol].astype(np.int64)
    more = np.select([symbol == 18, symbol == 17], [7, 3], 0)
    out.add(who[rows[at // size]], _META_CODES[symbol] | extra << bits, bits + more)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number, of lengths or distance codes from 1 on."""
    v = value - 1
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 0)
    extra = np.where(v < 4, 0, high - 1)
    second = (v >> np.maximum(high - 1, 0)) & 1
    return np.where(v < 4, v, 2 * high + second), np.where(v < 4, 0, v - ((2 + second) << extra)), extra


def _add_image(out: _Writer, pixels: np.ndarray, image: np.ndarray, cache_bits: int, matches: bool, main: bool) -> None:
    """Append one entropy-coded image to every image of out; pixels lie one image after the other."""
    n, count = out.n, len(pixels)
    out.same(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        out.same(0, 1)
    place = np.arange(count)
    copy = np.zeros(count, np.int64)
    if matches and count > 3:
        # each pixel's distance to the last place where the same three pixels of the same image stood
        p = pixels.astype(np.uint64)
        key = (p * np.uint64(0x9E3779B97F4A7C15)) ^ (np.roll(p, -1) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (np.roll(p, -2) * np.uint64(0x165667B19E3779F9))
        key ^= image.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key, kind="stable")
        same = np.r_[False, key[order][1:] == key[order][:-1]]
        earlier = np.zeros(count, np.int64)
        earlier[order[same]] = order[np.flatnonzero(same) - 1]
        ok = np.zeros(count, bool)
        ok[order[same]] = True
        ok[-2:] = False
        for k in range(3):
            i, j = np.minimum(place + k, count - 1), np.minimum(earlier + k, count - 1)
            ok &= (pixels[i] == pixels[j]) & (image[i] == image) & (image[j] == image)
        distance = np.where(ok, place - earlier, 0)
        for back in (2, 1, 0):
            d = np.r_[np.zeros(back, np.int64), distance[: count - back]]
            copy = np.where((copy == 0) & (d > 0), d, copy)
    new = np.r_[True, (copy[1:] != copy[:-1]) | (image[1:] != image[:-1])]
    begin = np.flatnonzero(new)
    run = np.diff(np.append(begin, count))
    is_copy = (copy[begin] > 0) & (run >= 3)
    literal = np.repeat(~is_copy, run)
    begin, run = begin[is_copy], run[is_copy]
    pieces = -(-run // 4096)
    at = np.repeat(begin, pieces) + _ranges(np.zeros(len(run), np.int64), pieces) * 4096
    length = np.minimum(4096, np.repeat(begin + run, pieces) - at)
    c = _channels(pixels).astype(np.int64)
    green = c[:, 1].copy()
    if cache_bits:
        slot = ((pixels.astype(np.int64) * CACHE_FACTOR) & 0xFFFFFFFF) >> (32 - cache_bits)
        order = np.argsort(image * (1 << cache_bits) + slot, kind="stable")
        group = (image * (1 << cache_bits) + slot)[order]
        hit = np.zeros(count, bool)
        hit[order[1:]] = (group[1:] == group[:-1]) & (pixels[order[1:]] == pixels[order[:-1]])
        green[hit] = 280 + slot[hit]
    len_symbol, len_extra, len_bits = _prefix(length)
    dist_symbol, dist_extra, dist_bits = _prefix(copy[at] + 120)
    token = np.sort(np.concatenate([place[literal], at]))
    token_of = np.zeros(count, np.int64)
    token_of[token] = np.arange(len(token))
    who = image[token]
    symbol = green[token]
    t = token_of[at]
    symbol[t] = 256 + len_symbol
    width = 280 + (1 << cache_bits if cache_bits else 0)
    tally = lambda rows, value, size: np.bincount(rows * size + value, minlength=n * size).reshape(n, size)
    full = token[symbol < 256]
    lengths = [code_lengths(x) for x in (tally(who, symbol, width), tally(image[full], c[full, 2], 256), tally(image[full], c[full, 0], 256), tally(image[full], c[full, 3], 256), tally(image[at], dist_symbol, 40))]
    everyone = np.arange(n)
    for x in lengths:
        _add_code(out, x, everyone)
    lengths = [np.where(((x > 0).sum(1) <= 1)[:, None], 0, x) for x in lengths]  # a lone symbol takes no bits
    codes = [_codes(x, LIMIT) for x in lengths]
    value, bits = codes[0][who, symbol], lengths[0][who, symbol].astype(np.int64)
    k = np.flatnonzero(symbol < 256)
    for channel, kind in ((2, 1), (0, 2), (3, 3)):
        row, v = who[k], c[token[k], channel]
        value[k] |= codes[kind][row, v] << bits[k]
        bits[k] += lengths[kind][row, v]
    for v, b in ((len_extra, len_bits), (codes[4][image[at], dist_symbol], lengths[4][image[at], dist_symbol].astype(np.int64)), (dist_extra, dist_bits)):
        value[t] |= v << bits[t]
        bits[t] += b
    out.add(who, value, bits)


def encode(images: list[tuple[int, int, np.ndarray]], transforms: tuple = (), cache_bits: int = 0, matches: bool = True) -> list[bytes]:
    """Lossless WebP files of (width, height, ARGB pixels) images.

    transforms, in the order they are applied: ("predictor", mode), ("cross", red_to_blue, green_to_blue,
    green_to_red), ("green",) or ("palette",); palettes come alone and need at most 256 colours in each image.
    """
    n = len(images)
    if not n:
        return []
    out = _Writer(n)
    width, height = np.array([i[0] for i in images]), np.array([i[1] for i in images])
    if (np.maximum(width, height) > 1 << 14).any():
        raise ValueError("a side of a WebP image has 16384 pixels at most")
    pixels = [np.ascontiguousarray(i[2], np.uint32) for i in images]
    everyone = np.arange(n)
    out.add(everyone, (0x2F | (width - 1) << 8 | (height - 1) << 22).astype(np.uint64) | np.uint64(1 << 36), np.full(n, 40))
    bits = np.full(n, 9)
    side = ((width + 511) >> 9) * ((height + 511) >> 9)

    def constant(kind: int, pixel: int) -> list[np.ndarray]:
        """Append a transform whose data is one colour, which takes no bits a pixel."""
        out.same(1 | kind << 1 | (9 - 2) << 3, 6)
        out.same(0, 1)
        for shift in (8, 16, 0, 24):
            out.same(0b101 | ((pixel >> shift) & 0xFF) << 3, 11)
        out.same(0b0001, 4)
        return [np.full(s, pixel, np.uint32) for s in side.tolist()]

    for kind, *values in transforms:
        if kind == "predictor":
            pixels = _predict(pixels, width, height, constant(PREDICTOR, values[0] << 8), bits, False)
        elif kind == "cross":
            rb, gb, gr = (v & 0xFF for v in values)
            pixels = _cross(pixels, width, height, constant(CROSS_COLOUR, rb << 16 | gb << 8 | gr), bits, False)
        elif kind == "green":
            out.same(1 | SUBTRACT_GREEN << 1, 3)
            for i, p in enumerate(pixels):
                c = _channels(p).copy()
                c[:, 0] -= c[:, 1]
                c[:, 2] -= c[:, 1]
                pixels[i] = c.view(np.uint32).ravel()
        elif kind == "palette":
            tables, packed = [], []
            for i, p in enumerate(pixels):
                colours, index = np.unique(p, return_inverse=True)
                if len(colours) > 256:
                    raise ValueError("a palette has 256 colours at most")
                tables.append(np.diff(_channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8)).view(np.uint32).ravel())
                pack = int(_packing(np.array(len(colours))))
                w = (int(width[i]) + (1 << pack) - 1) >> pack
                grid = np.zeros((int(height[i]), w << pack), np.uint32)
                grid[:, : width[i]] = index.reshape(int(height[i]), -1)
                grid = (grid.reshape(int(height[i]), w, 1 << pack) << (np.arange(1 << pack, dtype=np.uint32) * (8 >> pack))).sum(2, dtype=np.uint32)
                packed.append((0xFF000000 | grid << np.uint32(8)).astype(np.uint32).ravel())
            size = np.array([len(t) for t in tables])
            out.add(everyone, 1 | PALETTE << 1 | (size - 1) << 3, np.full(n, 11))
            _add_image(out, np.concatenate(tables), np.repeat(everyone, size), 0, False, False)
            pixels = packed
        else:
            raise ValueError(f"unknown transform {kind}")
    out.same(0, 1)
    _add_image(out, np.concatenate(pixels), np.repeat(everyone, [len(p) for p in pixels]), cache_bits, matches, True)
    return out.files()


# ---------------------------------------------------------------- on DataFrames


def _strips(payload: bytes) -> list[tuple[int, int, np.ndarray]]:
    raw = np.frombuffer(payload, np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]  # R, G, B, A to the order in memory
    pixels = np.ascontiguousarray(raw).view(np.uint32).ravel()
    most = MAX_ROWS * WIDTH
    return [(WIDTH, len(p) // WIDTH, p) for p in (pixels[i : i + most] for i in range(0, len(pixels), most))]


def _settings(images: list) -> list[tuple]:
    """The encoder's choice for each image: a palette where there are few colours, a colour cache where it pays."""
    out = []
    for _, _, p in images:
        few = len(p) <= 288 and len(np.unique(p)) <= 16
        out.append(((("palette",),) if few else (), 0 if few or len(p) < 1024 else 7))
    return out


#: Multipliers of green that are tried for red and blue, in 32nds.
_ELEMENTS = (-16, -8, 8, 16)
#: Pixels up to which a predictor is tried: predictions are undone one pixel of every image at a time.
_PREDICT_UP_TO = 4096
_PREDICTORS = {1: 1, 2: WIDTH}  # mode: how far back its neighbour stands


def _alternatives(images: list) -> list[tuple]:
    """Of each image the predictor, cross-colour or green transform that its histograms speak for; () if none does.

    The bits of a channel are estimated as its entropy; matches are not foreseen, so whoever asks compares stored sizes.
    """
    n, count = len(images), np.array([len(p) for _, _, p in images])
    c = _channels(np.concatenate([p for _, _, p in images])).astype(np.int16)
    owner, within = np.repeat(np.arange(n), count) * 256, _ranges(np.zeros(n, np.int64), count)
    green = c[:, 1].astype(np.uint8).view(np.int8).astype(np.int16)
    own = np.append(np.arange(256.0), 0)
    own[1:256] = np.arange(1.0, 256) * np.log2(np.arange(1.0, 256))

    def bits(values: np.ndarray) -> np.ndarray:
        h = np.bincount(owner + (values & 255), minlength=n * 256).reshape(n, 256)
        return count * np.log2(count) - np.where(h < 256, own[np.minimum(h, 255)], h * np.log2(np.maximum(h, 1))).sum(1)

    blue, _, red, _ = plain = [bits(c[:, k]) for k in range(4)]
    total = sum(plain)
    options: list[tuple[np.ndarray, object]] = [(total - red - blue + bits(c[:, 0] - c[:, 1]) + bits(c[:, 2] - c[:, 1]), (("green",),))]
    crossed = {e: [bits(c[:, k] - ((e * green) >> 5)) for k in (0, 2)] for e in _ELEMENTS}
    to_blue, to_red = (np.array([base, *(crossed[e][k] for e in _ELEMENTS)]) for k, base in ((0, blue), (1, red)))
    options.append((total - blue - red + to_blue.min(0) + to_red.min(0), None))
    for mode, back in _PREDICTORS.items():
        guess = np.where((within >= back)[:, None], np.roll(c, back, axis=0), 0)
        some = sum(bits(c[:, k] - guess[:, k]) for k in range(4))
        options.append((np.where(count <= _PREDICT_UP_TO, some, np.inf), (("predictor", mode),)))
    estimates = np.array([o[0] for o in options])
    best, elements = estimates.argmin(0), (0, *_ELEMENTS)
    out = []
    for i, k in enumerate(best.tolist()):
        if estimates[k, i] > 0.97 * total[i] - 200:
            out.append(())
        else:
            out.append(options[k][1] or (("cross", 0, elements[to_blue[:, i].argmin()], elements[to_red[:, i].argmin()]),))
    return out


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 576 bytes, as one or more WebP files; equal payloads, equal files.

    Where another transform may pay it is tried, and the smaller file kept.
    """
    images, owner = [], []
    for i, payload in enumerate(payloads):
        for strip in _strips(payload):
            images.append(strip)
            owner.append(i)
    files: list[bytes] = [b""] * len(images)
    settings = _settings(images)
    others = [(t, s[1]) if t and not s[0] else None for t, s in zip(_alternatives(images) if images else [], settings, strict=True)]
    for choice in (settings, others):
        for setting in sorted({s for s in choice if s}):
            who = [k for k, s in enumerate(choice) if s == setting]
            for k, file in zip(who, encode([images[k] for k in who], transforms=setting[0], cache_bits=setting[1]), strict=True):
                if not files[k] or len(file) < len(files[k]):
                    files[k] = file
    out = [b""] * len(payloads)
    for i, file in zip(owner, files, strict=True):
        out[i] += file
    return out


def decode_payloads(media: list[bytes]) -> list[tuple[bytes, int, int] | None]:
    """(samples in R, G, B, A order, width, height over all files) of each stored payload; None if it can't be read."""
    files, owner = [], []
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            size = 8 + int.from_bytes(m[at + 4 : at + 8], "little")
            files.append(bytes(m[at : at + size]))
            owner.append(i)
            at += max(size, 8)
    parts: list[list] = [[] for _ in media]
    for i, got in zip(owner, decode(files) if files else [], strict=True):
        parts[i].append(got)
    out: list = []
    for p in parts:
        if not p or any(x is None for x in p):
            out.append(None)
        else:
            out.append((b"".join(_channels(x[2])[:, [2, 1, 0, 3]].tobytes() for x in p), p[0][0], sum(x[1] for x in p)))
    return out


def _batches(values: list, size, most: int = _BATCH_BYTES) -> Iterator[list[int]]:
    """Indexes in order of size, in groups of bounded bytes: images of a batch are about as long as each other."""
    order = sorted(range(len(values)), key=lambda i: size(values[i]))
    group, total = [], 0
    for i in order:
        if group and total + size(values[i]) > most:
            yield group
            group, total = [], 0
        group.append(i)
        total += size(values[i])
    if group:
        yield group


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % ROW_BYTES if data else ROW_BYTES)


def store_payloads(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, padded with 255 to a positive multiple of 576, as lossless WebP.

    A null text is stored as the empty one; a null id stays null; each input row gives one row; no rows, no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for group in _batches(texts, len):
                media = encode_payloads([pad(texts[i]) for i in group])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(group)), pa.array([len(texts[i]) for i in group], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_payloads(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df (id, n_bytes, media) with pixels (binary, R G B A), width, height and feature; null where media is no lossless WebP.

    feature: width, height, distinct samples, their sum, and a digest of the 256-bin histogram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [m or b"" for m in batch.column(2).to_pylist()]
            for group in _batches(media, lambda m: 4 * len(m), 2 * _BATCH_BYTES):
                pixels, width, height, feature = ([None] * len(group) for _ in range(4))
                for i, got in enumerate(decode_payloads([media[i] for i in group])):
                    if got:
                        pixels[i], width[i], height[i] = got
                        bins = np.bincount(np.frombuffer(got[0], np.uint8), minlength=256)
                        feature[i] = f"{got[1]}x{got[2]};{np.count_nonzero(bins)};{int(bins @ np.arange(256))};{hashlib.sha256(bins.astype('<i8').tobytes()).hexdigest()[:16]}"
                own = batch.take(pa.array(group, pa.int64()))
                columns = [*(own.column(i) for i in range(3)), pa.array(pixels, pa.binary()), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(feature, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "media", "pixels", "width", "height", "feature"])

    kind = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return plain.mapInArrow(run, f"id {kind}, n_bytes long, media binary, pixels binary, width int, height int, feature string").withColumnRenamed("id", id_col)

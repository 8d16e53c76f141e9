"""WebP streams that the operator's encoder didn't write: transforms whose parameters vary by block, in sub-sampled images with
codes of their own, held against the format's definition written out pixel by pixel."""

import numpy as np
import pytest

from voltaic.llm import webp

#: The order in which lengths of the code length code are stored; fixed by the format.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n)]

    def symbol(self, value, n):
        self.bits += [(value >> i) & 1 for i in reversed(range(n))]

    def data(self):
        return bytes(sum(b << i for i, b in enumerate(self.bits[k : k + 8])) for k in range(0, len(self.bits), 8))


def even_code(out, alphabet):
    """All of the first 256 symbols with 8 bits."""
    out.put(0, 1)
    out.put(8, 4)
    for s in ORDER[:12]:
        out.put(1 if s in (0, 8) else 0, 3)
    out.put(0, 1)
    out.bits += [1] * 256 + [0] * (alphabet - 256)


def lone_code(out, symbol):
    out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(symbol, 8)


def pair_code(out, low, high):
    out.put(1, 1), out.put(1, 1), out.put(1, 1), out.put(low, 8), out.put(high, 8)


def image(out, pixels, main):
    """Literal pixels (n, 4) of alpha, red, green, blue; channels of one or two values get the short forms of codes."""
    out.put(0, 1)  # no colour cache
    if main:
        out.put(0, 1)  # one group of codes
    ways = []
    for channel in (2, 1, 3, 0):
        seen = sorted(set(pixels[:, channel].tolist()))
        if len(seen) == 1:
            lone_code(out, seen[0])
            ways.append(lambda v: None)
        elif len(seen) == 2:
            pair_code(out, *seen)
            ways.append(lambda v, s=seen: out.put(s.index(v), 1))
        else:
            even_code(out, 280 if channel == 2 else 256)
            ways.append(lambda v: out.symbol(v, 8))
    out.put(1, 1), out.put(0, 1), out.put(0, 1), out.put(0, 1)  # distances: never used
    for a, r, g, b in pixels.tolist():
        for way, v in zip(ways, (g, r, b, a), strict=True):
            way(v)


def file(w, h, transforms, residuals):
    out = Bits()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    for kind, *parameters in transforms:
        out.put(1, 1)
        out.put({"predictor": 0, "cross": 1, "green": 2}[kind], 2)
        if parameters:
            bits, blocks = parameters
            out.put(bits - 2, 3)
            image(out, blocks, False)
    out.put(0, 1)
    image(out, residuals, True)
    data = out.data()
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def average(a, b):
    return [(x + y) // 2 for x, y in zip(a, b, strict=True)]


def clamp(v):
    return max(0, min(255, v))


def predicted(mode, left, top, right, corner):
    """The prediction of a pixel inside, by the format's list of modes; right is the pixel above and to the right."""
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(average(left, top), corner, strict=True)]
    return {
        0: [255, 0, 0, 0],
        1: left,
        2: top,
        3: right,
        4: corner,
        5: average(average(left, right), top),
        6: average(left, corner),
        7: average(left, top),
        8: average(corner, top),
        9: average(top, right),
        10: average(average(left, corner), average(top, right)),
    }[mode]


def unpredict(pixels, w, h, bits, blocks):
    across = -(-w // (1 << bits))
    out = []
    for y in range(h):
        for x in range(w):
            at = y * w + x
            if not at:
                guess = [255, 0, 0, 0]
            elif not y:
                guess = out[at - 1]
            elif not x:
                guess = out[at - w]
            else:
                mode = int(blocks[(y >> bits) * across + (x >> bits), 2]) & 15
                right = out[at - w + 1]  # at the last column this is the first pixel of the row itself
                guess = predicted(mode, out[at - 1], out[at - w], right, out[at - w - 1])
            out.append([(v + g) & 255 for v, g in zip(pixels[at].tolist(), guess, strict=True)])
    return np.array(out)


def signed(v):
    return v - 256 if v > 127 else v


def uncross(pixels, w, h, bits, blocks):
    across = -(-w // (1 << bits))
    out = []
    for at, (a, r, g, b) in enumerate(pixels.tolist()):
        _, red_to_blue, green_to_blue, green_to_red = (signed(int(v)) for v in blocks[(at // w >> bits) * across + (at % w >> bits)])
        red = (r + (green_to_red * signed(g) >> 5)) & 255
        blue = (b + (green_to_blue * signed(g) >> 5) + (red_to_blue * signed(red) >> 5)) & 255
        out.append([a, red, g, blue])
    return np.array(out)


def blocks_of(rng, w, h, bits, green=None):
    n = -(-w // (1 << bits)) * -(-h // (1 << bits))
    out = np.zeros((n, 4), int)
    out[:, 0] = 255
    if green is None:
        out[:, 1:] = rng.integers(0, 256, (n, 3))
    else:
        out[:, 2] = rng.choice(green, n)
    return out


def decoded(w, h, data):
    (got_w, got_h, pixels), = webp.decode([data])
    assert (got_w, got_h) == (w, h)
    return np.ascontiguousarray(pixels).astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1].astype(int)  # blue first in memory


SIZES = [(1, 1), (1, 9), (9, 1), (2, 2), (7, 5), (37, 23), (64, 16)]


@pytest.mark.parametrize(("w", "h"), SIZES)
@pytest.mark.parametrize("bits", [2, 3, 5])
def test_predictor_modes_by_block(w, h, bits):
    rng = np.random.default_rng(w * 100 + h + bits)
    residuals = rng.integers(0, 256, (w * h, 4))
    blocks = blocks_of(rng, w, h, bits, range(14))
    assert (decoded(w, h, file(w, h, [("predictor", bits, blocks)], residuals)) == unpredict(residuals, w, h, bits, blocks)).all()


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor_mode_with_its_borders(mode):
    rng = np.random.default_rng(mode)
    w, h, bits = 13, 11, 2
    residuals = np.where(rng.random((w * h, 4)) < 0.5, rng.integers(-3, 4, (w * h, 4)) & 255, rng.integers(0, 256, (w * h, 4)))
    blocks = blocks_of(rng, w, h, bits, [mode])
    assert (decoded(w, h, file(w, h, [("predictor", bits, blocks)], residuals)) == unpredict(residuals, w, h, bits, blocks)).all()


@pytest.mark.parametrize(("w", "h"), SIZES)
@pytest.mark.parametrize("bits", [2, 4])
def test_cross_colour_by_block(w, h, bits):
    rng = np.random.default_rng(w * 10 + h + bits)
    residuals, blocks = rng.integers(0, 256, (w * h, 4)), blocks_of(rng, w, h, bits)
    assert (decoded(w, h, file(w, h, [("cross", bits, blocks)], residuals)) == uncross(residuals, w, h, bits, blocks)).all()


@pytest.mark.parametrize("modes", [[1, 13], [11], range(14)])
def test_transforms_together(modes):
    """Read last to first: what was stored last is undone first. Two modes take the short form of a code."""
    rng = np.random.default_rng(len(modes))
    w, h = 30, 21
    residuals, p, c = rng.integers(0, 256, (w * h, 4)), blocks_of(rng, w, h, 3, modes), blocks_of(rng, w, h, 2)
    green = unpredict(uncross(residuals, w, h, 2, c), w, h, 3, p)
    green[:, 1], green[:, 3] = (green[:, 1] + green[:, 2]) & 255, (green[:, 3] + green[:, 2]) & 255
    assert (decoded(w, h, file(w, h, [("green",), ("predictor", 3, p), ("cross", 2, c)], residuals)) == green).all()


def test_streams_of_a_batch_are_decoded_together():
    rng = np.random.default_rng(77)
    files, want = [], []
    for w, h in SIZES:
        residuals, blocks = rng.integers(0, 256, (w * h, 4)), blocks_of(rng, w, h, 2, range(14))
        files.append(file(w, h, [("predictor", 2, blocks)], residuals))
        want.append(unpredict(residuals, w, h, 2, blocks))
    for (w, h), (got_w, got_h, pixels), expected in zip(SIZES, webp.decode(files), want, strict=True):
        assert (got_w, got_h) == (w, h)
        assert (np.ascontiguousarray(pixels).astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1] == expected).all()

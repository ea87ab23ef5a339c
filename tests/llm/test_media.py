"""WebP: round trips, and streams with every kind of transform, made by hand."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weirflow.llm import webp
from weirflow.llm.media import described, padded, pixels, with_media

from .brute import EMPTY, odd_documents

RANDOM = random.Random(5)


class Writer:
    """Bits of a stream, the lowest first."""

    def __init__(self, width: int, height: int):
        self.bits: list[int] = []
        self.put(0x2F, 8)
        self.put(width - 1, 14)
        self.put(height - 1, 14)
        self.put(0, 4)

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> k & 1 for k in range(n)]

    def flat_code(self, size: int, used: int = 256) -> None:
        """A code of `used` symbols, a power of two, of equal lengths."""
        n = used.bit_length() - 1
        self.put(0, 1)
        # Code lengths are n or 0: a code of two symbols for them, one bit each.
        self.put(15, 4)
        for s in webp._LENGTH_ORDER:
            self.put(1 if s in (0, n) else 0, 3)
        self.put(0, 1)
        for s in range(size):
            self.put(1 if s < used else 0, 1)  # 0 comes before n

    def one_code(self, symbol: int) -> None:
        self.put(1, 1)
        self.put(0, 1)
        self.put(1, 1)
        self.put(symbol, 8)

    def symbol(self, s: int, n: int = 8) -> None:
        self.bits += [s >> k & 1 for k in reversed(range(n))]

    def literals(self, argb: np.ndarray, cache: int = 0) -> None:
        """A whole image of literals; the header's flags for a cache, and for the main image, come before."""
        self.flat_code(280 + (1 << cache if cache else 0))
        for _ in range(3):
            self.flat_code(256)
        self.one_code(0)
        for p in argb.ravel().tolist():
            for shift in (8, 16, 0, 24):
                self.symbol(p >> shift & 255)

    def file(self) -> bytes:
        data = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        data += b"\0" * (len(data) % 2)
        return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def image(height, width):
    return np.array([[RANDOM.getrandbits(32) for _ in range(width)] for _ in range(height)], np.uint32)


def plain(argb: np.ndarray, before=lambda w: None) -> bytes:
    w = Writer(argb.shape[1], argb.shape[0])
    before(w)
    w.put(0, 1)  # no more transforms
    w.put(0, 1)  # no cache
    w.put(0, 1)  # one group of codes
    w.literals(argb)
    return w.file()


def parts(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def joined(x) -> int:
    return (x[0] & 255) << 24 | (x[1] & 255) << 16 | (x[2] & 255) << 8 | x[3] & 255


def only(data: bytes) -> np.ndarray:
    (chunk,) = webp.chunks(data)
    return webp.decode_stream(chunk)


def test_literals():
    x = image(5, 7)
    assert (only(plain(x)) == x).all()
    (rgba,) = webp.decode(plain(x))
    assert rgba.shape == (5, 7, 4) and tuple(rgba[0, 0]) == (*parts(int(x[0, 0]))[1:], parts(int(x[0, 0]))[0])


def predicted(x: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    """The pixels that residuals stand for, one by one."""
    out = np.zeros_like(x)
    h, w = x.shape
    at = lambda r, c: parts(int(out[r, c]))
    mean = lambda a, b: tuple((p + q) // 2 for p, q in zip(a, b, strict=True))
    clamp = lambda v: max(0, min(255, v))
    for r in range(h):
        for c in range(w):
            if r == 0:
                guess = (255, 0, 0, 0) if c == 0 else at(0, c - 1)
            elif c == 0:
                guess = at(r - 1, 0)
            else:
                left, t, tl = at(r, c - 1), at(r - 1, c), at(r - 1, c - 1)
                tr = at(r - 1, c + 1) if c + 1 < w else at(r, 0)
                m = int(modes[r >> step, c >> step]) >> 8 & 15
                if m == 11:
                    guess4 = [a + b - d for a, b, d in zip(left, t, tl, strict=True)]
                    to_left = sum(abs(g - a) for g, a in zip(guess4, left, strict=True))
                    to_top = sum(abs(g - a) for g, a in zip(guess4, t, strict=True))
                    guess = left if to_left < to_top else t
                elif m == 12:
                    guess = tuple(clamp(a + b - d) for a, b, d in zip(left, t, tl, strict=True))
                elif m == 13:
                    guess = tuple(clamp(a + int((a - d) / 2)) for a, d in zip(mean(left, t), tl, strict=True))
                else:
                    guess = {
                        1: left, 2: t, 3: tr, 4: tl, 5: mean(mean(left, tr), t), 6: mean(left, tl), 7: mean(left, t), 8: mean(tl, t), 9: mean(t, tr), 10: mean(mean(left, tl), mean(t, tr)),
                    }.get(m, (255, 0, 0, 0))
            out[r, c] = joined([a + b for a, b in zip(parts(int(x[r, c])), guess, strict=True)])
    return out


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    x = image(6, 9)
    modes = np.array([[(mode if (r + c) % 2 == 0 else RANDOM.randrange(14)) << 8 for c in range(3)] for r in range(2)], np.uint32)

    def before(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(0, 3)  # blocks of 4
        w.put(0, 1)
        w.literals(modes)

    assert (only(plain(x, before)) == predicted(x, modes, 2)).all()


def test_cross_colour_and_subtract_green():
    x, elements = image(5, 6), image(2, 2)
    signed = lambda v: v - 256 if v > 127 else v

    def before(w):
        w.put(1, 1)
        w.put(2, 2)  # subtract green, undone last
        w.put(1, 1)
        w.put(1, 2)
        w.put(0, 3)
        w.put(0, 1)
        w.literals(elements)

    want = np.zeros_like(x)
    for r in range(5):
        for c in range(6):
            a, red, g, blue = parts(int(x[r, c]))
            _, red_to_blue, to_blue, to_red = parts(int(elements[r >> 2, c >> 2]))
            red = (red + (signed(to_red) * signed(g) >> 5)) & 255
            blue = (blue + (signed(to_blue) * signed(g) >> 5) + (signed(red_to_blue) * signed(red) >> 5)) & 255
            want[r, c] = joined((a, red + g, g, blue + g))
    assert (only(plain(x, before)) == want).all()


@pytest.mark.parametrize("colours", [2, 4, 16, 200])
def test_palette(colours):
    table = image(1, colours)
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    width, height, per = 11, 4, 1 << pack
    index = np.array([[RANDOM.randrange(colours) for _ in range(width)] for _ in range(height)])
    stored = np.zeros((height, -(-width // per)), np.uint32)
    for r in range(height):
        for c in range(width):
            stored[r, c // per] |= int(index[r, c]) << (8 >> pack) * (c % per) << 8
    steps = [joined([a - b for a, b in zip(parts(int(table[0, k])), parts(int(table[0, k - 1])) if k else (0, 0, 0, 0), strict=True)]) for k in range(colours)]
    w = Writer(width, height)
    w.put(1, 1)
    w.put(3, 2)
    w.put(colours - 1, 8)
    w.put(0, 1)
    w.literals(np.array([steps], np.uint32))
    w.put(0, 3)  # no more transforms, no cache, one group of codes
    w.literals(stored)
    assert (only(w.file()) == table[0][index]).all()


def test_back_references_and_colour_cache():
    first = [RANDOM.getrandbits(32) for _ in range(6)]
    w = Writer(6, 4)
    w.put(0, 1)
    w.put(1, 1)
    w.put(4, 4)  # 16 colours
    w.put(0, 1)
    # Codes: 512 symbols of which 296 are in use can't be flat, so each has a length of 8 or 10 bits.
    used = 280 + 16
    lengths = [8] * 216 + [9] * 80
    w.put(0, 1)
    w.put(15, 4)
    for s in webp._LENGTH_ORDER:
        w.put(1 if s in (8, 9) else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.put(n - 8, 1)
    for _ in range(3):
        w.flat_code(256)
    w.one_code(1)  # distances: symbol 1 is code 2, a pixel to the left
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths)):
        code <<= n - last
        codes[s] = (code, n)
        code, last = code + 1, n
    assert used == len(codes)
    for p in first:
        w.symbol(*codes[p >> 8 & 255])
        for shift in (16, 0, 24):
            w.symbol(p >> shift & 255)
    w.symbol(*codes[256 + 3])  # a length of 4
    slot = (first[2] * 0x1E35A7BD & 0xFFFFFFFF) >> 28
    w.symbol(*codes[280 + slot])
    w.symbol(*codes[256 + 4])  # a length of 5 or 6, by one more bit
    w.put(1, 1)
    w.symbol(*codes[280 + slot])
    w.symbol(*codes[256 + 4])
    w.put(1, 1)
    cached = next(p for p in reversed(first) if (p * 0x1E35A7BD & 0xFFFFFFFF) >> 28 == slot)
    want = [*first, *[first[-1]] * 4, cached, *[cached] * 6, cached, *[cached] * 6]
    assert only(w.file()).ravel().tolist() == want[:24]


def test_bad_files():
    good = plain(image(3, 3))
    for bad in (b"RIFX" + good[4:], good[:20] + b"\x2e" + good[21:], good[:40]):
        with pytest.raises((ValueError, IndexError)):
            only(bad)
    assert webp.decode(b"") == []


@pytest.mark.parametrize("text", ["", "a", " ", "ab" * 96, "x" * 193, "same line of some length, again\n" * 50, "é漢\U0001f600", "\x00\x01\xff" * 40])
def test_round_trip(text):
    data = padded(text.encode())
    assert len(data) % 192 == 0 and len(data) >= 192
    assert b"".join(x.tobytes() for x in webp.decode_samples(webp.encode(data))) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 4))
def test_any_bytes(data, times):
    data = padded(data * times)
    assert b"".join(x.tobytes() for x in webp.decode_samples(webp.encode(data))) == data


def transforms(data: bytes) -> list[int]:
    """The kind of the first transform of each image."""
    out = []
    for chunk in webp.chunks(data):
        bits = webp.Bits(chunk)
        bits.read(40)
        out.append(bits.read(2) if bits.read(1) else -1)
    return out


PREDICTOR, SUBTRACT_GREEN, PALETTE = 0, 2, 3
LINE = bytes(random.Random(8).choices(range(32, 127), k=192))


@pytest.mark.parametrize(
    "data,kind",
    [
        (b"", PALETTE),
        (b"a", PALETTE),
        (bytes(random.Random(6).choices(b"01", k=500)), PALETTE),
        (bytes(random.Random(6).choices(b"01234567", k=900)), PALETTE),
        (bytes(range(16)) * 60, PALETTE),
        (bytes(range(17)) * 60, PREDICTOR),  # steps of one from the left
        (bytes(k // 3 % 256 for k in range(20000)), PREDICTOR),
        (LINE * 40, PREDICTOR),  # each row is the one above
        (b"plain words of a text that says nothing twice, 1234567890", SUBTRACT_GREEN),
        (bytes(random.Random(7).choices(range(256), k=1000)), SUBTRACT_GREEN),
    ],
)
def test_files_have_the_transform_that_fits(data, kind):
    data = padded(data)
    stored = webp.encode(data)
    assert transforms(stored) == [kind]
    assert b"".join(x.tobytes() for x in webp.decode_samples(stored)) == data
    (rgba,) = webp.decode(stored)
    assert (rgba[..., :3] == np.frombuffer(data, np.uint8).reshape(-1, 192, 1)).all() and (rgba[..., 3] == 255).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 16), st.integers(1, 30), st.randoms(use_true_random=False))
def test_any_width(width, colours, height, r):
    used = r.sample(range(256), colours)
    data = bytes(r.choice(used) for _ in range(width * height))
    (got,) = webp.decode_samples(webp.encode_samples(data, width))
    assert got.shape == (height, width) and got.tobytes() == data


def test_residuals_are_undone():
    x = np.frombuffer(RANDOM.randbytes(60), np.uint8).reshape(5, 12)
    for mode in (1, 2):
        grey = webp.residuals(x, mode).astype(np.uint32) * 0x010101
        back = webp.unpredict(grey, np.full((1, 1), mode << 8, np.uint32), 9)
        assert (back >> 8 & 255 == x).all() and (back >> 24 == 255).all()


def test_long_payloads_are_several_images():
    data = padded(bytes(RANDOM.randbytes(192 * 9)) + b"tail")
    files = webp.encode(data, rows=4)
    assert len(webp.chunks(files)) == 3
    assert b"".join(x.tobytes() for x in webp.decode_samples(files)) == data


def test_skewed_counts_keep_to_the_limit():
    counts = [(1 << k, k) for k in range(30)]
    lengths = webp.code_lengths(counts)
    assert max(lengths.values()) <= webp.CODE_LIMIT and sum(2.0**-n for n in lengths.values()) == 1.0


def test_frames_of_odd_rows(spark):
    odd = odd_documents(spark)
    media = with_media(odd)
    got = described(media).collect()
    assert len(got) == 9
    by = {r.doc_id: r for r in got}
    assert by[2].media_sha256 == by[3].media_sha256 and by[1].media_sha256 == by[8].media_sha256 and by[3].n_bytes == 0
    shapes = pixels(media).where("doc_id = 2").collect()
    assert [(r.image, r.width, r.height, bytes(r.rgba)) for r in shapes] == [(0, 192, 1, b"\x20\x20\x20\xff" * 192)]
    assert described(with_media(spark.createDataFrame([], EMPTY))).count() == 0

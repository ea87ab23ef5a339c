"""Lossless WebP (VP8L): a decoder for whole streams, and an encoder for bytes as grey samples.

Decoding follows the published bitstream specification: prefix codes and meta prefix codes, back-references, colour
cache, and the predictor, cross-colour, subtract-green and palette transforms. Runs of literal pixels are decoded many at
a time: for each bit the length of a pixel that would begin there is looked up, and then the pixels' first bits are
followed from one to the next.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

WIDTH = 192
#: Rows of an image; longer payloads are several images, one file after another.
MOST_ROWS = 2048
CODE_LIMIT = 12

# Fixed values of the format: the order of code lengths' lengths, and the places (x, y) of the first 120 distances.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


class Bits:
    """Reads bits, the lowest of a byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the image ends too soon")
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


class Code:
    """A prefix code: for each value of the next `bits` bits, the symbol and its length. A code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        if not used:
            used = [(1, 0)]
        if len(used) == 1:
            self.bits, self.symbols, self.lengths = 0, np.array([used[0][1]], np.int32), np.zeros(1, np.uint8)
            return
        used.sort()
        self.bits = used[-1][0]
        if sum(1 << self.bits - n for n, _ in used) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        # In the order of the codes, symbols fill the table by the reversed bits of its index.
        n, s = np.array(used).T
        order = reversed_bits(self.bits)
        self.symbols, self.lengths = np.empty(1 << self.bits, np.int32), np.empty(1 << self.bits, np.uint8)
        self.symbols[order] = np.repeat(s, 1 << self.bits - n)
        self.lengths[order] = np.repeat(n, 1 << self.bits - n)

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        k = bits.read(self.bits)
        bits.at -= self.bits - int(self.lengths[k])
        return int(self.symbols[k])


def reversed_bits(n: int, _kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """The numbers below 2 ** n with their n bits in reverse."""
    if n not in _kept:
        i, out = np.arange(1 << n), np.zeros(1 << n, np.int64)
        for k in range(n):
            out |= (i >> k & 1) << (n - 1 - k)
        _kept[n] = out
    return _kept[n]


def read_code(bits: Bits, size: int, kept: dict) -> Code:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        lengths = [0] * max(size, 256)
        for s in symbols:
            lengths[s] = 1
        return Code(lengths)
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[_LENGTH_ORDER[k]] = bits.read(3)
    code = Code(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    table, width = list(zip(code.symbols.tolist(), code.lengths.tolist(), strict=True)), code.bits
    lengths: list[int] = []
    last = 8
    # The window is refilled from time to time; it outlasts any one symbol with its extra bits.
    window, have = 0, 0
    data, at = bits.data, bits.at
    while len(lengths) < size and left:
        left -= 1
        if have < 32:
            window, have = int.from_bytes(data[at >> 3 : (at >> 3) + 40], "little") >> (at & 7), 312
        s, n = table[window & (1 << width) - 1] if width else table[0]
        if s >= 16:
            more = (2, 3, 7)[s - 16]
            count = (3, 3, 11)[s - 16] + (window >> n & (1 << more) - 1)
            lengths += [last if s == 16 else 0] * count
            n += more
        else:
            lengths.append(s)
            last = s or last
        window >>= n
        have -= n
        at += n
    bits.at = at
    if len(lengths) > size:
        raise ValueError("more code lengths than symbols")
    key = tuple(lengths)
    if key not in kept:
        kept[key] = Code(lengths)
    return kept[key]


def read_codes(bits: Bits, cache: int, groups: int) -> list[list[Code]]:
    sizes, kept = (280 + (1 << cache if cache else 0), 256, 256, 256, 40), {}
    return [[read_code(bits, n, kept) for n in sizes] for _ in range(groups)]


def extended(bits: Bits, symbol: int) -> int:
    """The length or distance of a prefix symbol and its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


def away(distance: int, width: int) -> int:
    if distance > 120:
        return distance - 120
    x, y = _NEAR[distance - 1]
    return max(1, x + y * width)


def copy(out: np.ndarray, at: int, length: int, distance: int) -> None:
    if distance > at or at + length > len(out):
        raise ValueError("a back-reference leaves the image")
    if distance >= length:
        out[at : at + length] = out[at - distance : at - distance + length]
    else:
        out[at : at + length] = np.resize(out[at - distance : at], length)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB values of an entropy-coded image."""
    cache = bits.read(4) if bits.read(1) else 0
    meta, step, groups = None, 0, 1
    if main and bits.read(1):
        step = bits.read(3) + 2
        meta = read_pixels(bits, -(-width >> step), -(-height >> step), False) >> 8 & 0xFFFF
        groups = int(meta.max()) + 1
    codes = read_codes(bits, cache, groups)
    out = np.zeros(width * height, np.uint32)
    if groups == 1 and not cache:
        literal_runs(bits, codes[0], out, width)
    else:
        one_by_one(bits, codes, out, width, cache, meta, step)
    return out


def one_by_one(bits: Bits, codes: list[list[Code]], out: np.ndarray, width: int, cache: int, meta: np.ndarray | None, step: int) -> None:
    """Pixels with a colour cache or several groups of codes."""
    colours, put, at = [0] * (1 << cache if cache else 0), 0, 0
    across = -(-width >> step) if meta is not None else 0
    while at < len(out):
        group = codes[int(meta[(at // width >> step) * across + (at % width >> step)])] if meta is not None else codes[0]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = extended(bits, s - 256)
            copy(out, at, length, away(extended(bits, group[4].read(bits)), width))
            at += length
        else:
            while put < at:
                colours[(int(out[put]) * 0x1E35A7BD & 0xFFFFFFFF) >> 32 - cache] = int(out[put])
                put += 1
            out[at] = colours[s - 280]
            at += 1


def literal_runs(bits: Bits, group: list[Code], out: np.ndarray, width: int) -> None:
    """Pixels of one group of codes without a colour cache."""
    green, red, blue, alpha, distance = group
    if not any(c.bits for c in group[:4]) and int(green.symbols[0]) < 256:
        out[:] = int(alpha.symbols[0]) << 24 | int(red.symbols[0]) << 16 | int(green.symbols[0]) << 8 | int(blue.symbols[0])
        return
    base = bits.at & ~7
    data = np.frombuffer(bits.data, np.uint8, offset=min(base >> 3, len(bits.data)))
    padded = np.zeros(len(data) + 16, np.uint32)
    padded[: len(data)] = data
    n = len(data) + 8
    words = padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & 0x7FFF).astype(np.uint16).ravel()  # of 15 bits, for each bit
    total = len(window)
    here = np.arange(total, dtype=np.int32)
    lengths = lambda code, at: code.lengths[window[at] & ((1 << code.bits) - 1)]
    symbol = green.symbols[window & ((1 << green.bits) - 1)]
    step = here + lengths(green, here) if green.bits else here.copy()
    for c in (red, blue, alpha):
        if c.bits:
            step = np.minimum(step, total - 1)
            step = step + lengths(c, step)
    step = step.astype(np.int32)
    # No step from what is no literal, or over the end.
    stop = (symbol > 255) | (step >= total)
    step[stop] = here[stop]
    two = step[step]
    four = two[two]
    eight = four[four]
    view, count, at, p = memoryview(eight), len(out), 0, bits.at - base
    while at < count:
        if not stop[p]:
            chain, most = [p], (count - at + 7) // 8
            while len(chain) < most and (q := view[chain[-1]]) != chain[-1]:
                chain.append(q)
            c = np.array(chain, np.int32)
            c = np.stack([c, step[c]], axis=1).ravel()
            c = np.stack([c.reshape(-1, 2), two[c].reshape(-1, 2)], axis=1).ravel()
            c = np.stack([c.reshape(-1, 4), four[c].reshape(-1, 4)], axis=1).ravel()[: count - at]
            ends = np.flatnonzero(stop[c])
            if len(ends):
                c = c[: ends[0]]
            value = symbol[c].astype(np.uint32) << 8
            q = c + lengths(green, c) if green.bits else c
            for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
                value |= code.symbols[window[q] & ((1 << code.bits) - 1)].astype(np.uint32) << np.uint32(shift)
                if code.bits:
                    q = q + lengths(code, q)
            out[at : at + len(c)] = value
            at += len(c)
            p = int(step[c[-1]])
            continue
        if symbol[p] < 256 or symbol[p] >= 280:
            raise ValueError("the image ends too soon")
        bits.at = base + p
        s = green.read(bits)
        length = extended(bits, s - 256)
        copy(out, at, length, away(extended(bits, distance.read(bits)), width))
        at += length
        p = bits.at - base
    bits.at = base + p


def channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) integers: alpha, red, green, blue."""
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def packed(parts: np.ndarray) -> np.ndarray:
    p = (parts & 255).astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def unpredict(argb: np.ndarray, modes: np.ndarray, step: int) -> np.ndarray:
    """Add each pixel's prediction from those before it."""
    height, width = argb.shape
    rest, kinds = channels(argb), modes >> 8 & 15
    out = np.zeros((height, width, 4), np.int32)
    out[0, 0] = (rest[0, 0] + (255, 0, 0, 0)) & 255
    out[0, 1:] = rest[0, 1:]
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (rest[y, 0] + above[0]) & 255
        for block in range(-(-width >> step)):
            a, b = max(1, block << step), min(width, block + 1 << step)
            if a >= b:
                continue
            mode = int(kinds[y >> step, block])
            top, corner = above[a:b], above[a - 1 : b - 1]
            right = above[a + 1 : b + 1] if b < width else np.concatenate([above[a + 1 : b], row[:1]])
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):
                guess = {2: top, 3: right, 4: corner, 8: corner + top >> 1, 9: top + right >> 1}.get(mode, np.array([255, 0, 0, 0]))
                row[a:b] = (rest[y, a:b] + guess) & 255
            elif mode == 1:
                row[a:b] = (np.cumsum(rest[y, a:b], axis=0) + row[a - 1]) & 255
            else:
                left = row[a - 1]
                for k in range(b - a):
                    t, tl, tr = top[k], corner[k], right[k]
                    if mode == 5:
                        guess = (left + tr >> 1) + t >> 1
                    elif mode == 6:
                        guess = left + tl >> 1
                    elif mode == 7:
                        guess = left + t >> 1
                    elif mode == 10:
                        guess = (left + tl >> 1) + (t + tr >> 1) >> 1
                    elif mode == 11:
                        guess = left if np.abs(t - tl).sum() < np.abs(left - tl).sum() else t
                    elif mode == 12:
                        guess = np.clip(left + t - tl, 0, 255)
                    else:
                        mean = left + t >> 1
                        guess = np.clip(mean + ((mean - tl) / 2).astype(np.int32), 0, 255)
                    row[a + k] = left = (rest[y, a + k] + guess) & 255
    return packed(out)


def uncross(argb: np.ndarray, elements: np.ndarray, step: int) -> np.ndarray:
    height, width = argb.shape
    e = np.repeat(np.repeat(elements, 1 << step, axis=0)[:height], 1 << step, axis=1)[:, :width]
    byte = lambda x: (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    p = channels(argb)
    to_red, to_blue, red_to_blue, green = byte(e), byte(e >> 8), byte(e >> 16), byte(argb >> 8)
    p[..., 1] += to_red * green >> 5
    p[..., 3] += (to_blue * green >> 5) + (red_to_blue * byte(p[..., 1]) >> 5)
    return packed(p)


def unindex(argb: np.ndarray, table: np.ndarray, width: int, pack: int) -> np.ndarray:
    index = argb >> 8 & 255
    if pack:
        size = 8 >> pack
        index = (index[:, :, None] >> np.arange(0, 8, size, dtype=np.uint32)) & ((1 << size) - 1)
        index = index.reshape(len(argb), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(table)] = table
    return whole[index]


def ungreen(argb: np.ndarray) -> np.ndarray:
    green = argb >> 8 & 255
    return argb & 0xFF00FF00 | ((argb & 0x00FF00FF) + (green << 16 | green)) & 0x00FF00FF


def decode_stream(data: bytes) -> np.ndarray:
    """A VP8L chunk's pixels: (height, width) ARGB values."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, across = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind < 2:
            step = bits.read(3) + 2
            shape = -(-height >> step), -(-across >> step)
            block = read_pixels(bits, shape[1], shape[0], False).reshape(shape)
            undo.append(lambda x, f=(unpredict, uncross)[kind], b=block, s=step: f(x, b, s))
        elif kind == 2:
            undo.append(ungreen)
        else:
            size = bits.read(8) + 1
            table = packed(np.cumsum(channels(read_pixels(bits, size, 1, False)), axis=0))
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append(lambda x, t=table, w=across, p=pack: unindex(x, t, w, p))
            across = -(-across >> pack)
    out = read_pixels(bits, across, height, True).reshape(height, across)
    for f in reversed(undo):
        out = f(out)
    return out


def chunks(data: bytes) -> list[bytes]:
    """The VP8L chunks of WebP files that follow one another."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP":
            raise ValueError("not a WebP file")
        end, k = at + 8 + struct.unpack_from("<I", data, at + 4)[0], at + 12
        while k < end:
            size = struct.unpack_from("<I", data, k + 4)[0]
            if data[k : k + 4] == b"VP8L":
                out.append(data[k + 8 : k + 8 + size])
            k += 8 + size + size % 2
        at = end
    return out


def decode(data: bytes) -> list[np.ndarray]:
    """Each image as a (height, width, 4) array of bytes: red, green, blue, alpha."""
    return [channels(decode_stream(x)).astype(np.uint8)[..., [1, 2, 3, 0]] for x in chunks(data)]


def decode_samples(data: bytes) -> list[np.ndarray]:
    """The green samples, (height, width), of each image; of a grey image, its samples."""
    return [(decode_stream(x) >> 8 & 255).astype(np.uint8) for x in chunks(data)]


def code_lengths(counts: list[tuple[int, int]], limit: int = CODE_LIMIT) -> dict[int, int]:
    """Lengths, up to `limit`, of a prefix code for (count, symbol), of two symbols at least."""
    while True:
        heap = [(c, s, None) for c, s in counts]
        heapq.heapify(heap)
        new = 1 << 20
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            heapq.heapreplace(heap, (a[0] + b[0], new, (a, b)))
            new += 1
        out, todo = {}, [(heap[0], 0)]
        while todo:
            (_, s, pair), depth = todo.pop()
            if pair:
                todo += [(pair[0], depth + 1), (pair[1], depth + 1)]
            else:
                out[s] = depth
        if max(out.values()) <= limit:
            return out
        least = max(2, sum(c for c, _ in counts) >> limit - 2)
        counts = [(max(c, least) if c < least else c, s) for c, s in counts]
        if all(c == counts[0][0] for c, _ in counts):
            raise ValueError("too many symbols for the limit")


class Out:
    """Gathers bits, the lowest first."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def put_code(out: Out, lengths: dict[int, int], size: int) -> None:
    """Write a code. Of the code for lengths, all 16 symbols that are used have 4 bits."""
    if len(lengths) <= 1:
        s = next(iter(lengths), 0)
        if s < 256:
            out.put(1 | 4 * (s > 1), 3)
            out.put(s, 8 if s > 1 else 1)
            return
    out.put(0, 1)
    out.put(12, 4)
    for _ in range(16):
        out.put(4, 3)
    out.put(0, 1)
    rank = {s: k for k, s in enumerate(sorted(_LENGTH_ORDER[:16]))}
    flip = [0, 8, 4, 12, 2, 10, 6, 14, 1, 9, 5, 13, 3, 11, 7, 15]
    at = 0
    for s in [*sorted(lengths), size]:
        gap = s - at
        while gap:
            if gap < 3:
                out.put(flip[rank[0]], 4)
                gap -= 1
            elif gap < 11:
                out.put(flip[rank[17]] | gap - 3 << 4, 7)
                gap = 0
            else:
                n = min(gap, 138)
                out.put(flip[rank[18]] | n - 11 << 4, 11)
                gap -= n
        if s < size:
            out.put(flip[rank[lengths[s]]], 4)
        at = s + 1


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Each symbol's bits, in the order that they are written."""
    if len(lengths) <= 1:
        return dict.fromkeys(lengths, 0)
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return out


def prefix(value: int) -> tuple[int, int, int]:
    """Symbol, count of extra bits and their value, of a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + (value >> extra & 1), extra, value & (1 << extra) - 1


def repeats(data: bytes, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, distance) of lines that occurred before, and of the blanks at the end; apart and in order."""
    out: list[tuple[int, int, int]] = []
    seen: dict[bytes, int] = {}
    at = 0
    for line in data.split(b"\n"):
        if len(line) >= least:
            was = seen.get(line)
            if was is not None:
                if out and sum(out[-1][:2]) == at - 1 and out[-1][2] == at - was and out[-1][1] + len(line) < 4096 and data[at - 1 - out[-1][2]] == 10:
                    out[-1] = (out[-1][0], out[-1][1] + 1 + len(line), out[-1][2])
                else:
                    out += [(at + k, min(4096, len(line) - k), at - was) for k in range(0, len(line), 4096)]
            seen[line] = at
        at += len(line) + 1
    end = len(data.rstrip(b" ")) + 1
    if len(data) - end >= 8 and (not out or sum(out[-1][:2]) <= end):
        out += [(k, min(4096, len(data) - k), 1) for k in range(end, len(data), 4096)]
    return out


def runs(samples: np.ndarray, least: int = 16) -> list[tuple[int, int, int]]:
    """(start, length, 1) of runs of one value, but for their first; apart and in order."""
    edges = np.flatnonzero(samples[1:] != samples[:-1]) + 1
    starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(samples)]))
    long = ends - starts > least
    return [(k, min(4096, b - k), 1) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) for k in range(a + 1, b, 4096)]


def literals(samples: np.ndarray, matches: list[tuple[int, int, int]]) -> np.ndarray:
    """The samples that no match covers."""
    if not matches:
        return samples
    keep = np.ones(len(samples), bool)
    for start, length, _ in matches:
        keep[start : start + length] = False
    return samples[keep]


def cost(samples: np.ndarray) -> float:
    """Bits that an ideal code takes for the samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    counts = counts[counts > 0]
    return float((counts * np.log2(samples.size / counts)).sum())


def residuals(samples: np.ndarray, mode: int) -> np.ndarray:
    """What the pixel to the left (1) or above (2) leaves of (height, width) samples; the first row is predicted from the
    left, and the first column from above, in any mode."""
    out = samples.copy()
    out[0, 1:] -= samples[0, :-1]
    out[1:, 0] -= samples[:-1, 0]
    out[1:, 1:] -= samples[1:, :-1] if mode == 1 else samples[:-1, 1:]
    return out


def sized(counts: dict[int, int]) -> dict[int, int]:
    return code_lengths([(c, s) for s, c in counts.items()]) if len(counts) > 1 else dict.fromkeys(counts, 0)


def put_palette(out: Out, colours: list[int]) -> None:
    """The transform's table of grey values: a small image of steps from one to the next."""
    steps = [b - a for a, b in zip([0, *colours], colours, strict=False)]
    out.put(1 | 3 << 1 | len(colours) - 1 << 3, 11)
    out.put(0, 1)  # no colour cache
    grey, alpha = ({x: y.count(x) for x in y} for y in (steps, [255] + [0] * (len(steps) - 1)))
    greys, alphas = sized(grey), sized(alpha)
    for lengths, size in ((greys, 280), (greys, 256), (greys, 256), (alphas, 256), ({0: 0}, 40)):
        put_code(out, lengths, size)
    grey_codes, alpha_codes = canonical(greys), canonical(alphas)
    for k, x in enumerate(steps):
        for _ in range(3):
            out.put(grey_codes[x], greys[x])
        a = 0 if k else 255
        out.put(alpha_codes[a], alphas[a])


def put_predictor(out: Out, mode: int) -> None:
    """The transform with one mode for all blocks: an image of one colour, whose pixels take no bits."""
    out.put(1 | 0 << 1 | 7 << 3, 6)  # blocks of 512
    out.put(0, 1)  # no colour cache
    for symbol, size in ((mode, 280), (0, 256), (0, 256), (255, 256), (0, 40)):
        put_code(out, {symbol: 0}, size)


def encode_samples(data: bytes, width: int = WIDTH) -> bytes:
    """A WebP file of grey samples, `width` a row.

    Up to 16 different samples have a palette, of which several make a pixel. Others are coded as they are or, where that
    takes fewer bits, by what their neighbours leave of them. After subtracting green, only green is left to code. A colour
    cache or the cross-colour transform can't make grey samples smaller.
    """
    samples, height, out = np.frombuffer(data, np.uint8), len(data) // width, Out()
    out.put(0x2F | width - 1 << 8 | height - 1 << 22, 40)
    colours = np.flatnonzero(np.bincount(samples, minlength=256))
    alpha = 255
    if len(colours) <= 16:
        put_palette(out, colours.tolist())
        per = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2
        index = np.zeros((height, -(-width // per) * per), np.uint8)
        index[:, :width] = np.searchsorted(colours, samples).reshape(height, width)
        places = np.arange(per, dtype=np.uint8) * (8 // per)
        samples = (index.reshape(height, -1, per) << places).sum(axis=2, dtype=np.uint8).ravel()
        matches = runs(samples)
    else:
        matches = repeats(data)
        least, grid = cost(literals(samples, matches)), samples.reshape(height, width)
        mode = min((1, 2), key=lambda k: cost(residuals(grid, k)))
        if cost(residuals(grid, mode)) < least:
            put_predictor(out, mode)
            samples, alpha = residuals(grid, mode).ravel(), 0
            matches = runs(samples)
        out.put(1 | 2 << 1, 3)  # subtract green
    out.put(0, 3)  # no more transforms, no colour cache, one group of codes
    body = put_samples(out, samples, matches, alpha)
    pad = len(body) % 2
    return b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * pad


def put_samples(out: Out, samples: np.ndarray, matches: list[tuple[int, int, int]], alpha: int) -> bytes:
    """The stream: what is in `out`, codes, and the samples as an image whose alpha is the same everywhere."""
    codes = [(prefix(length), prefix(away + 120)) for _, length, away in matches]
    literal = literals(samples, matches)
    counts = np.bincount(literal, minlength=256).tolist()
    green = {s: c for s, c in enumerate(counts) if c}
    far: dict[int, int] = {}
    for (a, _, _), (b, _, _) in codes:
        green[256 + a] = green.get(256 + a, 0) + 1
        far[b] = far.get(b, 0) + 1
    green_lengths, far_lengths = sized(green), sized(far)
    green_codes, far_codes = canonical(green_lengths), canonical(far_lengths)
    put_code(out, green_lengths, 280)
    put_code(out, {0: 0}, 256)
    put_code(out, {0: 0}, 256)
    put_code(out, {alpha: 0}, 256)
    put_code(out, far_lengths, 40)
    bits_of, length_of = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, c in green_codes.items():
        if s < 256:
            bits_of[s], length_of[s] = c, green_lengths[s]
    values, sizes = bits_of[literal], length_of[literal]
    if matches:
        more, widths, places, gone = [], [], [], 0
        for (start, length, _), ((a, an, av), (b, bn, bv)) in zip(matches, codes, strict=True):
            # A reference is two entries, of at most 12 + 10 and 12 + 18 bits.
            more += [green_codes[256 + a] | av << green_lengths[256 + a], far_codes[b] | bv << far_lengths[b]]
            widths += [green_lengths[256 + a] + an, far_lengths[b] + bn]
            places += [start - gone] * 2
            gone += length
        values, sizes = np.insert(values, places, np.array(more, np.uint64)), np.insert(sizes, places, widths)
    ends = np.cumsum(sizes)
    starts = ends - sizes + out.size % 32
    head = out.value.to_bytes((out.size + 7) // 8, "little")
    whole = out.size // 32 * 4
    total = int(starts[-1] + sizes[-1]) if len(sizes) else out.size % 32
    word, shift = starts >> 5, (starts & 31).astype(np.uint64)
    shifted = values << shift
    # Bits of entries never overlap, so sums of them, exact in floats, join them.
    low = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(float), total // 32 + 2)
    high = np.bincount(word + 1, (shifted >> np.uint64(32)).astype(float), total // 32 + 3)[: len(low)]
    words = (low + high).astype(np.uint64).astype("<u4")
    rest = bytearray(words.tobytes())
    for k, c in enumerate(head[whole:]):
        rest[k] |= c
    return head[:whole] + bytes(rest[: (total + 7) // 8])


def encode(payload: bytes, width: int = WIDTH, rows: int = MOST_ROWS) -> bytes:
    """A payload of a positive multiple of `width` bytes as WebP files that follow one another."""
    return b"".join(encode_samples(payload[at : at + width * rows], width) for at in range(0, len(payload), width * rows))

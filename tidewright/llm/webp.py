"""Lossless WebP (VP8L) as a store for byte payloads and a decoder for images of this format.

The decoder reads the whole of the format: simple and normal prefix codes, meta prefix groups, back-references, the
colour cache, and the predictor, cross-colour, subtract-green and colour-indexing transforms. Streams of one prefix
group whose red, blue and alpha codes are single symbols (palette images) take a vectorised way: the code word at
*every* bit position is looked up at once with NumPy, and one tight loop follows the chain of lengths.

The encoder writes bytes one a pixel: as palette images, with Huffman literals and back-references for repeated lines, or,
where differences from the pixel before or above have clearly less entropy, with a predictor.
"""

from __future__ import annotations

import functools
import struct

import numpy as np

#: Fixed values of the format: order in which code length code lengths stand.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Fixed values of the format: (dx, dy) of the 120 short distance codes.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0),
    (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1),
    (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5),
    (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0),
    (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7),
    (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Predictors that the encoder writes.
LEFT, ABOVE = 1, 2
CACHE_MULTIPLIER = 0x1E35A7BD
MASK32 = 0xFFFFFFFF
#: Pixels of one picture written by :func:`store`: 64 wide and at most 16,384 high.
WIDTH, PICTURE = 64, 64 * 16384
LONGEST_CODE = 12


class BrokenImage(ValueError):
    """The bytes are no lossless WebP."""


# --- prefix codes ---------------------------------------------------------------------------------------------------


@functools.cache
def _mirrored(bits: int) -> np.ndarray:
    """0 .. 2**bits - 1, each with its bits in reverse order."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(bits):
        out = np.concatenate((out << 1, out << 1 | 1))
    return out


def _canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols in code order, windows of ``bits`` bits that each takes, bits)."""
    used = lengths.nonzero()[0]
    sizes = lengths[used]
    order = sizes.argsort(kind="stable")
    bits = int(sizes[order[-1]])
    return used[order], np.left_shift(1, bits - sizes[order].astype(np.int64)), bits


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words, bit-reversed as they stand in the stream."""
    out = np.zeros(len(lengths), dtype=np.uint32)
    if lengths.any():
        symbols, spans, bits = _canonical(lengths)
        out[symbols] = _mirrored(bits)[np.cumsum(spans) - spans]
    return out


def code_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, length) for every window of ``bits`` coming bits."""
    n = np.count_nonzero(lengths)
    if n == 0:
        raise BrokenImage("a prefix code without symbols")
    if n == 1:
        return lengths.nonzero()[0].astype(np.int32), np.zeros(1, dtype=np.uint8), 0
    symbols, spans, bits = _canonical(lengths)
    if spans.sum() != 1 << bits:
        raise BrokenImage("a prefix code that is not complete")
    symbol = np.repeat(symbols, spans).astype(np.int32)[_mirrored(bits)]
    return symbol, lengths[symbol], bits


def huffman_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Code lengths of a complete code; the counts are flattened until no code is longer than ``longest``."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    weights = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable")
        leaves, n = weights[order].tolist(), len(used)
        inner: list[int] = []
        parent = [0] * (2 * n - 1)
        a = b = 0
        for k in range(n - 1):
            total = 0
            for _ in range(2):
                if a < n and (b >= k or leaves[a] <= inner[b]):
                    total += leaves[a]
                    parent[a] = n + k
                    a += 1
                else:
                    total += inner[b]
                    parent[n + b] = n + k
                    b += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            out[used[order]] = depth[:n]
            return out
        weights = weights // 2 + 1


# --- reading --------------------------------------------------------------------------------------------------------


class Bits:
    """Little-endian bit reader."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data + b"\0" * 16, 0, len(data) * 8

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.size:
            raise BrokenImage("the data end too early")
        return value

    def symbol(self, code: tuple[np.ndarray, np.ndarray, int]) -> int:
        symbols, lengths, bits = code
        k = self.peek() & ((1 << bits) - 1)
        self.at += int(lengths[k])
        if self.at > self.size:
            raise BrokenImage("the data end too early")
        return int(symbols[k])

    def prefixed(self, prefix: int) -> int:
        """A length or distance from its prefix symbol."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


def _read_code(bits: Bits, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    lengths = np.zeros(size, dtype=np.uint8)
    if bits.read(1):
        second = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for s in (first, bits.read(8)) if second else (first,):
            if s >= size:
                raise BrokenImage("a symbol outside its alphabet")
            lengths[s] = 1
        return code_table(lengths)
    own = np.zeros(19, dtype=np.uint8)
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    table = code_table(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    k, before, wide = 0, 8, table[2]
    symbols, sizes = table[0].tolist(), table[1].tolist()
    coming = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2560], "little") >> (bits.at & 7)  # more than any code takes
    while k < size and left:
        left -= 1
        w = coming & ((1 << wide) - 1)
        s, n = symbols[w], sizes[w]
        coming >>= n
        bits.at += n
        if s < 16:
            lengths[k] = s
            before = s or before
            k += 1
            continue
        extra, least, value = (2, 3, before) if s == 16 else (3, 3, 0) if s == 17 else (7, 11, 0)
        n = least + (coming & ((1 << extra) - 1))
        coming >>= extra
        bits.at += extra
        if k + n > size:
            raise BrokenImage("code lengths run over their alphabet")
        lengths[k : k + n] = value
        k += n
    if bits.at > bits.size:
        raise BrokenImage("the data end too early")
    return code_table(lengths)


def _read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels (uint32) of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BrokenImage("a colour cache of over 11 bits")
    groups, block, of = 1, 0, None
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        image = _read_pixels(bits, across, -(-height >> block), False)
        of = (image >> 8) & 0xFFFF
        groups = int(of.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c[2] == 0 for c in codes[0][1:4]):
        return _read_palette_pixels(bits, width, width * height, codes[0])
    return _read_any_pixels(bits, width, height, codes, cache_bits, block, of)


def _copy_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _read_any_pixels(bits: Bits, width: int, height: int, codes: list, cache_bits: int, block: int, of) -> np.ndarray:  # noqa: ANN001
    out, total = [0] * (width * height), width * height
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    across = -(-width >> block) if block else 0
    group, at = codes[0], 0
    while at < total:
        if of is not None:
            group = codes[of[(at // width >> block) * across + (at % width >> block)]]
        s = bits.symbol(group[0])
        if s < 256:
            red, blue, alpha = (bits.symbol(c) for c in group[1:4])
            pixels = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = bits.prefixed(s - 256)
            back = _copy_distance(bits.prefixed(bits.symbol(group[4])), width)
            if back > at or at + n > total:
                raise BrokenImage("a back-reference outside the image")
            for k in range(at, at + n):
                out[k] = out[k - back]
            pixels = out[at : at + n]
        else:
            pixels = [cache[s - 280]]
        for p in pixels:
            out[at] = p
            at += 1
            if cache_bits:
                cache[(CACHE_MULTIPLIER * p & MASK32) >> shift] = p
    return np.array(out, dtype=np.uint32)


def _read_palette_pixels(bits: Bits, width: int, total: int, codes: list) -> np.ndarray:
    symbols, lengths, size = codes[0]
    rest = int(codes[3][0][0]) << 24 | int(codes[1][0][0]) << 16 | int(codes[2][0][0])
    if size == 0 and symbols[0] < 256:
        return np.full(total, rest | int(symbols[0]) << 8, dtype=np.uint32)
    first = bits.at >> 3
    raw = np.frombuffer(bits.data, dtype=np.uint8, offset=first).astype(np.uint32)
    raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    windows = np.empty((len(raw), 8), dtype=np.uint16)
    for k in range(8):
        windows[:, k] = (raw >> k) & ((1 << size) - 1)
    windows = windows.reshape(-1)
    step = lengths.copy()
    step[symbols >= 256] = 0  # the loop stops at them
    steps = step[windows].tobytes()
    p, at, out = bits.at - first * 8, 0, np.empty(total, dtype=np.uint8)
    if total > 64 and symbols.max() < 256:  # literals alone: two at a time
        single = step[windows]
        after = np.arange(len(windows), dtype=np.int32)
        after += single
        pair = (single + single.take(after, mode="clip")).tobytes()
        places = []
        put, half = places.append, total // 2
        try:
            for _ in range(half):
                put(p)
                p += pair[p]
        except IndexError:
            raise BrokenImage("the data end too early") from None
        firsts = np.array(places, dtype=np.int32)
        out[: 2 * half : 2] = symbols[windows[firsts]]
        out[1 : 2 * half : 2] = symbols[windows[after[firsts]]]
        at = 2 * half
    while at < total:
        places: list[int] = []
        put, left = places.append, total - at
        try:
            while left:
                n = steps[p]
                if not n:
                    break
                put(p)
                p += n
                left -= 1
        except IndexError:
            raise BrokenImage("the data end too early") from None
        if places:
            out[at : at + len(places)] = symbols[windows[np.array(places)]]
            at += len(places)
        if at < total:
            bits.at = p + first * 8
            s = bits.symbol(codes[0])
            n = bits.prefixed(s - 256)
            back = _copy_distance(bits.prefixed(bits.symbol(codes[4])), width)
            if back > at or at + n > total:
                raise BrokenImage("a back-reference outside the image")
            if back >= n:
                out[at : at + n] = out[at - back : at - back + n]
            else:
                out[at : at + n] = np.resize(out[at - back : at], n)
            at += n
            p = bits.at - first * 8
    bits.at = p + first * 8
    if bits.at > bits.size:
        raise BrokenImage("the data end too early")
    return out.astype(np.uint32) << 8 | np.uint32(rest)


# --- transforms -----------------------------------------------------------------------------------------------------


def _channels(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4).astype(np.int32)  # blue, green, red, alpha


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels.astype(np.uint8)).view("<u4").reshape(-1)


def _predict(mode: int, left: list, top: list, topright: list, topleft: list) -> list:
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode in (0, 14, 15):
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, topright, topleft)[mode - 1]
    if mode == 5:
        return half(half(left, topright), top)
    if mode <= 9:
        return half(*((left, topleft), (left, top), (topleft, top), (top, topright))[mode - 6])
    if mode == 10:
        return half(half(left, topleft), half(top, topright))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(left, top, topleft, strict=True)]
        to_left = sum(abs(g - a) for g, a in zip(guess, left, strict=True))
        return left if to_left < sum(abs(g - b) for g, b in zip(guess, top, strict=True)) else top
    clamp = lambda x: min(255, max(0, x))
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, topleft, strict=True)]
    mean = half(left, top)
    return [clamp(m + int((m - c) / 2)) for m, c in zip(mean, topleft, strict=True)]


def predictions(modes: np.ndarray, block: int, width: int, height: int, pixels: list, residual, inverse: bool) -> list:  # noqa: ANN001
    """Walk the image in scan order: add the prediction to the residual (``inverse``) or take it from the pixel."""
    across = -(-width >> block)
    for at in range(width * height):
        y, x = divmod(at, width)
        if at == 0:
            guess = [0, 0, 0, 255]
        elif y == 0:
            guess = pixels[at - 1]
        elif x == 0:
            guess = pixels[at - width]
        else:
            mode = int(modes[(y >> block) * across + (x >> block)])
            guess = _predict(mode, pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])
        if inverse:
            pixels[at] = [(a + b) & 255 for a, b in zip(residual[at], guess, strict=True)]
        else:
            residual[at] = [(a - b) & 255 for a, b in zip(pixels[at], guess, strict=True)]
    return pixels if inverse else residual


def _summed(residual: np.ndarray, mode: int) -> np.ndarray:
    """Inverse of one predictor over a whole image, the pixel before or the one above, as running sums."""
    out = residual.copy()
    out[0, 0, 3] += 255
    if mode == ABOVE:
        out[0] = np.cumsum(out[0], axis=0)
        out = np.cumsum(out, axis=0)
    else:
        out[:, 0] = np.cumsum(out[:, 0], axis=0)
        out = np.cumsum(out, axis=1)
    return (out & 255).reshape(-1, 4)


def _cross(channels: np.ndarray, elements: np.ndarray, block: int, width: int, height: int, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) the cross-colour deltas."""
    across = -(-width >> block)
    y, x = np.divmod(np.arange(width * height), width)
    signed = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    e = elements[(y >> block) * across + (x >> block)]
    green_red, green_blue, red_blue = (signed(e >> k & 255) for k in (0, 8, 16))
    out = channels.copy()
    green = signed(channels[:, 1])
    red = (channels[:, 2] + sign * (green_red * green >> 5)) & 255
    of_red = signed(red if sign > 0 else channels[:, 2])
    out[:, 2] = red
    out[:, 0] = (channels[:, 0] + sign * ((green_blue * green >> 5) + (red_blue * of_red >> 5))) & 255
    return out


def _unindex(pixels: np.ndarray, palette: np.ndarray, width: int, height: int) -> np.ndarray:
    bundle = _bundle(len(palette))
    index = (pixels >> 8) & 0xFF
    if bundle:
        bits = 8 >> bundle
        rows = index.reshape(height, -1)
        split = [(rows >> (k * bits)) & ((1 << bits) - 1) for k in range(1 << bundle)]
        index = np.stack(split, axis=2).reshape(height, -1)[:, :width].reshape(-1)
    full = np.zeros(256, dtype=np.uint32)
    full[: len(palette)] = palette
    return full[index]


def _bundle(colours: int) -> int:
    """log2 of the pixels that share a byte."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels, shape (height, width), uint32."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BrokenImage("no RIFF file with a VP8L chunk")
    (size,) = struct.unpack("<I", data[16:20])
    if 20 + size > len(data):
        raise BrokenImage("the data end too early")
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise BrokenImage("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BrokenImage("unknown version")
    transforms, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (x[0] for x in transforms):
            raise BrokenImage("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            transforms.append((kind, block, _read_pixels(bits, -(-coded >> block), -(-height >> block), False), coded))
        elif kind == PALETTE:
            table = _read_pixels(bits, bits.read(8) + 1, 1, False)
            palette = _pixels(np.cumsum(_channels(table), axis=0) & 255)
            transforms.append((kind, 0, palette, coded))
            coded = -(-coded >> _bundle(len(palette)))
        else:
            transforms.append((kind, 0, None, coded))
    pixels = _read_pixels(bits, coded, height, True)
    for kind, block, table, wide in reversed(transforms):
        if kind == PALETTE:
            pixels = _unindex(pixels, table, wide, height)
            continue
        channels = _channels(pixels)
        if kind == SUBTRACT_GREEN:
            channels[:, 0] += channels[:, 1]
            channels[:, 2] += channels[:, 1]
            channels &= 255
        elif kind == CROSS_COLOUR:
            channels = _cross(channels, table, block, wide, height, 1)
        elif len(set(modes := ((table >> 8) & 15).tolist())) == 1 and modes[0] in (LEFT, ABOVE):
            channels = _summed(channels.reshape(height, wide, 4), modes[0])
        else:
            channels = np.array(predictions(np.array(modes), block, wide, height, [None] * len(channels), channels.tolist(), True))
        pixels = _pixels(channels)
    return pixels.reshape(height, width)


# --- writing --------------------------------------------------------------------------------------------------------


class Writer:
    """Gathers (value, bit length) pairs and packs them at once."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.few.append((value, n))

    def _flush(self) -> None:
        if self.few:
            pairs = np.array(self.few, dtype=np.uint64)
            self.values.append(pairs[:, 0])
            self.sizes.append(pairs[:, 1])
            self.few = []

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def packed(self) -> bytes:
        self._flush()
        sizes = np.concatenate(self.sizes).astype(np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        shifted = np.concatenate(self.values).astype(np.uint64) << (starts & 31).astype(np.uint64)
        word = starts >> 5
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(shifted, heads)
        out = np.zeros(int(ends[-1] >> 5) + 3, dtype=np.uint64)
        out[word[heads]] = sums
        low, high = out & np.uint64(MASK32), out >> np.uint64(32)
        low[1:] += high[:-1]  # the parts share no bits
        return low.astype("<u4").tobytes()[: (int(ends[-1]) + 7) // 8]


def prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix symbol, extra bits, number of them) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    extra = value.bit_length() - 2
    return 2 * extra + 2 + (value >> extra & 1), value & ((1 << extra) - 1), extra


def write_code(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code: simple for one symbol, else code lengths of four bits each with runs of zeros."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        symbols = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        return
    w.put(0, 1)
    w.put(15, 4)  # all 19 code length codes
    # 0..14, 17 and 18 in codes of four bits or five, 15 unused: 15 symbols of 4 bits and 2 of 5
    own = np.array([5, 5] + [4] * 13 + [0, 0, 4, 4], dtype=np.uint8)
    for k in CODE_LENGTH_ORDER:
        w.put(int(own[k]), 3)
    words = code_words(own)
    w.put(0, 1)
    k, size, values = 0, len(lengths), lengths.tolist()
    while k < size:
        if values[k] == 0:
            n = 1
            while n < 138 and k + n < size and values[k + n] == 0:
                n += 1
            if n >= 11:
                w.put(int(words[18]), 4)
                w.put(n - 11, 7)
            elif n >= 3:
                w.put(int(words[17]), 4)
                w.put(n - 3, 3)
            else:
                for _ in range(n):
                    w.put(int(words[0]), 5)
            k += n
        else:
            w.put(int(words[values[k]]), int(own[values[k]]))
            k += 1


def framed(data: bytes) -> bytes:
    """A RIFF file around a VP8L stream."""
    pad = data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + pad


def header(w: Writer, width: int, height: int) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.put(value, n)


def _repeats(data: bytes, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, distance) of lines that stand in ``data`` a second time."""
    out, seen, at = [], {}, 0
    for line in data.split(b"\n"):
        n = len(line) + 1
        if n > least and at + n <= len(data):
            before = seen.get(line)
            if before is not None:
                for k in range(0, n, 4096):
                    out.append((at + k, min(4096, n - k), at - before))
            seen[line] = at
        at += n
    return out


def _entropy(x: np.ndarray) -> float:
    """Bits that the values take with a code of their own."""
    counts = np.bincount(x, minlength=256)
    counts = counts[counts > 0]
    return float(len(x) * np.log2(len(x)) - counts @ np.log2(counts))


#: A predictor's differences must take less than this share of the values' own bits, and this many bits less.
GAIN, GAIN_BITS = 0.7, 800


def _differences(raw: np.ndarray) -> tuple[int, np.ndarray] | None:
    """The better predictor and its differences, if it is worth while."""
    own, found = _entropy(raw), None
    least = min(own * GAIN, own - GAIN_BITS)
    picture = raw.reshape(-1, WIDTH)
    for mode in (LEFT, ABOVE):
        before = np.empty_like(picture)
        if mode == LEFT:
            before[:, 1:], before[1:, 0], before[0, 0] = picture[:, :-1], picture[:-1, 0], 0
        else:
            before[1:], before[0, 1:], before[0, 0] = picture[:-1], picture[0, :-1], 0
        difference = (picture - before).reshape(-1)
        if (bits := _entropy(difference)) < least:
            least, found = bits, (mode, difference)
    return found


def _encode_differences(mode: int, difference: np.ndarray) -> bytes:
    w, one = Writer(), np.zeros(256, dtype=np.uint8)
    one[0] = 1
    header(w, WIDTH, len(difference) // WIDTH)
    w.put(1, 1)
    w.put(PREDICTOR, 2)
    w.put(7, 3)  # blocks of 512 pixels
    w.put(0, 1)
    modes = np.zeros(280, dtype=np.uint8)
    modes[mode] = 1
    for code in (modes, one, one, one, one[:40]):
        write_code(w, code)
    for _ in range(3):  # no further transform, no colour cache, one prefix group
        w.put(0, 1)
    lengths = huffman_lengths(np.bincount(difference, minlength=280))
    for code in (lengths, one, one, one, one[:40]):
        write_code(w, code)
    if np.count_nonzero(lengths) > 1:
        w.many(code_words(lengths)[difference], lengths[difference])
    return framed(w.packed())


def encode_bytes(data: bytes) -> bytes:
    """A picture of ``len(data)`` (a multiple of 64, at most :data:`PICTURE`) pixels; the bytes are its green values."""
    raw = np.frombuffer(data, dtype=np.uint8)
    height = len(raw) // WIDTH
    if found := _differences(raw):
        return _encode_differences(*found)
    palette = np.flatnonzero(np.bincount(raw, minlength=256))
    back = np.zeros(256, dtype=np.uint8)
    back[palette] = np.arange(len(palette))
    bundle = _bundle(len(palette))
    index = back[raw]
    if bundle:  # several pixels share a byte
        bits = 8 >> bundle
        parts = index.reshape(-1, 1 << bundle)
        index = np.bitwise_or.reduce(parts << (np.arange(1 << bundle) * bits).astype(np.uint8), axis=1).astype(np.uint8)
    copies = [] if bundle else _repeats(data)
    w = Writer()
    header(w, WIDTH, height)
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(palette) - 1, 8)
    # the palette: differences of the values, in the green channel
    steps = np.diff(palette, prepend=0)
    w.put(0, 1)
    lengths = huffman_lengths(np.bincount(steps, minlength=280))
    one = np.zeros(256, dtype=np.uint8)
    one[0] = 1
    for code in (lengths, one, one, one, one[:40]):
        write_code(w, code)
    if np.count_nonzero(lengths) > 1:
        w.many(code_words(lengths)[steps], lengths[steps])
    w.put(0, 1)  # no further transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one prefix group
    counts = np.bincount(index, minlength=280)
    pairs = [(prefix_of(n), prefix_of(d + 120)) for _, n, d in copies]
    far = np.zeros(40, dtype=np.int64)
    if copies:
        covered = np.zeros(len(index) + 1, dtype=np.int32)
        for (at, n, _), (a, b) in zip(copies, pairs, strict=True):
            covered[at] += 1
            covered[at + n] -= 1
            counts[256 + a[0]] += 1
            far[b[0]] += 1
        counts[:256] -= np.bincount(index[np.cumsum(covered[:-1]) > 0], minlength=256)
    lengths, far_lengths = huffman_lengths(counts), huffman_lengths(far)
    for code in (lengths, one, one, one, far_lengths):
        write_code(w, code)
    words, far_words = code_words(lengths), code_words(far_lengths)
    none, far_none = np.count_nonzero(lengths) == 1, np.count_nonzero(far_lengths) == 1
    at = 0
    for (start, n, _), (a, b) in zip(copies, pairs, strict=True):
        w.many(words[index[at:start]], lengths[index[at:start]])
        w.put(int(words[256 + a[0]]), 0 if none else int(lengths[256 + a[0]]))
        w.put(a[1], a[2])
        w.put(int(far_words[b[0]]), 0 if far_none else int(far_lengths[b[0]]))
        w.put(b[1], b[2])
        at = start + n
    if not none:
        w.many(words[index[at:]], lengths[index[at:]])
    return framed(w.packed())


def store(payload: bytes) -> bytes:
    """``payload`` (a multiple of 64 bytes) as one WebP file, or several in a row if it is over 1 MiB."""
    return b"".join(encode_bytes(payload[k : k + PICTURE]) for k in range(0, len(payload), PICTURE))


def load(media: bytes) -> bytes:
    """The payload of :func:`store`, decoded."""
    out, at = [], 0
    while at < len(media):
        (size,) = struct.unpack("<I", media[at + 4 : at + 8])
        out.append((decode(media[at : at + 8 + size]) >> 8).astype(np.uint8).tobytes())
        at += 8 + size
    return b"".join(out)

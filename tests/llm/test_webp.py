"""The WebP decoder on streams that use every part of the format, written bit by bit here."""

from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import webp


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(raw: bytes) -> None:
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert webp.load(webp.store(payload)) == payload


@pytest.mark.parametrize("raw", [b"one line that is long enough to repeat\n" * 400, bytes(range(256)) * 70_000, os.urandom(64 * 40), b"ab" * 64, b"\0" * 64])
def test_large_repeated_and_flat(raw: bytes) -> None:
    raw += b"\0" * (-len(raw) % 64)
    media = webp.store(raw)
    assert webp.load(media) == raw


def flat_code(w: webp.Writer, size: int, used: int) -> np.ndarray:
    """A prefix code whose first ``used`` (a power of two) symbols have the same length."""
    lengths = np.zeros(size, dtype=np.uint8)
    lengths[:used] = used.bit_length() - 1
    webp.write_code(w, lengths)
    return webp.code_words(lengths)


def body(w: webp.Writer, tokens: list[tuple], cache_bits: int = 0) -> None:
    """Codes and tokens: ("p", argb), ("copy", length, distance code), ("cache", index)."""
    green_size = 280 + (1 << cache_bits if cache_bits else 0)
    lengths = np.zeros(green_size, dtype=np.uint8)
    lengths[:256] = 9  # half of the code space; the other half for the rest
    lengths[256 : 256 + 16] = 6
    rest = green_size - 280
    lengths[280:] = 0
    if rest:
        lengths[256 : 256 + 16] = 7  # an eighth
        lengths[280 : 280 + rest] = 0
        # 3/8 of the code space for the cache: 4 entries need 1/4 and 1/8
        lengths[280:284] = 4
        lengths[272:280] = 6
    else:
        lengths[256 : 256 + 16] = 5
    webp.write_code(w, lengths)
    green = webp.code_words(lengths)
    argb = [flat_code(w, 256, 256) for _ in range(3)]
    far = flat_code(w, 40, 32)
    for kind, *t in tokens:
        if kind == "p":
            a, r, g, b = (t[0] >> k & 255 for k in (24, 16, 8, 0))
            w.put(int(green[g]), int(lengths[g]))
            for code, v in zip(argb, (r, b, a), strict=True):
                w.put(int(code[v]), 8)
        elif kind == "copy":
            s, extra, n = webp.prefix_of(t[0])
            w.put(int(green[256 + s]), int(lengths[256 + s]))
            w.put(extra, n)
            s, extra, n = webp.prefix_of(t[1])
            w.put(int(far[s]), 5)
            w.put(extra, n)
        else:
            w.put(int(green[280 + t[0]]), int(lengths[280 + t[0]]))


def finished(w: webp.Writer) -> np.ndarray:
    return webp.decode(webp.framed(w.packed()))


def random_pixels(n: int, seed: int) -> list[int]:
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint32).tolist()


def plain(w: webp.Writer, pixels: list[int]) -> None:
    w.put(0, 1)  # no cache
    body(w, [("p", p) for p in pixels])


def test_literals_copies_and_near_distances() -> None:
    pixels = random_pixels(12, 1)
    w = webp.Writer()
    webp.header(w, 4, 8)
    w.put(0, 1)
    w.put(0, 1)
    w.put(0, 1)
    # code 1 is the pixel above, code 2 the one before, larger ones count pixels
    body(w, [*(("p", p) for p in pixels), ("copy", 4, 1), ("copy", 3, 2), ("copy", 8, 120 + 12), ("copy", 5, 121)])
    want = list(pixels)
    for n, back in ((4, 4), (3, 1), (8, 12), (5, 1)):
        for _ in range(n):
            want.append(want[-back])
    assert finished(w).reshape(-1).tolist() == want


def test_colour_cache() -> None:
    pixels = random_pixels(6, 2)
    bits = 2
    cache = {}
    tokens, want = [], []
    for p in pixels:
        tokens.append(("p", p))
        want.append(p)
        cache[(webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - bits)] = p
        k = sorted(cache)[-1]
        tokens.append(("cache", k))
        want.append(cache[k])
    w = webp.Writer()
    webp.header(w, 4, 3)
    w.put(0, 1)
    w.put(1, 1)
    w.put(bits, 4)
    w.put(0, 1)
    body(w, tokens, bits)
    assert finished(w).reshape(-1).tolist() == want


def test_meta_prefix_groups() -> None:
    width, height, block = 8, 8, 2
    w = webp.Writer()
    webp.header(w, width, height)
    w.put(0, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(block - 2, 3)
    groups = [0, 1, 1, 0]
    plain(w, [g << 8 for g in groups])
    for value in (7, 200):  # each group knows one colour only
        for s in (value, 1, 2, 255):
            lengths = np.zeros(280, dtype=np.uint8)
            lengths[s] = 1
            webp.write_code(w, lengths)
        webp.write_code(w, np.zeros(40, dtype=np.uint8))
    got = finished(w) >> 8 & 255
    want = [[(7, 200)[groups[(y >> block) * 2 + (x >> block)]] for x in range(width)] for y in range(height)]
    assert got.tolist() == want


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode: int) -> None:
    width, height, block = 6, 5, 2
    pixels = np.array(random_pixels(width * height, mode), dtype=np.uint32)
    channels = webp._channels(pixels).tolist()
    across, down = -(-width >> block), -(-height >> block)
    modes = np.full(across * down, mode)
    residual = webp.predictions(modes, block, width, height, channels, [None] * len(channels), False)
    w = webp.Writer()
    webp.header(w, width, height)
    w.put(1, 1)
    w.put(webp.PREDICTOR, 2)
    w.put(block - 2, 3)
    plain(w, [mode << 8] * (across * down))
    w.put(0, 1)
    w.put(0, 1)
    w.put(0, 1)
    body(w, [("p", int(p)) for p in webp._pixels(np.array(residual))])
    assert finished(w).reshape(-1).tolist() == pixels.tolist()


def test_known_predictions() -> None:
    left, top, topright, topleft = [10, 20, 30, 40], [20, 30, 40, 50], [0, 4, 8, 12], [15, 25, 35, 45]
    assert webp._predict(0, left, top, topright, topleft) == [0, 0, 0, 255]
    assert webp._predict(2, left, top, topright, topleft) == top
    assert webp._predict(7, left, top, topright, topleft) == [15, 25, 35, 45]
    assert webp._predict(12, left, top, topright, topleft) == [15, 25, 35, 45]
    assert webp._predict(11, left, top, topright, topleft) in (left, top)
    assert webp._predict(13, [0] * 4, [0] * 4, topright, [255] * 4) == [0] * 4


def test_cross_colour_and_subtract_green() -> None:
    width, height, block = 5, 4, 2
    pixels = np.array(random_pixels(width * height, 9), dtype=np.uint32)
    across, down = -(-width >> block), -(-height >> block)
    elements = np.array(random_pixels(across * down, 10), dtype=np.uint32)
    coded = webp._cross(webp._channels(pixels), elements, block, width, height, -1)
    coded[:, 0] = (coded[:, 0] - coded[:, 1]) & 255
    coded[:, 2] = (coded[:, 2] - coded[:, 1]) & 255
    w = webp.Writer()
    webp.header(w, width, height)
    w.put(1, 1)
    w.put(webp.CROSS_COLOUR, 2)
    w.put(block - 2, 3)
    plain(w, elements.tolist())
    w.put(1, 1)
    w.put(webp.SUBTRACT_GREEN, 2)
    w.put(0, 1)
    w.put(0, 1)
    w.put(0, 1)
    body(w, [("p", int(p)) for p in webp._pixels(coded)])
    assert finished(w).reshape(-1).tolist() == pixels.tolist()


@pytest.mark.parametrize("colours", [2, 3, 16, 17, 256])
def test_palettes(colours: int) -> None:
    raw = np.random.default_rng(colours).integers(0, colours, 64 * 5).astype(np.uint8)
    assert webp.load(webp.store(raw.tobytes())) == raw.tobytes()


def test_broken_images_are_refused() -> None:
    media = webp.store(b"some text that is stored".ljust(64, b"\0"))
    for cut in (0, 10, 22, len(media) - 6):
        with pytest.raises((webp.BrokenImage, Exception)):
            webp.decode(media[:cut])
    with pytest.raises(webp.BrokenImage):
        webp.code_table(np.array([1, 2, 0], dtype=np.uint8))


def _chunks(raw: bytes, at: int, order: str, name_first: bool) -> dict[bytes, bytes]:
    """The chunks of a RIFF or PNG file by name; equal names are joined."""
    out: dict[bytes, bytes] = {}
    while at + 8 <= len(raw):
        a, b = raw[at : at + 4], raw[at + 4 : at + 8]
        name, size = (a, b) if name_first else (b, a)
        n = int.from_bytes(size, order)
        out[name] = out.get(name, b"") + raw[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1 if name_first else 4)
    return out


def test_a_stream_of_another_writer() -> None:
    """The alpha plane of a picture in Python's own test files is a lossless stream without a header; the same picture
    lies there as PNG."""
    import test.test_email
    import zlib
    from pathlib import Path

    folder = Path(test.test_email.__file__).parent / "data"
    if not (folder / "python.webp").exists():
        pytest.skip("this Python has no test files")
    alpha = _chunks((folder / "python.webp").read_bytes(), 12, "little", True)[b"ALPH"]
    assert alpha[0] == 1  # lossless, not filtered
    w = webp.Writer()
    webp.header(w, 16, 16)
    got = webp.decode(webp.framed(w.packed() + alpha[1:])) >> 8 & 255
    png = _chunks((folder / "python.png").read_bytes(), 8, "big", False)
    assert png[b"IHDR"][:10] == bytes([0, 0, 0, 16, 0, 0, 0, 16, 8, 3])
    rows = np.frombuffer(zlib.decompress(png[b"IDAT"]), dtype=np.uint8).reshape(16, 17)
    assert not rows[:, 0].any()  # no filters
    opacity = np.full(256, 255, dtype=np.uint32)
    opacity[: len(png[b"tRNS"])] = list(png[b"tRNS"])
    assert (got == opacity[rows[:, 1:]]).all()


@pytest.mark.parametrize("mode", [webp.LEFT, webp.ABOVE])
def test_bytes_that_a_predictor_shortens(mode: int) -> None:
    steps = np.random.default_rng(mode).integers(0, 3, (96, webp.WIDTH))
    raw = np.cumsum(steps, axis=1 if mode == webp.LEFT else 0).astype(np.uint8).tobytes()
    found = webp._differences(np.frombuffer(raw, dtype=np.uint8))
    assert found is not None and found[0] == mode
    media = webp.store(raw)
    assert webp.load(media) == raw and len(media) < len(raw) / 2
    # the vectorised inverse is that of the general one
    r = np.random.default_rng(9).integers(0, 256, (5, 7, 4)).astype(np.int32)
    general = webp.predictions(np.full(1, mode), 9, 7, 5, [None] * 35, r.reshape(-1, 4).tolist(), True)
    assert webp._summed(r, mode).tolist() == general

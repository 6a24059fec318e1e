import hashlib
import random
import zlib

import numpy as np
import pytest

from tessellon.llm import jpeg


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, size):
        self.text += format(value, f"0{size}b") if size else ""

    def bytes(self):
        padded = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(padded[i : i + 8], 2) for i in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")


def plain_jpeg(width, height, sampling, restart, seed):
    """A baseline JPEG with random coefficients, and the luminance DC values of its blocks, written symbol by symbol."""
    rng = random.Random(seed)
    dc_codes = {c: (c, 4) for c in range(12)}
    symbols = [0x00, 0xF0, *(r << 4 | s for r in range(4) for s in range(1, 5))]
    ac_codes = {s: (i, 6) for i, s in enumerate(symbols)}
    table = lambda codes: bytes(sum(n == i for _, n in codes.values()) for i in range(1, 17)) + bytes(codes)
    wide, high = max(h for h, _ in sampling), max(v for _, v in sampling)
    if len(sampling) == 1:
        sampling, wide, high = [(1, 1)], 1, 1
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    luma = np.zeros((down * sampling[0][1], across * sampling[0][0]), int)
    parts, bits, last = [], Bits(), [0] * len(sampling)

    def number(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            parts.append(bits.bytes())
            bits, last = Bits(), [0] * len(sampling)
        for c, (h, v) in enumerate(sampling):
            for j in range(v):
                for i in range(h):
                    value = rng.randrange(-60, 60)
                    n, low = number(value - last[c])
                    last[c] = value
                    bits.put(*dc_codes[n])
                    bits.put(low, n)
                    k = 1
                    while k < 64 and rng.random() < 0.7:
                        skip = rng.choice([0, 0, 1, 3, 16])
                        if k + skip >= 63:
                            break
                        if skip == 16:
                            bits.put(*ac_codes[0xF0])
                            k += 16
                            continue
                        n, low = number(rng.choice([-9, -3, -1, 1, 2, 7]))
                        bits.put(*ac_codes[skip << 4 | n])
                        bits.put(low, n)
                        k += skip + 1
                    if k < 64:
                        bits.put(*ac_codes[0])
                    if c == 0:
                        luma[unit // across * v + j, unit % across * h + i] = value
    parts.append(bits.bytes())
    scan = b"".join(p + (b"" if i == len(parts) - 1 else bytes([0xFF, 0xD0 + i % 8])) for i, p in enumerate(parts))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling))
    data = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0] + [10] * 64)) + jpeg.segment(0xC0, frame) + jpeg.segment(0xC4, b"\x00" + table(dc_codes)) + jpeg.segment(0xC4, b"\x10" + table(ac_codes))
    if restart:
        data += jpeg.segment(0xDD, restart.to_bytes(2, "big"))
    data += jpeg.segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + bytes([0, 63, 0])) + scan + b"\xff\xd9"
    full = luma[: -(-height * sampling[0][1] // (8 * high)), : -(-width * sampling[0][0] // (8 * wide))]
    return data, np.clip(np.floor((full * 10 + 4) / 8) + 128, 0, 255).astype(np.uint8)


CASES = [(8, 8, [(1, 1)], 0), (61, 35, [(1, 1)], 3), (61, 35, [(2, 2)], 0), (70, 50, [(2, 2), (1, 1), (1, 1)], 0), (70, 50, [(2, 1), (1, 1), (1, 1)], 2), (33, 90, [(1, 2), (1, 1), (1, 1)], 5), (40, 40, [(1, 1), (1, 1), (1, 1)], 1)]


def test_thumbnails_equal_the_coefficients():
    made = [plain_jpeg(*case, seed=i) for i, case in enumerate(CASES)]
    for (width, height, *_), (_, pixels), images in zip(CASES, made, jpeg.read_images([d for d, _ in made])):
        ((image, got),) = images
        assert (image.width, image.height) == (width, height) and np.array_equal(got, pixels)


def payloads():
    rng = np.random.default_rng(3)
    yield from (bytes(64), b"\xff" * 128, b"\x00\xff" * 320, bytes(rng.integers(0, 256, 64 * 70, np.uint8)))
    yield bytes(rng.integers(0, 256, 64 * 8_200, np.uint8))
    for t in ("", "short", "é漢🙂" * 99, "word " * 5_000):
        yield jpeg.pad(t)


def test_bytes_come_back():
    every = list(payloads())
    for p, images in zip(every, jpeg.read_images(jpeg.write_images(every))):
        assert jpeg.stored_bytes(images) == p


def test_bytes_too_many_for_one_image(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST", 3)
    monkeypatch.setattr(jpeg, "WIDE", 128)
    p = bytes(range(256)) * 5
    (media,) = jpeg.write_images([p])
    assert media.count(b"\xff\xd8\xff") == 4 and jpeg.stored_bytes(jpeg.read_images([media])[0]) == p


@pytest.mark.parametrize("cut", [0, 1, 30, 150, 190, -40])
def test_broken_media_have_no_thumbnail_and_spoil_no_other(cut):
    good = jpeg.write_images([jpeg.pad("some text " * 200)])[0]
    bad = good[:cut]
    out = jpeg.read_images([good, bad, None, b"\xff\xd8\xff\xc2\x00\x02", good])
    assert out[1] is None and out[2] is None and out[3] is None
    assert jpeg.stored_bytes(out[0]) == jpeg.stored_bytes(out[4]) == jpeg.pad("some text " * 200)


def test_operator_rows(spark):
    texts = ["", None, "abc", "x" * 64, "y" * 65, "é" * 40_000, "abc"]
    df = spark.createDataFrame([(i, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary").repartition(2)
    stored = jpeg.store_texts(df)
    rows = {r.doc_id: r for r in jpeg.read_texts(stored).collect()}
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for i, t in enumerate(texts):
        raw, p, r = (t or "").encode(), jpeg.pad(t), rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), max(64, -(-len(raw) // 64) * 64), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
    assert rows[2][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    shown = {r.doc_id: r for r in jpeg.describe(stored).collect()}
    assert (shown[2].width, shown[2].height) == (512, 8) and bytes(shown[2].thumbnail) == jpeg.pad("abc")
    odd = spark.createDataFrame([(1, None), (2, b"no image")], "doc_id long, media binary")
    assert {tuple(r)[1:] for r in jpeg.describe(odd).collect()} == {(None, None, None, None)}
    assert jpeg.read_texts(jpeg.store_texts(df.limit(0))).count() == 0


def test_media_that_are_no_images(spark):
    rows = [(1, 4, None), (2, 4, bytearray(b"")), (3, 4, bytearray(b"not an image")), (4, None, bytearray(b"\xff\xd8\xff\xd9"))]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    for r in jpeg.read_texts(df).collect():
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (None,) * 6

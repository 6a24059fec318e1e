"""Operator 3: media columns of baseline JPEG.

The reader parses the markers, Huffman-decodes the scan and keeps the DC coefficients of
the luminance component: at one pixel for each block they are a thumbnail that needs no
inverse transform. Scans are decoded in numpy, one symbol at a time for all restart
segments of many images together, so the cost of a step is shared by thousands of
segments. Dimensions and a 64-bit hash of the thumbnail are stored beside the image.

The writer stores any bytes losslessly as such an image: each byte is the mean of one
8 x 8 block, so a quantisation step of 8 makes it the block's only coefficient and the
thumbnail gives the bytes back. Restart markers stand after every 64 blocks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.llm.arrow import map_texts, parts

#: Blocks of a restart segment and of a row, the most blocks a dimension may have, and the blocks of a row once 64 are too few.
UNIT, MOST, WIDE = 64, 8_191, 8_128
#: Bytes that are written or decoded together.
GROUP = 1 << 18

#: Code lengths of the written DC categories 0 to 8; the AC table has the end of block alone, as one bit.
DC_LENGTHS = {0: 4, 1: 4, 2: 4, 3: 4, 8: 4, 4: 3, 5: 3, 6: 3, 7: 3}


def canonical(lengths: dict[int, int]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """The table segment's bytes and (code, length) of each symbol, shortest codes first."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for symbol in order:
        code <<= lengths[symbol] - last
        last = lengths[symbol]
        codes[symbol] = code, last
        code += 1
    return bytes(sum(n == i for n in lengths.values()) for i in range(1, 17)) + bytes(order), codes


DC_TABLE, _DC_CODES = canonical(DC_LENGTHS)
AC_TABLE, _AC_CODES = canonical({0: 1})


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a block, by its DC difference + 255: category, difference, end of block."""
    bits, sizes = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, length = _DC_CODES[category]
        low = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255], sizes[d + 255] = (code << category | low) << 1 | _AC_CODES[0][0], length + category + 1
    return bits, sizes


_BITS, _SIZES = _block_codes()


def segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(size: int, wide: int, high: int) -> bytes:
    """Everything before the scan of an image of ``wide`` x ``high`` blocks that stores ``size`` bytes."""
    frame = bytes([8]) + (high * 8).to_bytes(2, "big") + (wide * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
            segment(0xFE, b"payload %d" % size),
            segment(0xDB, bytes([0] + [8] * 64)),
            segment(0xC0, frame),
            segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE),
            segment(0xDD, UNIT.to_bytes(2, "big")),
            segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
        ]
    )


def grid(size: int) -> tuple[int, int]:
    """Blocks across and down of an image that stores ``size`` bytes."""
    wide = UNIT if size <= UNIT * MOST else WIDE
    return wide, max(1, -(-size // wide))


def write_images(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a JPEG; one too large for an image becomes several that follow one another."""
    parts = [(i, p[a : a + WIDE * MOST]) for i, p in enumerate(payloads) for a in range(0, max(len(p), 1), WIDE * MOST)]
    out: list[list[bytes]] = [[] for _ in payloads]
    for group in grouped(parts, lambda x: len(x[1])):
        shapes = [grid(len(p)) for _, p in group]
        for (i, p), shape, scan in zip(group, shapes, scans([p.ljust(w * h, b"\0") for (_, p), (w, h) in zip(group, shapes)])):
            out[i].append(header(len(p), *shape) + scan + b"\xff\xd9")
    return [b"".join(x) for x in out]


def grouped(items: list, size) -> Iterator[list]:  # noqa: ANN001
    """Runs of items of about ``GROUP`` bytes in all."""
    held, total = [], 0
    for item in items:
        if held and total + size(item) > GROUP:
            yield held
            held, total = [], 0
        held.append(item)
        total += size(item)
    if held:
        yield held


def scans(payloads: list[bytes]) -> list[bytes]:
    """The entropy-coded data of each payload, its length a multiple of ``UNIT``."""
    dc = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, UNIT) - 128
    diff = np.diff(dc, axis=1, prepend=0)
    bits, sizes = _BITS[diff + 255], _SIZES[diff + 255]
    ends = np.cumsum(sizes, axis=1)
    whole = (ends[:, -1] + 7) // 8  # bytes of each segment
    first = np.cumsum(whole) - whole
    at = first[:, None] * 8 + ends - sizes
    window = bits << (24 - at % 8 - sizes)
    data = np.zeros(int(whole.sum()) + 3)
    for k in range(3):
        data += np.bincount((at // 8 + k).ravel(), (window >> (16 - 8 * k) & 0xFF).ravel(), len(data))
    data[first + whole - 1] += (1 << (whole * 8 - ends[:, -1])) - 1
    data = data[: int(whole.sum())].astype(np.uint8)
    # a zero follows every byte of ones, and a restart marker every segment but an image's last
    owner = np.repeat(np.arange(len(whole)), whole)
    ones = data == 0xFF
    per_image = np.array([len(p) // UNIT for p in payloads])
    rank = np.arange(len(whole)) - np.repeat(np.cumsum(per_image) - per_image, per_image)
    inner = rank < np.repeat(per_image, per_image) - 1
    before = np.cumsum(inner) - inner
    place = np.arange(len(data)) + np.cumsum(ones) - ones + 2 * before[owner]
    stuffed = np.zeros(len(data) + int(ones.sum()) + 2 * int(inner.sum()), np.uint8)
    stuffed[place] = data
    close = place[first + whole - 1] + 1 + ones[first + whole - 1]
    stuffed[close[inner]], stuffed[close[inner] + 1] = 0xFF, 0xD0 + rank[inner] % 8
    cuts = [0, *close[np.cumsum(per_image) - 1].tolist()]
    raw = stuffed.tobytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class Image:
    """What the markers of one image say, with its scan's bytes."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    steps: dict[int, int] = field(default_factory=dict)  # DC quantisation step by table
    codes: dict[tuple[int, int], bytes] = field(default_factory=dict)  # Huffman tables by class and number
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # component, across, down, quantisation table
    tables: dict[int, tuple[int, int]] = field(default_factory=dict)  # DC and AC table by component
    scan: bytes = b""


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(data: bytes, at: int = 0) -> tuple[Image, int]:
    """One baseline image and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image begins here")
    image, at = Image(), at + 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if size < 2 or at > len(data):
            raise ValueError("a segment is cut short")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.steps[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("the image is not baseline")
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                image.codes[body[0] >> 4, body[0] & 15] = body[1 : 17 + count]
                body = body[17 + count :]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            image.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if not image.parts or not image.width or not image.height or set(image.tables) != {p[0] for p in image.parts}:
                raise ValueError("the scan does not hold the frame")
            end = _SCAN_END.search(data, at)
            stop = end.start() if end else len(data)
            image.scan = data[at:stop]
            return image, stop + 2 * (data[stop : stop + 2] == b"\xff\xd9")
    raise ValueError("there is no scan")


@lru_cache(maxsize=64)
def lookup(table: bytes) -> np.ndarray:
    """length << 8 | symbol by the next 16 bits; 0 where no code begins so."""
    out, code, symbols = np.zeros(1 << 16, np.int32), 0, iter(table[16:])
    for length, count in enumerate(table[:16], 1):
        for _ in range(count):
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | next(symbols)
            code += 1
        code <<= 1
    return out


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The luminance thumbnail of each image, one pixel for each of its whole or partial blocks."""
    luts: dict[bytes, int] = {}
    shapes, lanes, streams, slots = [], [], [], []
    base = 0
    for image in images:
        plan = []  # of one unit: DC table, AC table, component, its row and column in the unit
        wide_unit, high_unit = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
        single = len(image.parts) == 1
        for c, (name, h, v, _) in enumerate(image.parts):
            dc, ac = (luts.setdefault(image.codes[k, t], len(luts)) for k, t in enumerate(image.tables[name]))
            plan += [(dc, ac, c, j, i) for j in range(1 if single else v) for i in range(1 if single else h)]
        _, h, v, _ = image.parts[0]
        per_row = -(-image.width // (8 * (1 if single else wide_unit)))
        rows = -(-image.height // (8 * (1 if single else high_unit)))
        across, down = (1, 1) if single else (h, v)
        full = -(-image.width * h // (8 * wide_unit)), -(-image.height * v // (8 * high_unit))
        shapes.append((base, rows * down, per_row * across, full))
        units, every = per_row * rows, image.restart or per_row * rows
        scan = np.frombuffer(image.scan, np.uint8)
        marks = np.flatnonzero((scan[:-1] == 0xFF) & (scan[1:] != 0)) if len(scan) else np.zeros(0, int)
        edges = [0, *(marks + 2).tolist()]
        if len(edges) < -(-units // every):
            raise ValueError("restart segments are missing")
        for n in range(-(-units // every)):
            streams.append(scan[edges[n] : int(marks[n]) if n < len(marks) else len(scan)])
            lanes.append((base, len(slots), n * every, min(every, units - n * every), per_row, per_row * across, across, down))
        slots.append(plan)
        base += rows * down * per_row * across
    sizes = np.array([len(s) + 8 for s in streams])
    raw = np.zeros(int(sizes.sum()), np.uint8)
    starts = np.cumsum(sizes) - sizes
    lengths = np.array([len(s) for s in streams])
    source = np.concatenate(streams) if streams else np.zeros(0, np.uint8)
    raw[np.arange(len(source)) + 8 * np.repeat(np.arange(len(streams)), lengths)] = source
    # take out the zero after each byte of ones, in all segments at once
    stuffing = np.zeros(len(raw), bool)
    stuffing[1:] = (raw[:-1] == 0xFF) & (raw[1:] == 0)
    gone = np.cumsum(stuffing)
    starts -= np.where(starts > 0, gone[np.maximum(starts - 1, 0)], 0)
    data = np.concatenate([raw[~stuffing], np.zeros(8, np.uint8)]).astype(np.int64)
    ends = np.append(starts[1:], len(data) - 8) * 8
    words = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
    lut = np.stack([lookup(t) for t in luts]).ravel() if luts else np.zeros(1, np.int32)
    most = max(map(len, slots), default=1)
    plans = np.zeros((len(slots), most, 5), np.int64)
    for i, plan in enumerate(slots):
        plans[i, : len(plan)] = plan
    out = np.zeros(base, np.int64)
    lane = np.array(lanes, np.int64).reshape(-1, 8)
    where, of, unit, left, per_row, stride, across, down = lane.T.copy()
    count = np.array([len(p) for p in slots])[of] if slots else np.zeros(0, int)
    position, slot, k = starts * 8, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    guess = np.zeros((len(lane), 4), np.int64)
    live = np.arange(len(lane))
    while len(live):
        own = plans[of[live], slot[live]]
        is_dc = k[live] == 0
        bit = position[live]
        if (bit >= ends[live]).any():
            raise ValueError("a segment ends within a block")
        window = words[bit >> 3] >> (8 - (bit & 7)) & 0xFFFFFFFF
        found = lut[np.where(is_dc, own[:, 0], own[:, 1]) << 16 | window >> 16]
        if not found.all():
            raise ValueError("no such code")
        length, symbol = (found >> 8).astype(np.int64), (found & 0xFF).astype(np.int64)
        extra = np.where(is_dc, symbol, symbol & 15)
        position[live] = bit + length + extra
        if is_dc.any():
            d = np.flatnonzero(is_dc)
            rows, more = live[d], extra[d]
            value = window[d] >> (32 - length[d] - more) & ((1 << more) - 1)
            value = np.where((more > 0) & (value < 1 << np.maximum(more - 1, 0)), value - (1 << more) + 1, value)
            part = own[d, 2]
            guess[rows, part] += value
            luma = part == 0
            rows, place = rows[luma], own[d[luma]]
            y, x = unit[rows] // per_row[rows] * down[rows] + place[:, 3], unit[rows] % per_row[rows] * across[rows] + place[:, 4]
            out[where[rows] + y * stride[rows] + x] = guess[rows, 0]
        step = np.where(is_dc, 1, np.where(extra > 0, (symbol >> 4) + 1, np.where(symbol == 0xF0, 16, 64)))
        k[live] += step
        done = live[k[live] >= 64]
        if len(done):
            k[done] = 0
            slot[done] += 1
            over = done[slot[done] == count[done]]
            slot[over], unit[over], left[over] = 0, unit[over] + 1, left[over] - 1
            if (left[over] == 0).any():
                live = live[left[live] > 0]
    result = []
    for image, (start, rows, columns, (wide, high)) in zip(images, shapes):
        dc = out[start : start + rows * columns].reshape(rows, columns)[:high, :wide]
        result.append(np.clip((dc * image.steps[image.parts[0][3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8))
    return result


def thumbnail_hash(pixels: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid over the thumbnail are brighter than the mean of all cells."""
    high, wide = pixels.shape
    rows, columns = np.arange(8) * high // 8, np.arange(8) * wide // 8
    cells = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, 0), columns, 1)
    area = np.maximum(np.diff(rows, append=high), 1)[:, None] * np.maximum(np.diff(columns, append=wide), 1)
    means = cells / area
    return int(np.packbits(means > means.mean()).view(">u8")[0])


def read_images(media: Iterable[bytes | None]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """The images of each medium with their thumbnails; None for what is null or no baseline JPEG."""
    found: list[list[Image] | None] = []
    for data in media:
        try:
            at, own = 0, []
            while data and at < len(data):
                image, at = parse(data, at)
                own.append(image)
            found.append(own or None)
        except (ValueError, IndexError, KeyError):
            found.append(None)
    out: list[list[tuple[Image, np.ndarray]] | None] = [None] * len(found)
    for group in grouped([i for i, x in enumerate(found) if x], lambda i: sum(len(m.scan) for m in found[i])):
        try:
            pixels = iter(thumbnails([m for i in group for m in found[i]]))
            for i in group:
                out[i] = [(m, next(pixels)) for m in found[i]]
        except (ValueError, IndexError, KeyError):  # one of them is broken: read each by itself
            for i in group:
                try:
                    out[i] = list(zip(found[i], thumbnails(found[i])))
                except (ValueError, IndexError, KeyError):
                    out[i] = None
    return out


def stored_bytes(images: list[tuple[Image, np.ndarray]]) -> bytes:
    """What the writer stored in the images."""
    return b"".join(pixels.tobytes()[: int(m.comment.split()[-1])] for m, pixels in images)


def pad(text: str | None) -> bytes:
    """A text's UTF-8 bytes, followed by bytes 0 up to the next positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b"\0")


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each text as a JPEG that holds its padded bytes. Null counts as empty; repeated rows stay."""
    return map_texts(df, key, text, "n_bytes bigint, media binary", lambda texts: [[len((t or "").encode("utf-8", "surrogatepass")) for t in texts], write_images([pad(t) for t in texts])])


def describe(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, width, height, thumbnail_hash, thumbnail) of each medium's first image, nulls where it is no baseline JPEG.

    ``thumbnail`` holds the luminance pixels by rows, one for each 8 x 8 block.
    """

    def batch(items: list) -> list[list]:
        rows = [(m[0][0].width, m[0][0].height, f"{thumbnail_hash(m[0][1]):016x}", m[0][1].tobytes()) if m else (None,) * 4 for m in read_images(items)]
        return [list(c) for c in zip(*rows)] if rows else [[]] * 4

    return map_texts(df, key, media, "width int, height int, thumbnail_hash string, thumbnail binary", batch)


def read_texts(df: DataFrame, key: str = "doc_id", media: str = "media", size: str = "n_bytes") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored texts.

    The payload's figures are of the bytes read back from the image. ``feature`` is the
    image's dimensions and its thumbnail's hash. All six are null where the medium is
    null or no baseline JPEG that this writer made.
    """
    fields = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    names = [key, size, *(f.split()[0] for f in fields.split(", "))]

    def rows(items: list[bytes | None]) -> Iterator[tuple]:
        for data, images in zip(items, read_images(items)):
            try:
                payload = stored_bytes(images or [])
            except (ValueError, IndexError, AttributeError):
                payload = b""
            if not payload:
                yield (None,) * 6
                continue
            feature = ";".join(f"{m.width}x{m.height}:{thumbnail_hash(p):016x}" for m, p in images)
            yield len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                columns = zip(*rows(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, columns, kinds)], names=names)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    base = df.select(F.col(key), F.col(size), F.col(media))
    return base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, {size} bigint, {fields}")

"""Progressive JPEG as a lossless store of bytes: coefficients are written in scans by spectral
selection and successive approximation, and read back into coefficient arrays and RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.cluster import batched, rows_of

#: Payloads are multiples of three blocks of 64 coefficients.
UNIT = 192
#: One MCU: 16 x 16 pixels, of which four blocks are lightness and one each the two colours, at half their resolution.
MCU = 384
#: MCUs in a column of an image; the format allows 65,535 lines.
MAX_HIGH = 4095


def _zigzag() -> np.ndarray:
    """Places in an 8 x 8 block in the order of its diagonals, which change direction each time."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()


def _basis() -> np.ndarray:
    """(64, 64): zigzag coefficients to samples, the inverse transform of a whole block."""
    x = np.arange(8)
    one = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    one[0] /= np.sqrt(2)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[ZIGZAG].astype(np.float32)


BASIS = _basis()


# ---- writing -------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2) + body


def _table(kind: int, number: int, lengths: dict[int, list[int]]) -> bytes:
    counts = bytes(len(lengths.get(n, ())) for n in range(1, 17))
    return _segment(0xC4, bytes((kind << 4 | number,)) + counts + bytes(s for n in sorted(lengths) for s in lengths[n]))


def _entropy(bits: np.ndarray) -> bytes:
    """Bits to bytes, the last one filled with ones, and a zero after each 0xFF."""
    fill = -len(bits) % 8
    return np.packbits(np.r_[bits, np.ones(fill, np.uint8)]).tobytes().replace(b"\xff", b"\xff\x00")


def _scan(components: list[int], first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    named = b"".join(bytes((c + 1, 0)) for c in components)
    return _segment(0xDA, bytes((len(components),)) + named + bytes((first, last, high << 4 | low))) + data


_HEAD = b"\xff\xd8" + _segment(0xDB, b"\0" + b"\1" * 64)
_FIRST_TABLES = _table(0, 0, {1: [1], 2: [0]}) + _table(1, 0, {1: [7]})
_RUN_TABLE = _table(1, 0, {4: [n << 4 for n in range(15)]})


def encode(payload: bytes) -> bytes:
    """A progressive JPEG, 4:2:0, whose coefficients are the bytes of ``payload``, a multiple of 192, and blanks that fill its last MCUs.

    Byte b is, as DC, the coefficient b - 128, and as AC one whose eight extra bits are b: b
    itself from 128, b - 255 below. All AC coefficients have one size, so each has one code.
    DC comes at 1/128 first and then a bit at a time; AC at 1/2, in bands, and then its last bit.
    """
    n = -(-len(payload) // MCU)
    wide = -(-n // MAX_HIGH)
    high = -(-n // wide)
    values = np.frombuffer(payload + b" " * (MCU * wide * high - len(payload)), np.uint8).reshape(-1, 6, 64)
    frame = bytes((8,)) + (16 * high).to_bytes(2) + (16 * wide).to_bytes(2) + b"\3"
    out = [_HEAD, _segment(0xC2, frame + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))), _FIRST_TABLES]
    dc = values[:, :, 0].astype(np.int16) - 128
    step = np.empty_like(dc)
    for own in _COMPONENTS:  # each component's differences run through its own blocks
        top = (dc[:, own] >> 7).ravel()
        step[:, own] = np.diff(top, prepend=np.int16(0)).reshape(len(dc), -1)
    # +1: code 0 and bit 1; -1: code 0 and bit 0; 0: code 10
    pairs = np.stack([(step == 0).astype(np.uint8), (step == 1).astype(np.uint8)], axis=2)
    out.append(_scan([0, 1, 2], 0, 0, 0, 7, _entropy(pairs.ravel())))
    for low in range(6, -1, -1):
        out.append(_scan([0, 1, 2], 0, 0, low + 1, low, _entropy(((dc >> low) & 1).astype(np.uint8).ravel())))
    planes = [_in_rows(values[:, own], high, wide) for own in _COMPONENTS]
    for component, bands in ((0, ((1, 5), (6, 63))), (1, ((1, 63),)), (2, ((1, 63),))):
        for first, last in bands:
            # the code is one zero bit, and seven extra bits follow
            out.append(_scan([component], first, last, 0, 1, (planes[component][:, first : last + 1] >> 1).tobytes()))
    out.append(_RUN_TABLE)
    for component, plane in enumerate(planes):
        own = plane[:, 1:]
        bits = own & 1 ^ (own < 128)
        parts = []
        for at in range(0, len(bits), 0x7FFF):
            run = bits[at : at + 0x7FFF]
            size = len(run).bit_length() - 1
            head = size << size | (len(run) - (1 << size))
            parts += [np.array([head >> k & 1 for k in range(size + 3, -1, -1)], np.uint8), run.ravel()]
        out.append(_scan([component], 1, 63, 1, 0, _entropy(np.concatenate(parts))))
    out.append(b"\xff\xd9")
    return b"".join(out)


#: The blocks of an MCU that each component has.
_COMPONENTS = (slice(0, 4), slice(4, 5), slice(5, 6))


def _in_rows(blocks: np.ndarray, high: int, wide: int) -> np.ndarray:
    """The blocks of a component, MCU by MCU, in the order of the picture's rows instead."""
    side = 2 if blocks.shape[1] == 4 else 1
    return blocks.reshape(high, wide, side, side, 64).swapaxes(1, 2).reshape(-1, 64)


def _in_mcus(rows: np.ndarray, high: int, wide: int, side: int) -> np.ndarray:
    """The reverse: (MCUs, blocks, 64)."""
    return rows.reshape(high, side, wide, side, 64).swapaxes(1, 2).reshape(high * wide, side * side, 64)


# ---- reading -------------------------------------------------------------------------------


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    places: dict[tuple[int, ...], list[Places]] = field(default_factory=dict)

    def most(self, side: str) -> int:
        return max(getattr(c, side) for c in self.components.values())


class _Bits:
    def __init__(self, data: bytes):
        self.data = data
        self.at = 0

    @cached_property
    def bits(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.data, np.uint8))

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | bit
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code in the scan's table")

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _codes(body: bytes) -> Iterator[tuple[int, dict[tuple[int, int], int]]]:
    while body:
        number, counts, body = body[0], body[1:17], body[17:]
        code, found = 0, {}
        for n, count in enumerate(counts, 1):
            for symbol in body[:count]:
                found[n, code] = symbol
                code += 1
            body = body[count:]
            code <<= 1
        yield number, found


@dataclass
class Places:
    """Where the blocks of a scan's component go, in the scan's order: ``rows`` MCUs of ``cols`` blocks."""

    at: np.ndarray | slice
    rows: int
    cols: int

    def listed(self) -> list[list[int]]:
        n = self.rows * self.cols
        return (np.arange(n) if isinstance(self.at, slice) else self.at).reshape(self.rows, self.cols).tolist()


def _places(image: Image, scan: tuple[int, ...]) -> list[Places]:
    if scan not in image.places:
        image.places[scan] = _find_places(image, [image.components[k] for k in scan])
    return image.places[scan]


def _find_places(image: Image, scan: list[Component]) -> list[Places]:
    h_max, v_max = image.most("h"), image.most("v")
    out = []
    for c in scan:
        if h_max == v_max == 1:  # every MCU is a block, in order
            out.append(Places(slice(None), c.high * c.wide, 1))
        elif len(scan) == 1:
            wide = -(-(-(-image.width * c.h // h_max)) // 8)
            high = -(-(-(-image.height * c.v // v_max)) // 8)
            out.append(Places((c.wide * np.arange(high)[:, None] + np.arange(wide)).ravel(), high * wide, 1))
        else:
            rows, cols = c.high // c.v, c.wide // c.h
            at = c.wide * c.v * np.arange(rows)[:, None, None, None] + c.h * np.arange(cols)[:, None, None] + c.wide * np.arange(c.v)[:, None] + np.arange(c.h)
            out.append(Places(at.ravel(), rows * cols, c.v * c.h))
    return out


def decode_coefficients(data: bytes) -> Image:
    """The coefficient arrays (blocks, 64 in zigzag order) of a progressive JPEG with Huffman coding, without restarts."""
    image, tables, at = Image(), {}, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            if not image.components:
                raise ValueError("a JPEG without picture")
            return image
        size = int.from_bytes(data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    image.quant[body[0] & 15], body = np.frombuffer(body[1:129], ">u2").astype(np.float32), body[129:]
                else:
                    image.quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.float32), body[65:]
        elif marker == 0xC4:
            tables.update(_codes(body))
        elif marker == 0xC2:
            image.height, image.width = int.from_bytes(body[1:3]), int.from_bytes(body[3:5])
            for k in range(body[5]):
                number, sampling, quant = body[6 + 3 * k : 9 + 3 * k]
                image.components[number] = Component(sampling >> 4, sampling & 15, quant)
            h_max, v_max = image.most("h"), image.most("v")
            for c in image.components.values():
                c.wide = -(-image.width // (8 * h_max)) * c.h
                c.high = -(-image.height // (8 * v_max)) * c.v
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
        elif marker == 0xDA:
            end = at
            while (end := data.index(b"\xff", end)) >= 0 and data[end + 1] == 0:
                end += 2
            n = body[0]
            scan = tuple(body[1 : 1 + 2 * n : 2])
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            _read_scan(image, scan, body[2 : 2 + 2 * n : 2], tables, first, last, approx >> 4, approx & 15, data[at:end].replace(b"\xff\x00", b"\xff"))
            at = end
        elif 0xC0 <= marker <= 0xCF or marker == 0xDD and any(body):
            raise ValueError("only progressive JPEG with Huffman coding and without restarts is read")


def _read_scan(image, scan, numbers, tables, first, last, high, low, data) -> None:
    bits = _Bits(data)
    places = _places(image, scan)
    components = [image.components[k] for k in scan]
    if first == 0 and high == 0 and _two_bits(tables, numbers):
        _quick_dc(bits.bits, components, places, low)
    elif first == 0 and high == 0:
        _read_dc(bits, components, [tables[n >> 4] for n in numbers], places, low)
    elif first == 0:
        _refine_dc(bits, components, places, low)
    else:
        reader = _read_ac if high == 0 else _refine_ac
        reader(bits, components[0], tables[0x10 | numbers[0] & 15], places[0], first, last, low)


def _two_bits(tables, numbers) -> bool:
    """Whether every difference takes two bits: a code and a bit for +1 and -1, a longer code for 0."""
    return all(tables[n >> 4] == {(1, 0): 1, (2, 2): 0} for n in numbers)


def _quick_dc(bits: np.ndarray, components: list[Component], places: list[Places], low: int) -> None:
    """A first scan of DC whose differences all take two bits, all at once."""
    rows, width = places[0].rows, sum(p.cols for p in places)
    pairs = bits[: 2 * rows * width].reshape(rows, width, 2)
    steps = np.where(pairs[:, :, 0] == 1, 0, 2 * pairs[:, :, 1].astype(np.int16) - 1)
    k = 0
    for component, place in zip(components, places, strict=True):
        component.coefficients[place.at, 0] = np.cumsum(steps[:, k : k + place.cols].ravel()) << low
        k += place.cols


def _read_dc(bits, components, codes, places, low) -> None:
    before = [0] * len(components)
    for mcu in zip(*(p.listed() for p in places), strict=True):
        for k, (component, blocks) in enumerate(zip(components, mcu, strict=True)):
            for block in blocks:
                before[k] += bits.signed(bits.symbol(codes[k]))
                component.coefficients[block, 0] = before[k] << low


def _refine_dc(bits, components, places, low) -> None:
    rows, width = places[0].rows, sum(p.cols for p in places)
    new = bits.bits[: width * rows].reshape(-1, width).astype(np.int16) << low
    k = 0
    for component, place in zip(components, places, strict=True):
        component.coefficients[place.at, 0] |= new[:, k : k + place.cols].ravel()
        k += place.cols


def _read_ac(bits, component, codes, place, first, last, low) -> None:
    if len(codes) == 1:
        ((length, _), symbol), = codes.items()
        each, n = length + symbol, last - first + 1
        if 0 < symbol < 16 and each <= 8:  # one code, one size: all at once
            if each == 8:
                value = np.frombuffer(bits.data, np.uint8, n * place.rows).astype(np.int16)
            else:
                value = np.packbits(bits.bits[: each * n * place.rows].reshape(-1, each), axis=1)[:, 0].astype(np.int16) >> (8 - each)
            value &= (1 << symbol) - 1
            value -= (value < 1 << (symbol - 1)) * np.int16((1 << symbol) - 1)
            value <<= low
            component.coefficients[place.at, first : last + 1] = value.reshape(-1, n)
            return
    run = 0
    for (block,) in place.listed():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                value = bits.signed(size)
                component.coefficients[block, k] = value << low if value >= 0 else -(-value << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros) - 1
                break


def _refine_ac(bits, component, codes, place, first, last, low) -> None:
    held = component.coefficients[place.at, first : last + 1]
    one = 1 << low
    if (held != 0).all():  # nothing can become non-zero: a code for each run of blocks, then plain bits
        n, done = last - first + 1, 0
        while done < place.rows:
            size = bits.symbol(codes) >> 4
            run = min((1 << size) + bits.take(size), place.rows - done)
            new = bits.bits[bits.at : bits.at + run * n].reshape(run, n).astype(np.int16)
            bits.at += run * n
            held[done : done + run] += np.sign(held[done : done + run]) * (new << low)
            done += run
        component.coefficients[place.at, first : last + 1] = held
        return

    def refine(block: int, k: int) -> None:
        if bits.take(1):
            component.coefficients[block, k] += one if component.coefficients[block, k] > 0 else -one

    run = 0
    for (block,) in place.listed():
        k = first
        while k <= last and not run:
            symbol = bits.symbol(codes)
            zeros, size = symbol >> 4, symbol & 15
            value = 0
            if size:
                value = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                if component.coefficients[block, k]:
                    refine(block, k)
                elif zeros == 0:
                    if value:
                        component.coefficients[block, k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for j in range(k, last + 1):
                if component.coefficients[block, j]:
                    refine(block, j)
            run -= 1


def to_rgb(image: Image) -> np.ndarray:
    """(height, width, 3) uint8: inverse transform, chroma repeated to full resolution, YCbCr to RGB."""
    h_max, v_max = image.most("h"), image.most("v")
    planes = []
    for c in image.components.values():
        samples = (c.coefficients * image.quant[c.quant]) @ BASIS + 128
        plane = samples.reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(8 * c.high, 8 * c.wide)
        planes.append(np.repeat(np.repeat(plane, v_max // c.v, 0), h_max // c.h, 1)[: image.height, : image.width].clip(0, 255))
    if len(planes) == 1:
        return np.repeat(planes[0].round().astype(np.uint8)[:, :, None], 3, 2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return rgb.clip(0, 255).round().astype(np.uint8)


def decode(data: bytes) -> tuple[bytes, np.ndarray]:
    """The payload that :func:`encode` stored, with its filler, and the RGB tensor."""
    image = decode_coefficients(data)
    parts = []
    for c in image.components.values():
        values = c.coefficients + 255 * (c.coefficients < 0)
        values[:, 0] = c.coefficients[:, 0] + 128
        parts.append(_in_mcus(values.astype(np.uint8), c.high // c.v, c.wide // c.h, c.h))
    return np.concatenate(parts, axis=1).tobytes(), to_rgb(image)


# ---- columns -------------------------------------------------------------------------------

_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_READ = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
    ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int64()), ("width", pa.int64()), ("rgb", pa.binary()),
])
_READ_DDL = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, height bigint, width bigint, rgb binary"


def store_texts(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_bytes, media): its UTF-8 bytes, with blanks up
    to a positive multiple of 192, as a progressive JPEG. A null text is empty; texts beyond
    4,095 MCUs go into more columns; rows are stored each, repeated or not; no rows give no
    rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, text in rows_of(batches):
                text = text or b""
                yield doc, len(text), encode(text + b" " * (-len(text) % UNIT if text else UNIT))

        return batched(rows(), _MEDIA, lambda row: len(row[2]))

    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def feature(rgb: np.ndarray) -> str:
    """The mean of each colour, and which of 64 equal parts of the picture's lines are lighter than the mean."""
    lines = rgb.sum(axis=(1, 2), dtype=np.int64)
    parts = np.add.reduceat(lines, np.arange(64) * len(lines) // 64) if len(lines) >= 64 else np.repeat(lines, -(-64 // len(lines)))[:64]
    lighter = np.packbits(parts * len(parts) > parts.sum()).tobytes().hex()
    means = (rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (rgb.shape[0] * rgb.shape[1])).tolist()
    return ",".join(f"{m / 100:.2f}" for m in means) + ":" + lighter


def read_media(media: DataFrame, with_rgb: bool = True) -> DataFrame:
    """Rows (doc_id, n_bytes, media) decoded: digests of the payload and the stored form, a feature,
    and (height, width, rgb) of the full-resolution tensor; rgb is null without ``with_rgb``.

    Null media, and media that break off or aren't such pictures, give nulls in all but doc_id,
    n_bytes and the size and digest of what is there. Repeated rows are read each; no rows give no rows.
    """

    def read(n: int | None, data: bytes) -> tuple:
        try:
            stored, rgb = decode(data)
        except (ValueError, IndexError, KeyError):  # not a whole picture
            return (None,) * 7
        payload = stored[: n + (-n % UNIT if n else UNIT)] if n is not None else stored
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), feature(rgb), rgb.shape[0], rgb.shape[1], rgb.tobytes() if with_rgb else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc, n, data in rows_of(batches):
                size, digest, crc, seen, height, width, rgb = read(n, data or b"")
                form = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                yield doc, n, size, digest, crc, *form, seen, height, width, rgb

        return batched(rows(), _READ, lambda row: 250 + len(row[-1] or b""))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ_DDL)

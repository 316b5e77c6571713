"""Operator 10, media columns: Netpbm and BMP images as numpy arrays, resized by integral images, cut into NPY tiles.

``encode_pgm``/``encode_ppm``/``encode_bmp`` and ``decode`` are exact inverses for 8-bit
samples. ``decode`` reads P1 to P6 (samples of up to 16 bits; black and white as 0 and 255; a greatest
value other than 255 or 65535 is scaled to it) and uncompressed BMP of 1, 4, 8, 16, 24 and 32 bits.
``area_resize`` averages each target cell over the exact (fractional)
source area by bilinear lookups in a summed-area table. ``difference_hash``
compares neighbours of a 9 x 8 reduction. ``media_tiles`` gives the NPY tiles of any media, each
with its hash; null media and media that can't be decoded give one row with nulls, an image without
samples one row too.

``text_media`` stores a text as an image and takes it through the same tiles: the samples it reports are
those that the tiles give back. The rule for the format: a payload of r rows of 64 bytes is an image of
64 columns; if r is a multiple of 3 in colour (24 bits), else grey (8 bits); if r is even as BMP, else as Netpbm.
Null and empty texts are 64 zero bytes; repeated rows give repeated rows; long texts have more tiles; an empty
table gives no rows, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, pieces, table

WIDTH = 64
TILE = 256
_GAP = rb"(?:\s|#[^\n]*\n)+"
_HEAD = re.compile(rb"(P[1-6])" + _GAP + rb"(\d{1,9})" + _GAP + rb"(\d{1,9})")
_MOST = re.compile(_GAP + rb"(\d{1,5})")


def encode_pgm(image: np.ndarray) -> bytes:
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette, or 24 bits (rows bottom up, padded to four bytes)."""
    grey = image.ndim == 2
    height, width = image.shape[:2]
    rows = image if grey else image[:, :, ::-1].reshape(height, width * 3)
    body = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))[::-1].astype(np.uint8).tobytes()
    palette = np.repeat(np.arange(256, dtype="<u4")[:, None], 1, 1).astype("<u4") * 0x010101 if grey else np.zeros(0, "<u4")
    start = 54 + palette.nbytes
    head = np.array([40, width, height], "<i4").tobytes() + np.array([1, 8 if grey else 24], "<u2").tobytes()
    head += np.array([0, len(body), 2835, 2835, 256 if grey else 0, 0], "<u4").tobytes()
    return b"BM" + np.array([start + len(body), 0, start], "<u4").tobytes() + head + palette.tobytes() + body


def decode(raw: bytes) -> np.ndarray:
    """A Netpbm (P1 to P6) or uncompressed BMP image, as [rows, columns] or [rows, columns, RGB]; anything else is a ValueError."""
    try:
        if raw[:2] == b"BM":
            return _bmp(raw)
        if m := _HEAD.match(raw):
            return _netpbm(raw, m[1], int(m[2]), int(m[3]), m.end())
    except (IndexError, OverflowError, MemoryError) as e:
        raise ValueError("broken image") from e
    raise ValueError("neither Netpbm nor BMP")


def _need(there: int, needed: int) -> None:
    if there < needed:
        raise ValueError("samples are missing")


def _netpbm(raw: bytes, kind: bytes, width: int, height: int, at: int) -> np.ndarray:
    bits, plain = kind in (b"P1", b"P4"), kind in (b"P1", b"P2", b"P3")
    most = 1
    if not bits:
        if not (m := _MOST.match(raw, at)) or not 0 < int(m[1]) < 65536:
            raise ValueError("no greatest value")
        most, at = int(m[1]), m.end()
    shape = (height, width, 3) if kind in (b"P3", b"P6") else (height, width)
    n = height * width * (3 if len(shape) == 3 else 1)
    if plain:
        words = re.findall(rb"[01]", raw[at:]) if bits else raw[at:].split()
        _need(len(words), n)
        got = np.array([int(x) for x in words[:n]], np.int64)
    elif bits:
        row = (width + 7) // 8
        _need(len(raw) - at - 1, row * height)
        got = np.unpackbits(np.frombuffer(raw, np.uint8, row * height, at + 1).reshape(height, row), axis=1)[:, :width].astype(np.int64)
    else:
        size = 1 if most < 256 else 2
        _need(len(raw) - at - 1, n * size)
        got = np.frombuffer(raw, ">u2" if size == 2 else np.uint8, n, at + 1)
        if most == 255:
            return got.reshape(shape)
        got = got.astype(np.int64)
    if n and not 0 <= got.min() <= got.max() <= most:
        raise ValueError("a sample is out of range")
    full = 65535 if most > 255 else 255
    got = ((1 - got) if bits else got).reshape(shape)
    return ((got * full + most // 2) // most).astype(np.uint16 if full > 255 else np.uint8)


def _bmp(raw: bytes) -> np.ndarray:
    _need(len(raw), 26)
    number = lambda at, size, signed=False: int.from_bytes(raw[at : at + size], "little", signed=signed)
    start, head = number(10, 4), number(14, 4)
    old = head == 12
    if not old and (head < 40 or len(raw) < 54):
        raise ValueError("unknown BMP header")
    width, height = (number(18, 2), number(20, 2)) if old else (number(18, 4, True), number(22, 4, True))
    bits, packed = (number(24, 2), 0) if old else (number(28, 2), number(30, 4))
    if width <= 0 or height == 0 or bits not in (1, 4, 8, 16, 24, 32) or packed not in (0, 3) or (packed and bits < 16) or start < 14 + head:
        raise ValueError("unsupported BMP")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    _need(len(raw) - start, stride * rows)
    body = np.frombuffer(raw, np.uint8, stride * rows, start).reshape(rows, stride)
    body = body[::-1] if height > 0 else body
    if bits == 24:
        return body[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1]
    if bits > 8:
        value = body[:, : width * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
        masks = [number(54 + 4 * k, 4) for k in range(3)] if packed else [0x7C00, 0x3E0, 0x1F] if bits == 16 else [0xFF0000, 0xFF00, 0xFF]
        if not all(masks):
            raise ValueError("an empty colour mask")
        low = [m & -m for m in masks]
        return np.stack([((value & m) // k * 255 + m // k // 2) // (m // k) for m, k in zip(masks, low)], axis=2).astype(np.uint8)
    index = body if bits == 8 else np.unpackbits(body, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))
    size = 3 if old else 4
    first = 14 + head
    used = min(2**bits, (start - first) // size)
    palette = np.frombuffer(raw, np.uint8, used * size, first).reshape(-1, size)[:, 2::-1]
    colour = palette[index[:, :width]]
    return np.ascontiguousarray(colour[:, :, 0]) if (palette[:, :1] == palette).all() else colour


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each target cell's source area, by a summed-area table read at fractional corners."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])
    y, x = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    iy, ix = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    fy, fx = (y - iy)[:, None], x - ix
    rows = total[iy] * (1 - fy) + total[iy + 1] * fy
    at = rows[:, ix] * (1 - fx) + rows[:, ix + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each cell of a 8 x 9 reduction is darker than its right neighbour."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def tiles(image: np.ndarray, side: int = TILE) -> Iterator[tuple[int, int, bytes]]:
    """Row, column and NPY bytes of each tile of side rows and columns; the last ones are smaller."""
    for top in range(0, image.shape[0], side):
        for left in range(0, image.shape[1], side):
            out = io.BytesIO()
            np.save(out, np.ascontiguousarray(image[top : top + side, left : left + side]), allow_pickle=False)
            yield top // side, left // side, out.getvalue()


def untiled(found: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The image that tiles() cut."""
    rows: dict[int, list[np.ndarray]] = {}
    for r, _, npy in found:
        rows.setdefault(r, []).append(np.load(io.BytesIO(npy), allow_pickle=False))
    return np.concatenate([np.concatenate(x, axis=1) for x in rows.values()])


def tiled(raw: bytes | None, side: int = TILE) -> list[tuple[int, int, bytes, str]] | None:
    """Row, column, NPY bytes and difference hash of each tile of an image; None for media that can't be decoded."""
    try:
        image = decode(raw) if raw is not None else None
    except ValueError:
        return None
    if image is None or not image.size:
        return None
    return [(r, c, npy, difference_hash(np.load(io.BytesIO(npy), allow_pickle=False))) for r, c, npy in tiles(image, side)]


def text_payload(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def text_image(payload: bytes) -> tuple[str, bytes]:
    """The payload as an image of 64 columns, and its format by the rule above."""
    samples = np.frombuffer(payload, np.uint8)
    rows = len(samples) // WIDTH
    colour, bmp = rows % 3 == 0, rows % 2 == 0
    image = samples.reshape(-1, WIDTH, 3) if colour else samples.reshape(-1, WIDTH)
    return ("bmp24" if colour else "bmp8", encode_bmp(image)) if bmp else ("ppm", encode_ppm(image)) if colour else ("pgm", encode_pgm(image))


TILE_SCHEMA = "media_id long, tile_row int, tile_col int, npy binary, dhash string"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles long, tiles_sha256 string"


def media_tiles(df: DataFrame, id_col: str = "media_id", media_col: str = "media", side: int = TILE) -> DataFrame:
    """One row for each tile of each image: its NPY bytes and difference hash; one row with nulls for media without tiles."""

    def run(batches):
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(key, *x) for x in tiled(raw, side) or [(None,) * 4]]
                for a in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[a : a + 64]), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()))], ["media_id", "tile_row", "tile_col", "npy", "dhash"])

    return df.select(df[id_col].cast("long").alias("media_id"), df[media_col].alias("media")).mapInArrow(run, TILE_SCHEMA)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes as an image, cut into NPY tiles and read back from them, with digests and the tiles' hashes."""

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for key, raw in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").cast(pa.large_binary()).to_pylist()):
                raw = raw or b""
                kind, media = text_image(text_payload(raw))
                found = tiled(media)
                image = untiled([x[:3] for x in found])
                back = image.tobytes()
                npy = hashlib.sha256()
                for x in found:
                    npy.update(x[2])
                feature = f"{kind};shape:{'x'.join(map(str, image.shape))};dhash:{'.'.join(x[3] for x in found)}"
                rows.append((key, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(found), npy.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [x.split()[0] for x in DIGEST_SCHEMA.split(", ")])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, DIGEST_SCHEMA)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))

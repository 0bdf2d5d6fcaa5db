"""Operator 9: media columns. Netpbm and BMP become numpy arrays, are resized by area with integral images
and written as NPY tiles with difference hashes.

The query stores each text's bytes as the samples of a 24-bit picture 64 pixels wide and reads them back.

Defined results: null text is empty; a payload has at least one row of pixels; a text of any length is one picture;
equal texts have equal values; bytes that are neither format, end early, or have a size or depth of nothing or beyond
the format raise ``ValueError`` in ``decode_media`` and give null columns in ``media_columns``; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.words import slices

WIDTH = 64
ROW = WIDTH * 3
TILE = (16, 16)

_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d{1,18})(?!\d)")


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """Binary graymap or pixmap (P5, P6) of 8-bit samples."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed 24-bit BMP, rows from the bottom, blue first."""
    h, w, _ = pixels.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + stride * h, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, stride * h, 2835, 2835, 0, 0) + rows.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[1] - ord("0"), 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        found = _FIELD.match(data, at)
        if not found:
            raise ValueError("a Netpbm header without its numbers")
        fields.append(int(found[1]))
        at = found.end()
    w, h = fields[:2]
    depth = fields[2] if len(fields) > 2 else 1
    planes = 3 if kind in (3, 6) else 1
    if w * h == 0 or w * h * planes > 8 * len(data) or not 0 < depth < 1 << 16:
        raise ValueError("a Netpbm header whose size or depth can't be")
    if kind == 1:
        flat = np.frombuffer(re.sub(rb"[^01]", b"", data[at:]), np.uint8) - ord("0")
    elif kind in (2, 3):
        flat = np.clip([int(x) for x in data[at:].split()[: w * h * planes]], 0, depth)
    elif kind == 4:
        raw = np.frombuffer(data, np.uint8, h * ((w + 7) // 8), at + 1).reshape(h, -1)
        flat = np.unpackbits(raw, axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if depth > 255 else np.uint8, w * h * planes, at + 1)
    if len(flat) < w * h * planes:
        raise ValueError("a Netpbm file that ends early")
    flat = flat[: w * h * planes]
    if kind in (1, 4):
        flat = (1 - flat) * 255
    elif depth != 255:
        flat = (flat.astype(np.int64) * 255 + depth // 2) // depth
    shape = (h, w, 3) if planes == 3 else (h, w)
    return flat.astype(np.uint8).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    (offset,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24, 32) or packing not in (0, 3) or w <= 0 or h == 0:
        raise ValueError("a BMP of a kind that isn't read")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), offset).reshape(abs(h), stride)[:, : w * bits // 8]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, (offset - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)
        return palette[rows][:, :, 2::-1].copy()
    return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()


def decode_media(data: bytes) -> np.ndarray:
    """Pixels as (height, width) or (height, width, 3) of 8-bit samples."""
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    if data[:2] == b"BM":
        return _decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target pixel, with fractions of pixels, from the integral image."""
    h, w = gray.shape
    integral = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])

    def at(edges: np.ndarray, table: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), table.shape[0] - 2)
        part = (edges - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    rows = at(np.linspace(0, h, height + 1), integral)
    both = at(np.linspace(0, w, width + 1), rows.T).T
    sums = both[1:, 1:] - both[:-1, 1:] - both[1:, :-1] + both[:-1, :-1]
    return sums * (height * width / (h * w))


def luminance(pixels: np.ndarray) -> np.ndarray:
    """Integer gray of (299 R + 587 G + 114 B) / 1000."""
    if pixels.ndim == 2:
        return pixels
    return (pixels.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000


def difference_hash(gray: np.ndarray) -> str:
    """64 bits in hex: whether each of 8 by 8 areas is brighter than the one to its left."""
    small = np.round(area_resize(gray, 8, 9), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(gray: np.ndarray) -> bytes:
    """The picture resized to a tile of 8-bit samples, as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(area_resize(gray, *TILE), 6)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def to_picture(payload: bytes) -> bytes:
    """A pixmap whose samples are the payload, which is a multiple of 192 bytes."""
    return encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3))


def media_columns(df: DataFrame, column: str, key: str) -> DataFrame:
    """Decode a binary column: ``(key, height, width, tile, dhash)``, null where it can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for data in b.column("data").to_pylist():
                try:
                    gray = luminance(decode_media(data or b""))
                    rows.append((*gray.shape, npy_tile(gray), difference_hash(gray)))
                except (ValueError, IndexError, OverflowError, struct.error):
                    rows.append((None,) * 4)
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]],
                ["key", "height", "width", "tile", "dhash"],
            )

    fields = StructType.fromDDL("height int, width int, tile binary, dhash string").fields
    plain = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("data"))
    return plain.mapInArrow(run, StructType([plain.schema["key"], *fields])).withColumnRenamed("key", key)


def text_media(docs: DataFrame) -> DataFrame:
    """Store the texts of ``docs(doc_id, text)`` as pictures and read them back.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    (difference hash, then the SHA-256 of the tile), media, tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for raw in b.column("text").cast(pa.binary()).to_pylist():
                raw = raw or b""
                media = to_picture(raw.ljust(max(1, -(-len(raw) // ROW)) * ROW, b" "))
                pixels = decode_media(media)
                gray, back = luminance(pixels), pixels.tobytes()
                tile = npy_tile(gray)
                rows.append(
                    (
                        len(raw),
                        len(back),
                        hashlib.sha256(back).hexdigest(),
                        zlib.crc32(back[-16:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"{difference_hash(gray)}-{hashlib.sha256(tile).hexdigest()}",
                        media,
                        tile,
                    )
                )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
            names = [x.split()[0] for x in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


_SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, media binary, tile binary"
)

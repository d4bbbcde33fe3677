"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images,
and written as NPY tiles with difference hashes.

Images are binary cells of a Parquet table (so small ones do not become small files).
Decoding knows P1-P6 and uncompressed 8-, 24- and 32-bit BMP. The area average of a tile
cell is a difference of the integral image at four corners, interpolated where a corner
falls inside a pixel; that is exact, at one pass over the pixels whatever the tile's size.

Defined results: null media gives null outputs; bytes that are no known image, or a damaged
one, give null outputs and the reason in ``error`` (null otherwise); an image of one row or column is resized like any other; equal
bytes give equal outputs; an empty table stays empty; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, pieces_by_bytes, small_batches, text_of

UNIT, WIDTH, TILE = 576, 24, 16


# ---------------------------------------------------------------- formats


def write_pnm(pixels: np.ndarray) -> bytes:
    """P5 for (rows, columns), P6 for (rows, columns, 3); 8-bit samples."""
    rows, columns = pixels.shape[:2]
    return b"P%d\n%d %d\n255\n" % (5 if pixels.ndim == 2 else 6, columns, rows) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def _pnm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    at, out = 2, []
    while len(out) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1  # one white space ends the header


def read_pnm(data: bytes) -> np.ndarray:
    kind = data[:2]
    (columns, rows, *top), at = _pnm_fields(data, 2 if kind in (b"P1", b"P4") else 3)
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P4":
        bits = np.frombuffer(data, np.uint8, rows * (-(-columns // 8)), at).reshape(rows, -1)
        return ((1 - np.unpackbits(bits, axis=1)[:, :columns]) * 255).astype(np.uint8)
    if kind in (b"P1", b"P2", b"P3"):
        body = data[at - 1 :]
        body = b" ".join(line.partition(b"#")[0] for line in body.split(b"\n"))
        flat = np.array([c - 48 for c in body if c in b"01"] if kind == b"P1" else body.split(), np.int64)[: rows * columns * depth]
        flat = (1 - flat) * 255 if kind == b"P1" else flat
    else:
        flat = np.frombuffer(data, ">u2" if top[0] > 255 else np.uint8, rows * columns * depth, at)
    if top and top[0] != 255:
        flat = (flat.astype(np.float64) * 255 / top[0] + 0.5).astype(np.uint8)
    return flat.astype(np.uint8).reshape((rows, columns, 3) if depth == 3 else (rows, columns))


def write_bmp(pixels: np.ndarray) -> bytes:
    """8-bit with a grey palette for (rows, columns), 24-bit for (rows, columns, 3)."""
    rows, columns = pixels.shape[:2]
    grey = pixels.ndim == 2
    line = -(-columns * (1 if grey else 3) // 4) * 4
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    body = np.zeros((rows, line), np.uint8)
    flat = pixels if grey else pixels[:, :, ::-1].reshape(rows, -1)
    body[:, : flat.shape[1]] = flat
    start = 54 + palette.size
    return b"BM" + struct.pack("<IHHI", start + body.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, columns, rows, 1, 8 if grey else 24, 0, body.size, 2835, 2835, 256 if grey else 0, 0) + palette.tobytes() + body[::-1].tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    (start,) = struct.unpack_from("<I", data, 10)
    head, columns, rows, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP with compression {packed} and {bits} bits is not supported")
    line = -(-columns * bits // 32) * 4
    body = np.frombuffer(data, np.uint8, abs(rows) * line, start).reshape(abs(rows), line)
    body = body[::-1] if rows > 0 else body
    if bits == 8:
        n = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, 4 * n, 14 + head).reshape(n, 4)[:, 2::-1]
        out = palette[body[:, :columns]]
        return out[:, :, 0].copy() if (palette == palette[:, :1]).all() else out
    return body[:, : columns * bits // 8].reshape(abs(rows), columns, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    if data[:2] == b"BM":
        return read_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return read_pnm(data)
    raise ValueError(f"neither Netpbm nor BMP: {data[:8]!r}")


# ---------------------------------------------------------------- features


def grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float64) if pixels.ndim == 2 else pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Means over equal areas, from the integral image."""
    total = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, 0), 1, out=total[1:, 1:])

    def cuts(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * (n / parts)
        low = np.minimum(at.astype(np.int64), n - 1)
        return low, at - low

    (y, fy), (x, fx) = cuts(image.shape[0], rows), cuts(image.shape[1], columns)
    lines = total[y] * (1 - fy)[:, None] + total[y + 1] * fy[:, None]
    corner = lines[:, x] * (1 - fx) + lines[:, x + 1] * fx
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums / (image.shape[0] * image.shape[1] / (rows * columns))


def difference_hash(image: np.ndarray) -> str:
    """64 bits: of 8 x 9 area means, which are larger than their right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


# ---------------------------------------------------------------- tables


def padded(text: bytes) -> np.ndarray:
    """The payload as rows of WIDTH samples: bytes 255 up to a positive multiple of UNIT."""
    n = max(1, -(-len(text) // UNIT)) * UNIT
    out = np.full(n, 255, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(-1, WIDTH)


def text_media(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes, media: each whole text stored losslessly as the samples of an image."""
    small_batches(docs.sparkSession)
    write = {"pgm": write_pnm, "bmp": write_bmp}[form]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_by_bytes(batches, "t"):
            raw = [x.encode() for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write(padded(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(F.col(text)).alias("t")).mapInArrow(work, "doc_id bigint, n_bytes bigint, media binary")


def tiles(media: DataFrame, size: int = TILE) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with what is read back: payload length and SHA-256,
    CRC-32 of its last 32 samples, the stored form's length and SHA-256, the difference
    hash, an NPY tile and, for what cannot be decoded, the error."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile", "error"]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 8
        try:
            pixels = decode(data)
            if not pixels.size:
                raise ValueError("an image without pixels")
        except (ValueError, IndexError, struct.error) as e:
            return (*(None,) * 3, len(data), hashlib.sha256(data).hexdigest(), None, None, str(e) or type(e).__name__)
        raw, image = pixels.tobytes(), grey(pixels)
        small = np.clip(np.round(area_resize(image, size, size)), 0, 255).astype(np.uint8)
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy(small), None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces_by_bytes(batches, "media"):
            rows = [one(x) for x in part.column(2).to_pylist()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(work, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, tile binary, error string")


def media_features(docs: DataFrame, **how) -> DataFrame:
    """Store, read back, decode, resize, hash; the tile table is written too."""
    return materialise(tiles(materialise(text_media(docs, **how), "media")), "media-tiles")

"""Media columns: Netpbm and BMP images, area resizing, NPY tiles, difference hashes.

Images are 8-bit numpy arrays of (height, width, channels). ``resize`` averages
each target cell's exact area from a summed-area table; a tile is such a
resized image in NPY form; the difference hash compares neighbours in a 9 x 8
grey tile. Everything works on one row at a time with memory in proportion to
that row, so rows can be dealt in any way and recomputed.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import payloads, slices

UNIT = 576
WIDTH = 24
FORMATS = ("pgm", "ppm", "bmp")


# -- codecs ---------------------------------------------------------------


def encode_pnm(image: np.ndarray) -> bytes:
    """Binary PGM for one channel, PPM for three."""
    h, w, c = image.shape
    return b"P%d\n%d %d\n255\n" % (5 if c == 1 else 6, w, h) + image.tobytes()


_PNM = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
_MAX = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def decode_pnm(data: bytes) -> np.ndarray:
    """P1 to P6, comments included; samples of any maximum are scaled to 255."""
    head = _PNM.match(data)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, w, h = (int(x) for x in head.groups())
    at, most, channels = head.end(), 1, 3 if kind in (3, 6) else 1
    if kind in (2, 3, 5, 6):
        top = _MAX.match(data, at)
        if not top:
            raise ValueError("Netpbm image without a maximum")
        most, at = int(top[1]), top.end()
    n = w * h * channels
    if kind == 4:
        row = (w + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row)
        out = 1 - np.unpackbits(bits, axis=1)[:, :w]
    elif kind == 1:
        out = 1 - np.array(re.findall(rb"[01]", data[at:])[:n], dtype=np.uint8)
    elif kind in (2, 3):
        out = np.array(data[at:].split()[:n], dtype=np.int64)
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if most != 255:
        out = (out.astype(np.int64) * 255 + most // 2) // most
    return out.astype(np.uint8, copy=False).reshape(h, w, channels)


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP; grey images are written as three equal channels."""
    image = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image
    h, w, _ = image.shape
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + body.size, 0, 0, 54, 40, w, h, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, bottom-up or top-down."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h, _, bits, packed = struct.unpack_from("<I4xI", data, 10)[:1] + struct.unpack_from("<IiiHHI", data, 14)
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits, compression {packed}, is not supported")
    row = (w * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, row * abs(h), start).reshape(abs(h), row)[:, : w * bits // 8]
    body = body if h < 0 else body[::-1]
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)
        return palette[body][:, :, 2::-1]
    return np.ascontiguousarray(body.reshape(abs(h), w, bits // 8)[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_pnm(data)


# -- features -------------------------------------------------------------


BAND = 16_384


def _integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rows ``wanted`` (rising) of the image's summed-area table, exact, as (rows, width + 1, channels).

    Row r holds the sums over image rows before r. The image is summed in bands
    of ``BAND`` rows, so no table of the image's size is held.
    """
    h, w, c = image.shape
    out, before = np.zeros((len(wanted), w + 1, c), np.int64), np.zeros((w, c), np.int64)
    for at in range(0, h, BAND):
        sums = np.cumsum(image[at : at + BAND], axis=0, dtype=np.int64)
        here = slice(*np.searchsorted(wanted, [at + 1, at + len(sums) + 1]))
        out[here, 1:] = before + sums[wanted[here] - at - 1]
        before = before + sums[-1]
    return np.cumsum(out, axis=1)


def area_means(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, edges that cut a pixel included, from the summed-area table."""
    h, w, c = image.shape

    def cut(axis_len: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(parts + 1) * axis_len / parts
        low = np.minimum(edge.astype(np.int64), axis_len - 1)
        return low, edge - low

    low, part = cut(h, height)
    wanted, place = np.unique(np.r_[low, low + 1], return_inverse=True)
    table = _integral_rows(image, wanted)[place]
    rows = table[: height + 1] * (1 - part)[:, None, None] + table[height + 1 :] * part[:, None, None]
    low, part = cut(w, width)
    sums = rows[:, low] * (1 - part)[None, :, None] + rows[:, low + 1] * part[None, :, None]
    return np.diff(np.diff(sums, axis=0), axis=1) * (height * width / (h * w))


def _rounded(means: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.clip(np.floor(means + 0.5 + 1e-9), 0, 255), np.uint8)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means, rounded half up to 8 bits."""
    return _rounded(area_means(image, height, width))


def npy_tile(image: np.ndarray, height: int = 16, width: int = 16) -> bytes:
    out = io.BytesIO()
    np.save(out, resize(image, height, width), allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether a cell of the 8 x 9 grey tile is brighter than its left neighbour."""
    small = _rounded(area_means(image, 8, 9).mean(axis=2))
    return int.from_bytes(np.packbits(small[:, 1:] > small[:, :-1]).tobytes(), "big")


# -- texts as media -------------------------------------------------------


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text + b"\xff" * (-len(text) % unit if text else unit)


def store(payload: bytes) -> bytes:
    """The payload's samples as an image 24 pixels wide; the format follows from its checksum."""
    kind = FORMATS[zlib.crc32(payload) % len(FORMATS)]
    channels = 1 if kind == "pgm" else 3
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, channels)
    return encode_bmp(image) if kind == "bmp" else encode_pnm(image)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``media`` (binary).

    A text's UTF-8 bytes (null: empty), filled up with 255 to a positive
    multiple of 576, become an image's samples without loss. Repeated rows are
    stored one by one; an empty table gives no row; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = payloads(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([store(padded(x)) for x in texts], pa.binary())], ["id", "n_bytes", "media"])

    return _mapped(docs, id_col, text_col, run, "n_bytes long, media binary")


def described(media: bytes) -> tuple:
    """(payload, tile, difference hash) of stored media, decoded again."""
    image = decode(media)
    return image.tobytes(), npy_tile(image), difference_hash(image)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiles: bool = False) -> DataFrame:
    """Store every text as media, read the media again and describe it; one row per input row.

    Equal texts have equal values whatever their ids; null is the empty text;
    repeated rows are described one by one; an empty table gives no row; other
    columns are ignored. A very long text takes some copies of its bytes, one
    text at a time. ``tiles`` adds the NPY tile itself as a binary column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in payloads(batch.column(1)):
                media = store(padded(text))
                payload, tile, dhash = described(media)
                row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{dhash:016x}:{hashlib.sha256(tile).hexdigest()[:16]}")
                rows.append((*row, tile) if tiles else row)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 7 + tiles]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["tile"] * tiles]
    return _mapped(docs, id_col, text_col, run, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", tile binary" * tiles)


def _mapped(docs: DataFrame, id_col: str, text_col: str, run, schema: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)

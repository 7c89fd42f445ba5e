"""Media columns: Netpbm and BMP in NumPy, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK, TILE, WHOLE = 64, 16, 1 << 18
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


class MediaError(ValueError):
    """Bytes that are no whole image of a supported kind."""


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 (maxval up to 65535) as an array (height, width) or (height, width, 3); P1 and P4: 1 is black, as 0."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise MediaError("no Netpbm magic number")
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m or not m[1].isdigit():
            raise MediaError("broken Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3]
    planes = 3 if kind in (b"P3", b"P6") else 1
    if not 0 < top < 65536 or w < 1 or h < 1:
        raise MediaError("maxval or size out of range")
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = [c - 48 for c in body if c in b"01"] if kind == b"P1" else list(map(int, body.split()))
        if values and not 0 <= min(values) <= max(values) <= top:
            raise MediaError("a sample beyond the maxval")
        flat = np.array(values[: w * h * planes], dtype=np.uint16 if top > 255 else np.uint8)
    elif kind == b"P4":
        row = -(-w // 8)
        bits = np.frombuffer(data, np.uint8, offset=at + 1)
        if len(bits) < row * h:
            raise MediaError("too few samples")
        flat = np.unpackbits(bits[: row * h].reshape(h, row), axis=1)[:, :w].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", offset=at + 1)[: w * h * planes]
    if len(flat) < w * h * planes:
        raise MediaError("too few samples")
    if kind in (b"P1", b"P4"):
        flat = (1 - flat).astype(np.uint8)
    return flat.reshape((h, w, 3) if planes == 3 else (h, w))


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6 with 8-bit samples."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or image.ndim == 3 and image.shape[2] != 3:
        raise MediaError("8-bit grey or RGB samples are needed")
    return b"P%d\n%d %d\n255\n" % (5 if image.ndim == 2 else 6, image.shape[1], image.shape[0]) + image.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel, bottom-up or top-down; a grey palette gives (height, width)."""
    if len(data) < 54 or data[:2] != b"BM":
        raise MediaError("no BMP header")
    start, size, w, h, _, bits, packed, *_, colours, _ = struct.unpack_from("<I I i i H H I I i i I I", data, 10)
    down, h = h < 0, abs(h)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or h <= 0 or start > len(data):
        raise MediaError("unsupported BMP")
    stride = (w * bits + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, offset=start)
    if len(raw) < stride * h:
        raise MediaError("too few samples")
    rows = raw[: stride * h].reshape(h, stride)
    rows = rows if down else rows[::-1]
    if bits >= 24:
        return rows[:, : w * (bits // 8)].reshape(h, w, bits // 8)[:, :, 2::-1].copy()
    index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(h, -1)
    colours = colours or 1 << bits
    if size < 0 or not 0 < colours <= 1 << bits or 14 + size + 4 * colours > len(data):
        raise MediaError("broken palette")
    palette = np.frombuffer(data, np.uint8, count=4 * colours, offset=14 + size).reshape(-1, 4)[:, 2::-1]
    if index[:, :w].max() >= colours:
        raise MediaError("a pixel beyond the palette")
    grey = (palette == palette[:, :1]).all()
    return palette[:, 0][index[:, :w]] if grey else palette[index[:, :w]]


_GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
_GREY[:, 3] = 0
_GREY_PALETTE = _GREY.tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey palette or 24-bit BMP, bottom-up."""
    h, w = image.shape[:2]
    bits = 8 if image.ndim == 2 else 24
    stride = (w * bits + 31) // 32 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * bits // 8] = image[::-1] if bits == 8 else image[::-1, :, ::-1].reshape(h, -1)
    palette = _GREY_PALETTE if bits == 8 else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, w, h, 1, bits, 0, rows.size, 2835, 2835, 256 if bits == 8 else 0, 0)
    return head + palette + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def luma(image: np.ndarray) -> np.ndarray:
    """Grey values as float64 (BT.601 weights for RGB)."""
    return image.astype(np.float64) if image.ndim == 2 else image[:, :, :3] @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the exact areas (fractions of pixels included) of a height x width grid: the integral
    image is read between its points by linear interpolation, which is exact for areas.

    Of images of more than ``WHOLE`` pixels only the rows of the integral image that the grid touches are kept; pixels become floats a block of rows at a time.
    """
    h, w = image.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    y0, x0 = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    if h * w <= WHOLE:
        kept, low, high = np.zeros((h + 1, w + 1)), y0, y0 + 1
        np.cumsum(np.cumsum(luma(image), axis=0), axis=1, out=kept[1:, 1:])
    else:
        rows = np.unique([y0, y0 + 1])
        kept, so_far, done, step = np.zeros((len(rows), w + 1)), np.zeros(w), 0, max(1, WHOLE // w)
        for k, row in enumerate(rows):
            while done < row:
                end = min(row, done + step)
                so_far += luma(image[done:end]).sum(axis=0)
                done = end
            np.cumsum(so_far, out=kept[k, 1:])
        low, high = np.searchsorted(rows, y0), np.searchsorted(rows, y0 + 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    at_y = kept[low] * (1 - fy) + kept[high] * fy
    at = at_y[:, x0] * (1 - fx) + at_y[:, x0 + 1] * fx
    return np.diff(np.diff(at, axis=0), axis=1) / (h * w / (height * width))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each cell of an 8 x 9 area-resized grid is darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """An area-resized uint8 tile in NPY format 1.0."""
    out = io.BytesIO()
    np.lib.format.write_array(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), version=(1, 0))
    return out.getvalue()


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of ``BLOCK``."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def as_image(data: bytes) -> np.ndarray:
    """Samples in rows of 64: grey, or RGB where the payload is a multiple of 192 bytes."""
    flat = np.frombuffer(data, np.uint8)
    return flat.reshape(-1, 64, 3) if len(data) % 192 == 0 else flat.reshape(-1, 64)


def encode_text(text: str | None) -> bytes:
    """The stored form: BMP where the payload's checksum is odd, else Netpbm."""
    data = payload(text)
    image = as_image(data)
    return encode_bmp(image) if zlib.crc32(data) & 1 else encode_netpbm(image)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each whole text as an image file of 8-bit samples.

    Narrow: no shuffle, a batch of Arrow rows at a time. Null texts are stored like empty ones (64 zeros);
    equal texts give equal files; repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((x or "").encode()) for x in texts], pa.int64()), pa.array(map(encode_text, texts), pa.binary())],
                    names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "width int, height int, channels int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash long, tile binary, error string"


def media_features(media: DataFrame, data_col: str = "media") -> DataFrame:
    """The input's other columns, then what decoding its image bytes gives: size, sample digest, difference hash, NPY tile.

    Null or undecodable bytes give null features and a reason in ``error``; they never fail the job.
    """
    keep = [c for c in media.columns if c != data_col]
    slim = media.select(*keep, data_col)
    kinds = [pa.int32()] * 3 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [*keep, *[x.split()[0] for x in FEATURES.split(", ")]]

    def one(data: bytes | None) -> tuple:
        try:
            image = decode(data or b"")
        except (ValueError, OverflowError, struct.error) as e:
            return (None,) * 10 + (str(e),)
        raw = image.tobytes()
        dhash = difference_hash(image)
        return (image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]),
                len(data), hashlib.sha256(data).hexdigest(), dhash - (1 << 64) if dhash >> 63 else dhash, npy_tile(image), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = list(zip(*(one(x.as_py()) for x in part.column(len(keep)))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, rows, kinds)], names=names)

    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{schema}, {FEATURES}")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(store_media(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(":", F.lpad(F.lower(F.hex("dhash")), 16, "0"), F.col("width").cast("string"), F.col("height").cast("string"), F.sha2("tile", 256))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))

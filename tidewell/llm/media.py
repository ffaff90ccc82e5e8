"""Media columns: Netpbm and BMP codecs, area resizing by integral images, NPY tiles, difference hashes.

``encode_bytes`` keeps arbitrary payloads losslessly as an 8-bit PGM, ``media_features`` decodes a
column of stored images and adds tile and hash. Rows are independent: no shuffle, and one image at
a time is held in memory.
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
from pyspark.sql.types import StructType

UNIT = 576  #: payloads are padded to a positive multiple of this
WIDTH = 24
HASH_ROWS, HASH_COLS = 8, 9

_HEAD = re.compile(rb"P([1-6])")


class MediaError(ValueError):
    """The bytes are not an image of a supported kind."""


def _netpbm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    """``n`` decimal header fields after the magic, and the offset of the byte after the blank that
    ends them. Comments run from # to the end of the line."""
    out, i = [], 2
    while len(out) < n:
        while i < len(data) and (data[i : i + 1].isspace() or data[i : i + 1] == b"#"):
            if data[i : i + 1] == b"#":
                while i < len(data) and data[i] not in b"\r\n":
                    i += 1
            else:
                i += 1
        start = i
        while i < len(data) and data[i : i + 1].isdigit():
            i += 1
        if start == i:
            raise MediaError("bad Netpbm header")
        out.append(int(data[start:i]))
    return out, i + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (h, w) or (h, w, 3) samples; 16-bit samples stay big-endian values as uint16."""
    if not _HEAD.match(data):
        raise MediaError("not Netpbm")
    kind = data[1] - 48
    bitmap, colour = kind in (1, 4), kind in (3, 6)
    fields, at = _netpbm_fields(data, 2 if bitmap else 3)
    w, h = fields[:2]
    top = 1 if bitmap else fields[2]
    if not 0 < top < 65536 or w <= 0 or h <= 0:
        raise MediaError("bad Netpbm size or maximum")
    shape = (h, w, 3) if colour else (h, w)
    count = int(np.prod(shape))
    if kind == 1:
        bits = re.sub(rb"#[^\r\n]*|\s+", b"", data[at - 1 :])[:count]
        if len(bits) < count:
            raise MediaError("short image")
        return (1 - (np.frombuffer(bits, np.uint8) - 48)).reshape(shape).astype(np.uint8) * np.uint8(255)
    if kind in (2, 3):
        values = re.sub(rb"#[^\r\n]*", b"", data[at - 1 :]).split()[:count]
        if len(values) < count:
            raise MediaError("short image")
        return np.array(values, dtype=np.int64).reshape(shape).astype(np.uint8 if top < 256 else np.uint16)
    if kind == 4:
        stride = (w + 7) // 8
        if len(data) - at < stride * h:
            raise MediaError("short image")
        rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)
        return (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    kind_of = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    if len(data) - at < count * kind_of.itemsize:
        raise MediaError("short image")
    out = np.frombuffer(data, kind_of, count, at).reshape(shape)
    return out if top < 256 else out.astype(np.uint16)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits a pixel as (h, w) grey or (h, w, 3) RGB."""
    if len(data) < 30 or data[:2] != b"BM":
        raise MediaError("not BMP")
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        w, h, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing, used, entry = 0, 0, 3
    else:
        if len(data) < 54:
            raise MediaError("short BMP header")
        w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        used, entry = struct.unpack_from("<I", data, 46)[0], 4
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise MediaError("unsupported BMP")
    rows, stride = abs(h), (w * bits + 31) // 32 * 4
    if len(data) < start + stride * rows:
        raise MediaError("short image")
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw if h < 0 else raw[::-1]
    if bits >= 24:
        return raw[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1].copy()
    n = used or 1 << bits
    if len(data) < 14 + head + n * entry:
        raise MediaError("short palette")
    palette = np.frombuffer(data, np.uint8, n * entry, 14 + head).reshape(n, entry)[:, 2::-1]
    if bits == 8:
        index = raw[:, :w]
    else:
        flat = np.unpackbits(raw, axis=1).reshape(rows, -1, bits)
        index = (flat * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)[:, :w]
    if index.max(initial=0) >= n:
        raise MediaError("palette index out of range")
    rgb = palette[index]
    return rgb[:, :, 0].copy() if (palette[:, :1] == palette).all() else rgb


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey BMP, rows bottom-up and padded to four bytes."""
    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    grey = np.arange(256, dtype=np.uint8)
    palette = np.stack([grey, grey, grey, np.zeros(256, np.uint8)], axis=1).tobytes()
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", at + rows.size, 0, 0, at, 40, w, h, 1, 8, 0, rows.size, 0, 0, 256, 0) + palette + rows.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of colour images; grey ones unchanged."""
    if image.ndim == 2:
        return image
    return (image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32)) // 1000


def area_resize(image: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over each target cell's exact area, by an integral image with linear interpolation at
    fractional borders; works for shrinking and enlarging alike."""
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def cut(table: np.ndarray, n: int, size: int) -> np.ndarray:
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(np.int64), size - 1)
        part = (at - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    grid = cut(cut(total, rows, h).T, cols, w).T
    cell = grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]
    return cell / (h / rows * (w / cols))


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: is each cell of an 8 x 9 area-resized image darker than its right neighbour."""
    cells = np.round(area_resize(grey(image), HASH_ROWS, HASH_COLS), 6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def encode_bytes(df: DataFrame, payload: str, keep: list[str], fmt: str = "pgm") -> DataFrame:
    """``keep`` plus n_bytes and media: each payload (binary; null is empty) padded with 255 to a
    positive multiple of 576 and stored as an 8-bit image 24 samples wide (pgm or bmp)."""
    make = {"pgm": encode_pgm, "bmp": encode_bmp}[fmt]
    schema = df.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for x in b.column("_payload"):
                raw = x.as_py() or b""
                size = max(1, -(-len(raw) // UNIT)) * UNIT
                sizes.append(len(raw))
                media.append(make(np.frombuffer(raw.ljust(size, b"\xff"), np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return df.select(*keep, F.col(payload).alias("_payload")).mapInArrow(run, schema)


def media_features(df: DataFrame, media: str = "media", tile: int = 32) -> DataFrame:
    """Every column of ``df`` plus what decoding its stored images gives.

    Added: width, height, channels, samples (the decoded samples in row order, as binary), tile (NPY
    bytes of the grey image area-resized to ``tile`` x ``tile``), dhash, media_error. A null or
    undecodable image gives nulls and a reason in media_error; equal images give equal values.
    """
    schema = StructType(list(df.schema.fields))
    for name, kind in (("width", "integer"), ("height", "integer"), ("channels", "integer"), ("samples", "binary"), ("tile", "binary"), ("dhash", "string"), ("media_error", "string")):
        schema = schema.add(name, kind)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(names.index(media)):
                data = x.as_py()
                try:
                    if data is None:
                        raise MediaError("null")
                    image = decode(data)
                    small = np.round(area_resize(grey(image), tile, tile)).astype(np.uint8)
                    order = image.astype(">u2") if image.dtype == np.uint16 else image
                    rows.append((image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, order.tobytes(), npy_bytes(small), difference_hash(image), None))
                except MediaError as e:
                    rows.append((None,) * 6 + (str(e),))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string())
            more = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names)

    return df.mapInArrow(run, schema)


def stored_texts(documents: DataFrame, fmt: str = "pgm") -> DataFrame:
    """Each text as a stored image and back: doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.

    Null texts count as empty (one unit of padding); repeated rows each give a row; a null doc_id
    is kept. Other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    stored = encode_bytes(docs, "payload", ["doc_id"], fmt)
    tail = F.expr("substring(samples, octet_length(samples) - 31, 32)")
    return media_features(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("bigint").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.col("dhash"), F.substring(F.sha2("tile", 256), 1, 16)).alias("feature"),
    )

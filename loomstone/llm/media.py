"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, map_text, slices

ROW = 64  # samples in a row of a payload image; payloads are padded to whole rows


def write_pgm(image: np.ndarray) -> bytes:
    """Binary greymap (P5), 8 bits a sample."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def write_ppm(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def write_bmp(image: np.ndarray) -> bytes:
    """8-bit grey (with palette) or 24-bit BMP, rows bottom-up, padded to four bytes."""
    grey = image.ndim == 2
    h, w = image.shape[:2]
    body = image if grey else image[:, :, ::-1]
    rows = np.zeros((h, (w * (1 if grey else 3) + 3) // 4 * 4), np.uint8)
    rows[:, : w * (1 if grey else 3)] = body[::-1].reshape(h, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) if grey else np.zeros((0, 4), np.uint8)
    if grey:
        palette[:, 3] = 0
    at = 54 + palette.size
    u = lambda n, x: int(x).to_bytes(n, "little", signed=True)
    head = b"BM" + u(4, at + rows.size) + bytes(4) + u(4, at) + u(4, 40) + u(4, w) + u(4, h) + u(2, 1) + u(2, 8 if grey else 24) + u(4, 0) + u(4, rows.size) + u(4, 2835) * 2 + u(4, 256 if grey else 0) + u(4, 0)
    return head + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, found = int(data[1:2]), 2, []
    need = 2 if kind in (1, 4) else 3
    while len(found) < need:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[at:end]))
        at = end
    w, h = found[:2]
    top = found[2] if need == 3 else 1
    depth = 3 if kind in (3, 6) else 1
    if not 0 < top < 65536 or not 0 < w * h * depth <= 8 * len(data):
        raise ValueError("bad Netpbm size or maximum")
    if kind == 4:
        line = (w + 7) // 8
        out = 1 - np.unpackbits(np.frombuffer(data, np.uint8, h * line, at + 1).reshape(h, line), axis=1)[:, :w]
        out = out * np.uint8(255)
    elif kind in (5, 6):
        out = np.frombuffer(data, np.dtype(">u2") if top > 255 else np.uint8, h * w * depth, at + 1)
    else:
        body = b"\n".join(x.split(b"#")[0] for x in data[at:].split(b"\n"))
        out = np.array([255 * (c == 48) for c in body if c in b"01"] if kind == 1 else [int(x) for x in body.split()[: h * w * depth]])[: h * w * depth]
    if kind not in (1, 4) and top != 255 or kind == 3 or kind == 2:
        if out.min() < 0 or out.max() > top:
            raise ValueError("a sample is above the maximum")
        out = (out.astype(np.int64) * 255 + top // 2) // top
    out = np.asarray(out).astype(np.uint8, copy=False)
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    n = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=True)
    at, head, w, h, bits, packed = n(10), n(14), n(18), n(22), n(28, 2), n(30)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("this kind of BMP is not supported")
    line = (w * bits + 31) // 32 * 4
    if abs(h) * line > len(data):
        raise ValueError("the BMP is cut")
    rows = np.frombuffer(data, np.uint8, abs(h) * line, at).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if packed == 3:
        if bits != 32 or [n(54 + 4 * k) & 0xFFFFFFFF for k in range(3)] != [0xFF0000, 0xFF00, 0xFF]:
            raise ValueError("only the usual bit fields are supported")
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], 2).reshape(abs(h), -1)
    palette = np.frombuffer(data, np.uint8, (n(46) or 1 << bits) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    rgb = palette[index[:, :w]]
    return rgb[:, :, 0] if (palette == palette[:, :1]).all() else rgb


def decode(data: bytes | None) -> np.ndarray | None:
    """uint8 array (h, w) or (h, w, 3) of a P1-P6 or BMP file; None for anything that is not a whole image: cut or empty ones, samples
    above the maximum, BMP with other bit fields than blue, green, red, unused."""
    try:
        if data and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        if data and data[:2] == b"BM":
            return _bmp(data)
    except (ValueError, IndexError, OverflowError):
        pass
    return None


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each output sample, from an integral image read (linearly) at fractional borders."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, k], height, width) for k in range(image.shape[2])], 2)
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.float64), 1, out=total[1:, 1:])

    def at(table, n, size):
        x = np.arange(size + 1) * (n / size)
        low = np.minimum(x.astype(np.int64), n - 1)
        part = (x - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    cut = at(at(total, h, height).T, w, width).T
    return np.diff(np.diff(cut, axis=0), axis=1) / ((h / height) * (w / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each of 8 x 9 area means is below its right neighbour."""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = area_resize(grey, 8, 9)
    return np.packbits(small[:, :-1] + 1e-9 < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 16) -> bytes:
    """side x side uint8 tile in NPY format."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).clip(0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def payload_image(text: str) -> tuple[np.ndarray, int]:
    raw = text.encode()
    size = max(1, -(-len(raw) // ROW)) * ROW
    return np.frombuffer(raw.ljust(size, b"\0"), np.uint8).reshape(-1, ROW), len(raw)


WRITERS = {"pgm": write_pgm, "bmp": write_bmp}


def text_media(docs: DataFrame, form: str = "pgm", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (the stored image file), a lossless picture of the text's bytes, 64 samples a row.

    Null text: empty, one row of zeros. Repeated rows and null ids each give a row.
    """

    def fn(texts):
        made = [payload_image(t) for t in texts]
        return [[n for _, n in made], [WRITERS[form](x) for x, _ in made]]

    return map_text(docs, text_col, fn, [("n_bytes", "bigint"), ("media", "binary")], [id_col], rows=128)


def media_features(media: DataFrame, keep: list[str], media_col: str = "media", side: int = 16) -> DataFrame:
    """keep columns plus width, height, payload (decoded samples), tile (NPY), dhash. Media that do not decode: nulls."""
    source = media.select(*keep, media_col)
    schema = T.StructType([source.schema[c] for c in keep])
    for name, kind in (("width", "int"), ("height", "int"), ("payload", "binary"), ("tile", "binary"), ("dhash", "string")):
        schema = schema.add(name, T.DataType.fromDDL(kind))
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, 128):
                images = [decode(x) for x in part.column(part.num_columns - 1).to_pylist()]
                got = [(None,) * 5 if x is None else (x.shape[1], x.shape[0], x.tobytes(), npy_tile(x, side), difference_hash(x)) for x in images]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], names=names)

    return arrow_map(source, run, schema)


def media_digests(docs: DataFrame, form: str = "pgm", side: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, tile (NPY).

    Null text: empty, one row of zeros. Repeated rows and null ids each give a row. Stores each text as an image file, decodes that file again and describes what was read: feature is the difference hash, the
    size of the image and the CRC of its NPY tile. One pass, no shuffle; at most 128 images at a time are in a task.
    """

    def fn(texts):
        out = []
        for t in texts:
            image, n = payload_image(t)
            stored = WRITERS[form](image)
            read = decode(stored)
            back = read.tobytes()
            tile = npy_tile(read, side)
            feature = f"{difference_hash(read)}-{read.shape[1]}x{read.shape[0]}-{zlib.crc32(tile):08x}"
            out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tile))
        return [list(x) for x in zip(*out)]

    fields = [("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"), ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("feature", "string"), ("tile", "binary")]
    return map_text(docs, text_col, fn, fields, [id_col], rows=128)

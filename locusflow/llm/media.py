"""Media columns: lossless 8-bit PNG images in binary columns, and low-frequency cosine-transform hashes of them.

The writer makes greyscale PNG files (signature, IHDR, IDAT, IEND; every chunk with its CRC-32, the data as one
zlib stream). The reader tests signature, chunk checksums and zlib's own checksum, then undoes the row filters
with numpy: whole runs of rows at once for the filters None, Sub and Up, pixel by pixel only for Average and Paeth.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.common import arrow_map, utf8
from locusflow.session import prepare

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Side of the reduced image, and of the square of low frequencies that the hash keeps.
SIDE, LOW = 32, 8


class BadMedia(ValueError):
    """The stored bytes are not a PNG that this reader can give back whole."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 5) -> bytes:
    """A greyscale PNG whose samples are ``payload``; its length must be a positive multiple of ``width``."""
    if not payload or len(payload) % width:
        raise ValueError(f"{len(payload)} bytes do not fill rows of {width}")
    img = np.frombuffer(payload, np.uint8).reshape(-1, width)
    forms = np.stack([img, np.diff(img, axis=1, prepend=np.uint8(0)), np.diff(img, axis=0, prepend=np.zeros((1, width), np.uint8))])
    # the usual rule: per row the filter with the least sum of absolute signed differences; None counts by its distance from the row's mean
    cost = np.abs(forms[1:].view(np.int8).astype(np.int16)).sum(2)
    plain = np.abs(img - img.mean(1, keepdims=True)).sum(1)
    kind = np.argmin(np.vstack([plain[None], cost]), axis=0).astype(np.uint8)
    rows = np.empty((len(img), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = forms[kind, np.arange(len(img))]
    head = struct.pack(">IIBBBBB", width, len(img), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _sequential(kind: int, row: np.ndarray, prior: np.ndarray, bpp: int) -> np.ndarray:
    out, up, raw = [0] * bpp, [0] * bpp + prior.tolist(), row.tolist()
    for i, x in enumerate(raw):
        a, b, c = out[i], up[i + bpp], up[i]
        if kind == 3:
            p = (a + b) >> 1
        else:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out.append((x + p) & 255)
    return np.array(out[bpp:], np.uint8)


def unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int = 1) -> np.ndarray:
    """The samples of filtered ``rows`` (height x stride bytes); ``bpp`` bytes a pixel."""
    out = rows.copy()
    if kinds.max(initial=0) > 4:
        raise BadMedia("unknown row filter")
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(rows[sub].reshape(sub.sum(), -1, bpp), axis=1, dtype=np.uint8).reshape(sub.sum(), -1)
    cuts = np.flatnonzero(np.diff(kinds.astype(np.int16), prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(kinds)], strict=True):
        if kinds[lo] == 2:
            run = out[lo:hi]
            if lo:
                run[0] += out[lo - 1]
            np.cumsum(run, axis=0, dtype=np.uint8, out=run)
        elif kinds[lo] > 2:
            for y in range(lo, hi):
                out[y] = _sequential(int(kinds[y]), rows[y], out[y - 1] if y else np.zeros_like(rows[0]), bpp)
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples (height x bytes a row) of an 8-bit, non-interlaced PNG without a palette; raises BadMedia on any failed test."""
    if media[:8] != SIGNATURE:
        raise BadMedia("signature")
    at, head, data, ended = 8, None, [], False
    while at + 12 <= len(media) and not ended:
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(media) < at + 12 + n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadMedia("chunk checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise BadMedia("chunk missing")
    width, height, depth, colour, *rest = head
    bpp = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or bpp is None or any(rest):
        raise BadMedia("kind of image")
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error as e:
        raise BadMedia(str(e)) from e
    if len(raw) != height * (width * bpp + 1):
        raise BadMedia("length")
    raw = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter(raw[:, 0], raw[:, 1:], bpp)


def _dct(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None] * np.arange(k)[:, None])


def _shrink(m: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` equal bands of rows; fewer rows are repeated."""
    edges = np.linspace(0, len(m), n + 1)
    if len(m) < n:
        return m[np.minimum((edges[:-1] + (len(m) / n) / 2).astype(int), len(m) - 1)]
    e = edges.astype(int)
    return np.add.reduceat(m, e[:-1], axis=0) / np.diff(e)[:, None]


_LOW = _dct(SIDE, LOW)


def cosine_hash(img: np.ndarray) -> str:
    """64 bits as hex: which low frequencies of the image, shrunk to 32 x 32, lie above their median (the constant term is left out of the median)."""
    tall = _shrink(img.astype(np.float32), SIDE)
    f = np.round(_LOW @ _shrink(tall.T, SIDE).T.astype(float) @ _LOW.T, 6).ravel()
    return np.packbits(f > np.median(f[1:])).tobytes().hex()


def _column(b: pa.RecordBatch, name: str) -> list:
    return b.column(name).to_pylist()


def to_media(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """key, n_bytes, media: each whole text's UTF-8 bytes, space-padded to a positive multiple of ``width``, as a PNG.

    Null texts are empty ones: a single row of spaces. Repeated rows and equal texts give equal media, and an empty
    table gives no rows. Row by row, without a shuffle; other columns of ``df`` play no part.
    """
    prepare(df.sparkSession)

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = _column(b, "raw")
        media = [encode_png(x + b" " * (-len(x) % width or width * (not x)), width) for x in raw]
        return pa.record_batch({"id": b.column("id"), "n_bytes": pa.array(map(len, raw), pa.int64()), "media": pa.array(media, pa.binary())})

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(F.col(key).alias("id"), utf8(text).alias("raw")), f, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", key)


def read_media(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """``df`` with payload (binary, read back from ``media``) and feature (its cosine hash). A damaged image raises BadMedia; a null one gives nulls."""
    prepare(df.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c not in ("payload", "feature"))
    names = [c for c in df.columns if c not in ("payload", "feature")]

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        imgs = [None if x is None else decode_png(x) for x in _column(b, media)]
        new = {"payload": pa.array([None if x is None else x.tobytes() for x in imgs], pa.binary()), "feature": pa.array([None if x is None else cosine_hash(x) for x in imgs], pa.string())}
        return pa.record_batch({n: b.column(n) for n in names} | new)

    return arrow_map(df.select(*names), f, f"{schema}, payload binary, feature string")

"""Media columns: lossless PNG files in binary columns, read back with checksum tests, and a perceptual hash of the image.

A payload is cut into rows of 64 RGB pixels (192 bytes). Writing picks for each row the filter with the smallest sum of
absolute differences and packs the rows through zlib into IDAT chunks. Reading checks the signature, every chunk's CRC and
zlib's own checksum, and undoes the row filters with numpy. The hash is the sign pattern of the 8 x 8 lowest frequencies of
a cosine transform of the image, shrunk to 32 x 32 grey cells.

Rules for input: null text is the empty text; any text is padded with spaces to a positive multiple of 192 bytes; equal
texts give equal files and hashes; a damaged file raises ValueError; an empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, ready

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
COLOURS = {0: 1, 2: 3, 4: 2, 6: 4}  # samples of a pixel by colour type, at 8 bits each

WIDTH, SAMPLES = 64, 3
ROW = WIDTH * SAMPLES
IDAT_BYTES = 1 << 16
BLOCK_ROWS = 4096


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def write_png(payload: bytes, level: int = 6) -> bytes:
    """payload: whole rows of 64 RGB pixels."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    packer, packed = zlib.compressobj(level), []
    for at in range(0, len(rows), BLOCK_ROWS):
        x = rows[at : at + BLOCK_ROWS]
        above = np.zeros_like(x)
        above[1:] = x[:-1]
        if at:
            above[0] = rows[at - 1]
        left = np.zeros_like(x)
        left[:, SAMPLES:] = x[:, :-SAMPLES]
        tries = np.stack((x, x - left, x - above))
        cost = np.abs(tries.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
        cost[0] //= 2  # texts pack best as they are
        pick = cost.argmin(axis=0)
        out = np.empty((len(x), ROW + 1), np.uint8)
        out[:, 0] = pick
        out[:, 1:] = tries[pick, np.arange(len(x))]
        packed.append(packer.compress(out.tobytes()))
    packed.append(packer.flush())
    body = b"".join(packed)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    data = b"".join(_chunk(b"IDAT", body[i : i + IDAT_BYTES]) for i in range(0, len(body), IDAT_BYTES))
    return SIGNATURE + _chunk(b"IHDR", head) + data + _chunk(b"IEND", b"")


def _paeth_row(row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(row) + n, np.int32)
    up = np.concatenate((np.zeros(n, np.int32), above.astype(np.int32)))
    for i in range(n, len(out)):
        a, b, c = out[i - n], up[i], up[i - n]
        p = a + b - c
        pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        out[i] = (row[i - n] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
    return out[n:].astype(np.uint8)


def _average_row(row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(row) + n, np.int32)
    for i in range(n, len(out)):
        out[i] = (int(row[i - n]) + ((out[i - n] + int(above[i - n])) >> 1)) & 255
    return out[n:].astype(np.uint8)


def unfilter(lines: np.ndarray, samples: int) -> np.ndarray:
    """Rows of samples from rows of a filter number and filtered bytes."""
    kinds, x = lines[:, 0], lines[:, 1:].copy()
    if (kinds > 4).any():
        raise ValueError("unknown PNG row filter")
    for y in np.flatnonzero(kinds == 1):  # a running sum in each sample
        x[y] = np.cumsum(x[y].reshape(-1, samples), axis=0, dtype=np.uint8).reshape(-1)
    zero = np.zeros(x.shape[1], np.uint8)
    for y in np.flatnonzero(kinds > 1):
        above = x[y - 1] if y else zero
        if kinds[y] == 2:
            x[y] += above
        else:
            x[y] = (_average_row if kinds[y] == 3 else _paeth_row)(x[y], above, samples)
    return x


def read_png(data: bytes) -> np.ndarray:
    """Pixels as (height, width, samples), for 8-bit images that aren't interlaced."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, inflate, raw, ended = 8, None, zlib.decompressobj(), [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut off PNG chunk")
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) != n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise ValueError(f"bad checksum of PNG chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            try:
                raw.append(inflate.decompress(body))
            except zlib.error as e:
                raise ValueError(f"bad PNG data: {e}") from e
        elif kind == b"IEND":
            ended = True
            break
    if head is None or not ended or not inflate.eof:
        raise ValueError("incomplete PNG file")
    width, height, bits, colour, _, _, interlaced = head
    if bits != 8 or interlaced or colour not in COLOURS:
        raise ValueError("only 8-bit images that aren't interlaced")
    lines = np.frombuffer(b"".join(raw), np.uint8)
    per = width * COLOURS[colour] + 1
    if len(lines) != per * height:
        raise ValueError("PNG data doesn't fit the image size")
    return unfilter(lines.reshape(height, per), COLOURS[colour]).reshape(height, width, COLOURS[colour])


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


_DCT = _cosines(32, 8)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: which of the 64 lowest frequencies lie above their median, the constant one aside."""
    grey = pixels.reshape(*pixels.shape[:2], -1).mean(axis=2)
    for axis in (0, 1):  # means of 32 equal stretches
        n = grey.shape[axis]
        if n < 32:
            grey = np.repeat(grey, -(-32 // n), axis=axis)
            n = grey.shape[axis]
        at = np.arange(32) * n // 32
        size = np.diff(np.append(at, n))
        grey = np.add.reduceat(grey, at, axis=axis) / (size[:, None] if axis == 0 else size[None, :])
    low = (_DCT @ grey @ _DCT.T).round(6).reshape(-1)
    return np.packbits(low > np.median(low[1:])).tobytes()


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each text as a PNG file."""
    ready(docs.sparkSession)

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: write_png(pad(t.encode("utf-8", "replace"))))

    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), pack(text).alias("media"))


def read_media(media: DataFrame, media_col: str = "media") -> Column:
    """A column struct(payload binary, phash binary): the samples of a PNG column and the image's hash."""
    ready(media.sparkSession)

    @F.pandas_udf("payload binary, phash binary")
    def unpack(files: pd.Series) -> pd.DataFrame:
        images = [read_png(x) for x in files]
        return pd.DataFrame({"payload": [x.tobytes() for x in images], "phash": [cosine_hash(x) for x in images]})

    return unpack(F.col(media_col))


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media of all documents, written as a table in the shared folder and opened again, with what reading them gives."""
    stored = cut(with_media(docs, id_col, text_col), "media")
    return stored.withColumn("read", read_media(stored)).select(id_col, "n_bytes", "media", "read.payload", "read.phash")

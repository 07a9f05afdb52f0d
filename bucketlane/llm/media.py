"""Binary media columns: byte payloads as PNG images, read back with checksum tests, and low-frequency cosine hashes.

An image is 8-bit greyscale; its rows are `width` payload bytes. Edge cases: null and empty texts give one row of
padding; equal texts give equal images and features; a damaged file raises ValueError, naming the chunk.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bucketlane.llm.runtime import free, lean, ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
UNIT = 576


def pad(data: bytes, unit: int = UNIT) -> bytes:
    """data and bytes 255 up to a positive multiple of unit."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filtered(pixels: np.ndarray) -> np.ndarray:
    """Rows behind their filter bytes. Each row takes none (0), left (1) or above (2): the least sum of magnitudes."""
    left = pixels.copy()
    left[:, 1:] -= pixels[:, :-1]
    above = pixels.copy()
    above[1:] -= pixels[:-1]
    forms = (pixels, left, above)
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in forms])
    pick = cost.argmin(0)
    out = np.empty((len(pixels), pixels.shape[1] + 1), np.uint8)
    out[:, 0] = pick
    for k, x in enumerate(forms):
        out[pick == k, 1:] = x[pick == k]
    return out


def write_png(payload: bytes, width: int = UNIT, level: int = 1, block: int = 1 << 20) -> bytes:
    """A greyscale PNG whose samples are the payload. len(payload) is a positive multiple of width."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, width)
    packed = zlib.compress(filtered(pixels).tobytes(), level)
    head = struct.pack(">IIBBBBB", width, len(pixels), 8, 0, 0, 0, 0)
    body = b"".join(_chunk(b"IDAT", packed[i : i + block]) for i in range(0, len(packed), block))
    return SIGNATURE + _chunk(b"IHDR", head) + body + _chunk(b"IEND", b"")


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Samples of rows that stand behind their filter bytes; step: bytes a pixel. Knows the five filters of the format."""
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError(f"filter {kinds.max()} is unknown")
    width = out.shape[1]
    for k in np.flatnonzero(kinds == 1):
        for c in range(step):
            out[k, c::step] = np.cumsum(out[k, c::step], dtype=np.uint8)
    for y in np.flatnonzero(kinds >= 2):
        above = out[y - 1] if y else np.zeros(width, np.uint8)
        if kinds[y] == 2:
            out[y] += above
            continue
        line, up = out[y].tolist(), above.tolist()
        for x in range(width):
            a = line[x - step] if x >= step else 0
            if kinds[y] == 3:
                guess = (a + up[x]) // 2
            else:
                c = up[x - step] if x >= step else 0
                p = a + up[x] - c
                guess = min((abs(p - a), 0, a), (abs(p - up[x]), 1, up[x]), (abs(p - c), 2, c))[2]
            line[x] = (line[x] + guess) & 255
        out[y] = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """Samples (height, width * channels) of an 8-bit, not interlaced PNG, after a test of each chunk's checksum."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r} at byte {at} is wrong")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError(f"critical chunk {kind!r} is unknown")
    if not head or not ended:
        raise ValueError("the file has no head or no end")
    width, height, depth, colour, _, _, laced = head
    step = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or laced or not step:
        raise ValueError(f"depth {depth}, colour type {colour}, interlace {laced} is not supported")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * step + 1)
    # neighbouring rows whose filter needs the row above alone are summed at once
    if (rows[:, 0] <= 2).all():
        out = rows[:, 1:].copy()
        side = np.flatnonzero(rows[:, 0] == 1)
        if len(side):
            part = out[side].reshape(len(side), -1, step)
            out[side] = np.cumsum(part, axis=1, dtype=np.uint8).reshape(len(side), -1)
        for y in np.flatnonzero(rows[:, 0] == 2):
            if y:
                out[y] += out[y - 1]
        return out
    return unfiltered(rows, step)


_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi / _SIDE * (np.arange(_SIDE) + 0.5) * np.arange(_LOW)[:, None])


def cosine_hash(pixels: np.ndarray) -> bytes:
    """8 bytes: signs, against their median, of the 8 x 8 lowest frequencies of the image
    shrunk to 32 x 32 by area means. Whole-number sums come first, so equal images hash equally on every machine."""
    h, w = pixels.shape
    rows, cols = np.arange(_SIDE) * h // _SIDE, np.arange(_SIDE) * w // _SIDE
    ends = np.maximum(rows + 1, (np.arange(_SIDE) + 1) * h // _SIDE)
    wide = np.add.reduceat(pixels, cols, axis=1, dtype=np.int64)
    total = np.concatenate([np.zeros((1, _SIDE), np.int64), np.cumsum(wide, axis=0)])
    small = (total[ends] - total[rows]) / (ends - rows)[:, None] / np.diff(np.append(cols, w))[None, :]
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def features(text: str | None) -> tuple:
    """(n_bytes, payload_bytes, payload_sha256, tail_crc32, media, feature) of what the stored image gives back."""
    data = (text or "").encode()
    media = write_png(pad(data))
    pixels = read_png(media)
    payload = pixels.tobytes()
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media, cosine_hash(pixels)


def store(df: DataFrame, text: str = "text", media: str = "media", phash: str = "phash") -> DataFrame:
    """All columns of df plus two binary ones: the PNG of each text and its hash. Columns of these names are replaced."""
    ship(df.sparkSession)
    from pyspark.sql import functions as F

    @F.arrow_udf("struct<media: binary, phash: binary>")
    def run(column: pa.Array) -> pa.Array:
        got = [features(x.as_py())[4:] for x in column]
        return pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.binary()) for i in range(2)], ["media", "phash"])

    made = run(F.col(text))
    (both,) = free(df, "stored")
    return df.withColumn(both, made).withColumn(media, F.col(both)["media"]).withColumn(phash, F.col(both)["phash"]).drop(both)


def read_back(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each row's stored image. Images stay in the worker; no shuffle."""
    ship(df.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(1):
                n, size, digest, tail, media, low = features(x.as_py())
                rows.append((n, size, digest, tail, len(media), hashlib.sha256(media).hexdigest(), low.hex()))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

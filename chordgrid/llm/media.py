"""Media columns: 8-bit greyscale PNG in binary columns, written and read with checksums, and hashes of low frequencies.

The reader takes every PNG of 8 bits a sample without interlacing (grey, RGB, with alpha or without), checks the
signature, each chunk's CRC-32 and zlib's Adler-32, and undoes all five filters with numpy: rows without prediction,
Sub and Up in whole runs by sums modulo 256, Average and Paeth along anti-diagonals.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chordgrid.llm.common import text_of

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

#: Samples in a row of an image made from bytes.
WIDTH = 64


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """``samples`` (height, width) of uint8 as PNG; each row has the one of None, Sub and Up with the least total size."""
    height, width = samples.shape
    sub, up = samples.copy(), samples.copy()
    sub[:, 1:] -= samples[:, :-1]
    up[1:] -= samples[:-1]
    forms = np.stack((samples, sub, up))
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = forms[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of each chunk; a wrong signature, a cut or a wrong checksum raises ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(png):
        if at + 12 > len(png):
            raise ValueError("PNG ends within a chunk")
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        data, check = png[at + 8 : at + 8 + size], png[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of chunk {kind!r}")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("PNG without an end")


def _predicted(kinds: np.ndarray, raw: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of kind Average or Paeth, undone along anti-diagonals, on which no sample needs another. raw: (rows, width, channels)."""
    height, width, channels = raw.shape
    out = np.zeros((height + 1, width + 1, channels), np.int32)
    out[0, 1:] = above
    average = (kinds == 3)[:, None]
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + up - corner
        a, b, c = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[y + 1, x + 1] = (raw[y, x] + np.where(average[y], (left + up) // 2, paeth)) % 256
    return out[1:, 1:].astype(np.uint8)


def decode_png(png: bytes) -> np.ndarray:
    """The samples, (height, width, channels) of uint8."""
    head, packed = None, []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[4:] != (0, 0, 0):
        raise ValueError("only 8-bit samples without palette or interlacing are read")
    width, height, channels = head[0], head[1], CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error as error:
        raise ValueError(f"PNG data: {error}") from error
    if raw.size != height * (width * channels + 1):
        raise ValueError("PNG data of a wrong size")
    raw = raw.reshape(height, width * channels + 1)
    kinds, raw = raw[:, 0], raw[:, 1:].reshape(height, width, channels)
    if height and kinds.max() > 4:
        raise ValueError("unknown filter")
    out = np.empty_like(raw)
    group = np.where(kinds >= 3, 3, kinds)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [height]))
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        above = out[first - 1] if first else np.zeros((width, channels), np.uint8)
        run = raw[first:last]
        if group[first] == 0:
            out[first:last] = run
        elif group[first] == 1:
            np.cumsum(run, axis=1, dtype=np.uint8, out=out[first:last])
        elif group[first] == 2:
            np.cumsum(run, axis=0, dtype=np.uint8, out=out[first:last])
            out[first:last] += above
        else:
            out[first:last] = _predicted(kinds[first:last], run, above)
    return out


@lru_cache(maxsize=8)
def _cosines(n: int, kept: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(kept)[:, None] / (2 * n))


def low_frequency_hash(grey: np.ndarray, grid: int = 32, kept: int = 8) -> bytes:
    """``kept`` * ``kept`` bits: which low frequencies of the image's ``grid`` * ``grid`` means exceed their median.

    A smaller image repeats its samples to fill the grid.
    """
    for axis in (0, 1):
        n = grey.shape[axis]
        starts = np.arange(grid) * n // grid
        if n < grid:
            grey = np.take(grey, starts, axis=axis).astype(np.float64)
        else:
            counts = np.diff(np.append(starts, n))
            grey = np.add.reduceat(grey, starts, axis=axis, dtype=np.float64) / (counts[:, None] if axis == 0 else counts)
    waves = _cosines(grid, kept)
    low = np.round(waves @ grey @ waves.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def payload_of(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of the row's width."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def to_media(data: Column) -> Column:
    """Binary column -> PNG in a binary column."""

    @F.pandas_udf("binary")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: encode_png(np.frombuffer(payload_of(v), np.uint8).reshape(-1, WIDTH)))

    return encode(data)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary"


def media_features(media: Column) -> Column:
    """PNG column -> struct of what is read back from it; null for a null. A damaged PNG raises."""

    @F.pandas_udf(FEATURES)
    def features(values: pd.Series) -> pd.DataFrame:
        def read(png: bytes | None) -> tuple:
            if png is None:
                return (None,) * 6
            samples = decode_png(png)
            payload = samples.tobytes()
            grey = samples[:, :, 0] if samples.shape[2] < 3 else samples[:, :, :3].mean(axis=2)
            return (
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]),
                len(png), hashlib.sha256(png).hexdigest(), low_frequency_hash(grey),
            )

        names = [field.split()[0] for field in FEATURES.split(", ")]
        return pd.DataFrame([read(v) for v in values], columns=names)

    return features(media)


def store_texts(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each row's UTF-8 text as a PNG of 64 samples a row.

    Null and empty texts become one row of zeros; a very long text is a tall image; equal texts give equal bytes;
    repeated rows each give a row; other columns are not read; an empty table gives an empty result.
    """
    data = text_of(text).cast("binary")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), to_media(data).alias("media"))


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, and the features read back from ``media``, the hash as hexadecimal ``feature``."""
    read = media.select("doc_id", "n_bytes", media_features(F.col("media")).alias("read"))
    return read.select("doc_id", "n_bytes", "read.*").withColumn("feature", F.lower(F.hex("hash"))).drop("hash")

"""PNG images by the standard library: 8-bit grey, RGB, palette and RGBA, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) of 8 bits."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, clear = 8, [], None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit images without interlacing")
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 2:
            now = line + above
        else:
            now = np.zeros(width * channels, np.uint8)
            for x in range(width * channels):
                a = int(now[x - channels]) if x >= channels else 0
                b, c = int(above[x]), int(above[x - channels]) if x >= channels else 0
                p = a + b - c
                guess = a if kind == 1 else (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: (abs(p - v), (a, b, c).index(v)))
                now[x] = (int(line[x]) + guess) & 255
        out[y] = above = now
    px = out.reshape(height, width, channels)
    full = np.full((height, width), 255, np.uint8)
    if colour == 3:
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.dstack([palette[px[..., 0]], alpha[px[..., 0]]])
    if colour in (0, 4):
        return np.dstack([px[..., 0]] * 3 + [px[..., 1] if colour == 4 else full])
    return px if colour == 6 else np.dstack([px, full])


def encode_png(pixels: np.ndarray) -> bytes:
    """An RGBA image as PNG."""
    height, width, _ = pixels.shape
    lines = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def grey_png(values: Column, width: int) -> Column:
    """A PNG of an array of grey values (0 to 255), row by row; null without a whole row."""

    @F.pandas_udf("binary")
    def drawn(arrays: pd.Series) -> pd.Series:
        def one(cells):
            if cells is None or len(cells) < width:
                return None
            grey = np.asarray(cells, np.uint8)[: len(cells) // width * width].reshape(-1, width)
            return encode_png(np.dstack([grey] * 3 + [np.full_like(grey, 255)]))

        return arrays.map(one)

    return drawn(values)


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """``path, width, height, pixels`` (RGBA bytes, row by row) of the PNG files of a folder."""
    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch["path"], batch["content"], strict=True):
                px = decode_png(bytes(data))
                rows.append((name, px.shape[1], px.shape[0], px.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, width int, height int, pixels binary")

"""PNG files: size, pixels and how two files compare."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel of each colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header, or None for anything but a PNG."""
    if len(data) < 24 or data[:8] != _MAGIC or data[12:16] != b"IHDR":
        return None
    return struct.unpack(">II", data[16:24])


def _chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        (length,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        yield kind, data[at + 8 : at + 8 + length]
        at += length + 12


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(height):
        kind, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).ravel()
        elif kind in (3, 4):
            left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for x in range(0, stride, step):
                up = above[x : x + step]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    da, db, dc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
                left, corner = (line[x : x + step] + guess) & 255, up
                line[x : x + step] = left
        elif kind:
            raise ValueError("unknown filter")
        above = line & 255
        out[y] = above
    return out


def png_pixels(data: bytes) -> np.ndarray:
    """RGBA pixels of an 8-bit PNG without interlacing; ValueError for any other file."""
    size = png_size(data)
    if size is None:
        raise ValueError("no PNG")
    width, height = size
    depth, colour, _, _, interlace = data[24:29]
    if depth != 8 or interlace or colour not in _SAMPLES:
        raise ValueError("not an 8-bit PNG without interlacing")
    body, palette, clear = b"", None, None
    for kind, chunk in _chunks(data):
        if kind == b"IDAT":
            body += chunk
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = chunk
    step = _SAMPLES[colour]
    pixels = _unfilter(zlib.decompress(body), height, width * step, step).reshape(height, width, step)
    alpha = np.full((height, width, 1), 255, np.uint8)
    if colour == 3:
        if palette is None:
            raise ValueError("no palette")
        shades = np.full(len(palette), 255, np.uint8)
        if clear:
            shades[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[pixels[..., 0]], shades[pixels[..., 0]][..., None]], axis=2)
    if colour in (0, 2) and clear:
        key = np.frombuffer(clear, ">u2")[:step]
        alpha = np.where((pixels == key).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)
    if colour in (4, 6):
        alpha, pixels = pixels[..., -1:], pixels[..., :-1]
    return np.concatenate([np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels, alpha], axis=2)


def compare(first: bytes, second: bytes) -> str:
    """confirmed_exact, confirmed_pixel_identical, confirmed_visual_equivalent, different_image or needs_review.

    The strongest proof counts: equal bytes, equal pixels, or pixels that differ only where both are
    wholly transparent. Shapes that no scaling relates are different; all else needs review.
    """
    if first == second:
        return "confirmed_exact"
    a, b = png_size(first), png_size(second)
    if a is None or b is None:
        return "needs_review"
    if a != b:
        scaled = abs(b[1] - a[1] * b[0] / a[0]) <= 1 and abs(a[1] - b[1] * a[0] / b[0]) <= 1
        return "needs_review" if scaled else "different_image"
    try:
        pa, pb = png_pixels(first), png_pixels(second)
    except (ValueError, zlib.error):
        return "needs_review"
    differ = (pa != pb).any(axis=2)
    if not differ.any():
        return "confirmed_pixel_identical"
    seen = differ & ~((pa[..., 3] == 0) & (pb[..., 3] == 0))
    return "needs_review" if seen.any() else "confirmed_visual_equivalent"


def compare_images(first: Column, second: Column) -> Column:
    """``compare`` over two binary columns; null where either is."""

    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compare(bytes(x), bytes(y)) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype=object)

    return run(first, second)

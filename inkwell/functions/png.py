"""Grey rasters as PNG files, by the published format, for boxes without an imaging library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encoded(gray: np.ndarray) -> bytes:
    """An eight-bit grey PNG; every row stands as it is."""
    h, w = gray.shape
    rows = np.zeros((h, w + 1), np.uint8)
    rows[:, 1:] = gray
    header = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _guess(left: int, up: int, corner: int) -> int:
    """The neighbour nearest to left + up - corner; of equally near ones left, then up."""
    return min((left, up, corner), key=lambda v: abs(left + up - corner - v))


def decoded(content: bytes) -> np.ndarray | None:
    """The raster of an eight-bit grey PNG that isn't interlaced; None for other files, an error for broken ones."""
    if not content.startswith(SIGNATURE):
        return None
    at, packed, header = len(SIGNATURE), b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        data = content[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken chunk")
        header, packed, at = data if kind == b"IHDR" else header, packed + data if kind == b"IDAT" else packed, at + 12 + n
    w, h, *how = struct.unpack(">IIBBBBB", header)
    if how != [8, 0, 0, 0, 0]:
        return None
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w + 1)
    out = np.zeros((h, w), np.uint8)
    above = np.zeros(w, np.uint8)
    for y, (kind, line) in enumerate(zip(rows[:, 0], rows[:, 1:], strict=True)):
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y] = line + above
        else:
            left = corner = 0
            for x in range(w):
                up = int(above[x])
                left = (int(line[x]) + ((left + up) // 2 if kind == 3 else _guess(left, up, corner))) & 255
                out[y, x], corner = left, up
        above = out[y]
    return out

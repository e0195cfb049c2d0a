"""PNG files as arrays of pixels, one file at a time.

Reads eight-bit gray, gray with alpha, RGB, RGBA and palette files without
interlacing, with every kind of row filter; writes RGBA, RGB or gray. Chunks'
checksums are verified. What can't be read raises ValueError with the reason.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of a pixel by colour type.
_WIDTHS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_KINDS = {1: 0, 3: 2, 4: 6}
#: Files are written at zlib's fastest level: most of the time of a file goes into it.
LEVEL = 1
#: An image of more pixels isn't decoded.
MOST_PIXELS = 200_000_000


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body, end = data[at + 8 : at + 8 + size], at + 12 + size
        if end > len(data):
            raise ValueError("the file ends early")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, end - 4)[0]:
            raise ValueError(f"damaged chunk {kind.decode('latin-1')}")
        yield kind, body
        if kind == b"IEND":
            return
        at = end
    raise ValueError("the file ends early")


def _paeth(line: bytearray, above: bytes, step: int) -> None:
    for x in range(len(line)):
        a, b, c = (line[x - step], above[x], above[x - step]) if x >= step else (0, above[x], 0)
        near_a, near_b, near_c = abs(b - c), abs(a - c), abs(a + b - c - c)
        best = a if near_a <= near_b and near_a <= near_c else b if near_b <= near_c else c
        line[x] = (line[x] + best) & 255


def _average(line: bytearray, above: bytes, step: int) -> None:
    for x in range(len(line)):
        line[x] = (line[x] + ((line[x - step] if x >= step else 0) + above[x]) // 2) & 255


def _rows(raw: bytes, height: int, size: int, step: int) -> np.ndarray:
    """Rows without their filters. The first two kinds are sums over a whole row at once."""
    filtered = np.frombuffer(raw, np.uint8).reshape(height, size + 1)
    out, above = np.zeros((height, size), np.uint8), np.zeros(size, np.uint8)
    for y in range(height):
        kind, line = filtered[y, 0], filtered[y, 1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            own = bytearray(line.tobytes())
            (_average if kind == 3 else _paeth)(own, above.tobytes(), step)
            out[y] = np.frombuffer(own, np.uint8)
        else:
            raise ValueError(f"no row filter {kind}")
        above = out[y]
    return out


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) of red, green, blue and alpha."""
    head, parts, palette, clear = None, [], None, b""
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
    if head is None or not head[0] or not head[1]:
        raise ValueError("no size")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in _WIDTHS or interlaced:
        raise ValueError(f"depth {depth}, colour type {colour}, interlacing {interlaced} aren't read")
    if width * height > MOST_PIXELS:
        raise ValueError(f"more than {MOST_PIXELS} pixels")
    step = _WIDTHS[colour]
    expected = height * (width * step + 1)
    try:
        # one byte more than there should be is enough to tell that there are too many
        raw = zlib.decompressobj().decompress(b"".join(parts), expected + 1)
    except zlib.error as e:
        raise ValueError("damaged pixels") from e
    if len(raw) != expected:
        raise ValueError("too few or too many pixels")
    rows = _rows(raw, height, width * step, step).reshape(height, width, step)
    out = np.full((height, width, 4), 255, np.uint8)
    if colour == 3:
        if palette is None or rows.max() >= len(palette):
            raise ValueError("no such colour in the palette")
        out[..., :3] = palette[rows[..., 0]]
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        out[..., 3] = alpha[rows[..., 0]]
        return out
    out[..., :3] = rows[..., :1] if step < 3 else rows[..., :3]
    if step in (2, 4):
        out[..., 3] = rows[..., -1]
    elif clear:  # one colour is transparent; its samples have two bytes each
        out[..., 3] = np.where((rows == np.frombuffer(clear, ">u2").astype(np.uint8)).all(axis=2), 0, 255)
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A file of (height, width, 1, 3 or 4) pixels, rows unfiltered but for those that repeat the one above."""
    height, width, step = pixels.shape
    raw, rows = np.zeros((height, width * step + 1), np.uint8), pixels.reshape(height, -1)
    for y in range(height):
        if y and np.array_equal(rows[y], rows[y - 1]):
            raw[y, 0] = 2  # its differences are nothing
        else:
            raw[y, 1:] = rows[y]
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, _KINDS[step], 0, 0, 0)), (b"IDAT", zlib.compress(raw, LEVEL)), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)

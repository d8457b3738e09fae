"""Pixels from file bytes. PNG is decoded here; other formats go through Spark's image source."""

import struct
import zlib

import numpy as np

from .containers import png_chunks


def png(raw: bytes) -> tuple[np.ndarray, int]:
    """RGB picture and number of channels of a PNG of 8 or 16 bits or a palette, not interlaced."""
    parts = {}
    for kind, at, size in png_chunks(raw):
        if len(raw) < at + size:
            raise ValueError("truncated PNG")
        parts.setdefault(kind, b"")
        parts[kind] += raw[at : at + size]
        if kind == b"IEND":
            break
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    if interlace or depth not in (8, 16) or not width or not height:
        raise ValueError("unsupported PNG layout")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    flat = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, 1 + width * step)
    rows = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.int16)
    for y in range(height):
        kind, line = flat[y, 0], flat[y, 1:].astype(np.int16)
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0).reshape(-1) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            out = line.tolist()
            up = above.tolist()
            for x in range(len(out)):
                a, b, c = (out[x - step], up[x], up[x - step]) if x >= step else (0, up[x], 0)
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[x] = (out[x] + guess) & 255
            line = np.array(out, np.int16)
        rows[y], above = line, line
    pixels = rows.reshape(height, width, channels, -1)[..., 0]
    if colour == 3:
        palette = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        return palette[np.minimum(pixels[..., 0], len(palette) - 1)], 4 if b"tRNS" in parts else 3
    rgb = pixels[..., :3] if channels >= 3 else np.repeat(pixels[..., :1], 3, 2)
    return np.ascontiguousarray(rgb), channels


def write_png(picture: np.ndarray) -> bytes:
    """A PNG of an RGB or grey picture."""
    height, width = picture.shape[:2]
    colour = 2 if picture.ndim == 3 else 0
    lines = np.concatenate([np.zeros((height, 1), np.uint8), picture.reshape(height, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def from_image_row(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB picture of a row of Spark's image source (blue first)."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, 2) if channels == 1 else np.ascontiguousarray(a[..., 2::-1])

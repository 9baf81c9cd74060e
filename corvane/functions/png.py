"""PNG decoding and encoding, resizing and edges, in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray:
    """(height, width, 4) bytes of a PNG of 8 or 16 bits, or of 1, 2 or 4 in grey or with a palette; interlaced ones are refused."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, palette, alpha, head = 8, [], None, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = body
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[6] or head[3] not in CHANNELS or head[2] not in ((8, 16) if head[3] not in (0, 3) else (1, 2, 4, 8, 16)):
        raise ValueError("unsupported PNG")
    width, height, depth, color = head[:4]
    step, line = max(1, CHANNELS[color] * depth // 8), -(-width * CHANNELS[color] * depth // 8)
    rows = _unfilter(np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + line), step)
    if depth < 8:  # several pixels a byte, the first in the highest bits
        shifts = np.arange(8 - depth, -1, -depth, dtype=np.uint8)
        px = ((rows[:, :, None] >> shifts) & (2**depth - 1)).reshape(height, -1)[:, :width, None]
        if color == 0:
            px = (px.astype(np.uint16) * 255 // (2**depth - 1)).astype(np.uint8)
    else:
        px = rows.reshape(height, width, step)[:, :, :: depth // 8]
    out = np.full((height, width, 4), 255, np.uint8)
    if color == 3:
        out[..., :3] = palette[px[..., 0]]
        if alpha:
            table = np.full(256, 255, np.uint8)
            table[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            out[..., 3] = table[px[..., 0]]
    else:
        out[..., :3] = px[..., :3] if color in (2, 6) else px[..., :1]
        if color in (4, 6):
            out[..., 3] = px[..., -1]
    return out


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    height, width = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((height, width), np.uint8)
    above = np.zeros(width, np.int64)
    for y in range(height):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        if kind == 0:
            now = line
        elif kind == 2:
            now = line + above & 255
        elif kind == 1:
            now = (np.cumsum(line.reshape(-1, step), axis=0) & 255).reshape(-1)
        elif kind in (3, 4):
            now = np.zeros(width, np.int64)
            for x in range(width):
                a, b = (now[x - step] if x >= step else 0), above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                now[x] = (line[x] + guess) & 255
        else:
            raise ValueError("bad PNG filter")
        out[y] = above = now
        above = now
    return out


def encode(image: np.ndarray) -> bytes:
    """A PNG of (height, width, 4) bytes, every row unfiltered."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def resize(image: np.ndarray, width: int) -> np.ndarray:
    """Box average to a width, height in proportion."""
    h, w = image.shape[:2]
    if w == width:
        return image
    height = max(1, int(np.floor(h * width / w + 0.5)))

    def edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.minimum(np.arange(m) * n // m, n - 1)
        return lo, np.minimum(n, np.maximum(lo + 1, -(-(np.arange(m) + 1) * n // m)))

    (y0, y1), (x0, x1) = edges(h, height), edges(w, width)
    s = np.zeros((h + 1, w + 1, 4))
    s[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)
    total = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    return np.floor(total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])[..., None] + 0.5).astype(np.uint8)


def luma(image: np.ndarray) -> np.ndarray:
    return image[..., :3].astype(np.float64) @ np.array([0.2126, 0.7152, 0.0722])


def sobel(gray: np.ndarray) -> np.ndarray:
    """Gradient magnitude; the border is 0."""
    out = np.zeros_like(gray)
    if min(gray.shape) >= 3:
        g = gray
        gx = g[:-2, 2:] + 2 * g[1:-1, 2:] + g[2:, 2:] - g[:-2, :-2] - 2 * g[1:-1, :-2] - g[2:, :-2]
        gy = g[2:, :-2] + 2 * g[2:, 1:-1] + g[2:, 2:] - g[:-2, :-2] - 2 * g[:-2, 1:-1] - g[:-2, 2:]
        out[1:-1, 1:-1] = np.hypot(gx, gy)
    return out

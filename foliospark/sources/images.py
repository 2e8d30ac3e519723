"""Sizes and frames of image files, read from their headers; no pixel is decoded."""

from __future__ import annotations

import struct

# JPEG markers that begin a frame, and the TIFF tags of width and height.
JPEG_FRAMES = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))
TIFF_WIDTH, TIFF_HEIGHT = 256, 257


def _jpeg(b: bytes) -> list[tuple[int, int]]:
    at = 2
    while at + 9 <= len(b):
        if b[at] != 0xFF:
            raise ValueError("no marker where one must be")
        kind = b[at + 1]
        if kind == 0xFF or 0xD0 <= kind <= 0xD9 or kind == 0x01:
            at += 1 if kind == 0xFF else 2
            continue
        if kind in JPEG_FRAMES:
            height, width = struct.unpack(">HH", b[at + 5 : at + 9])
            return [(width, height)]
        at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    raise ValueError("no frame")


def _tiff(b: bytes) -> list[tuple[int, int]]:
    order = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(f"{order}I", b[4:8])
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(f"{order}H", b[at : at + 2])
        size = {}
        for i in range(n):
            entry = b[at + 2 + 12 * i : at + 14 + 12 * i]
            tag, kind = struct.unpack(f"{order}HH", entry[:4])
            if tag in (TIFF_WIDTH, TIFF_HEIGHT):
                (size[tag],) = struct.unpack(f"{order}H" if kind == 3 else f"{order}I", entry[8 : 10 if kind == 3 else 12])
        out.append((size[TIFF_WIDTH], size[TIFF_HEIGHT]))
        (at,) = struct.unpack(f"{order}I", b[at + 2 + 12 * n : at + 6 + 12 * n])
    return out


def _webp(b: bytes) -> list[tuple[int, int]]:
    kind = b[12:16]
    if kind == b"VP8X":
        return [(1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"))]
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return [(1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))]
    width, height = struct.unpack("<HH", b[26:30])
    return [(width & 0x3FFF, height & 0x3FFF)]


def frame_sizes(content: bytes | None) -> list[tuple[int, int]]:
    """(width, height) of each frame; one for all formats but TIFF. Nothing for what is no readable image."""
    b = bytes(content or b"")
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return [struct.unpack(">II", b[16:24])]
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
        if b[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(b)
        if b[:6] in (b"GIF87a", b"GIF89a"):
            return [struct.unpack("<HH", b[6:10])]
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:2] == b"BM":
            width, height = struct.unpack("<ii", b[18:26])
            return [(abs(width), abs(height))]
    except (struct.error, ValueError, KeyError, IndexError):
        return []
    return []

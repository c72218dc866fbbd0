from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from tessera.sources import binary as B


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks: bytes, width: int = 1, height: int = 1, rows: bytes | None = None, color: int = 2) -> bytes:
    n = {0: 1, 2: 3, 6: 4}[color]
    rows = rows if rows is not None else b"".join(b"\0" + bytes(range(n)) * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return B.PNG + chunk(b"IHDR", head) + b"".join(chunks) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(entries: list[tuple[int, int, int, bytes]], order: str = "<", tail: bytes = b"", next_ifd: int = 0) -> bytes:
    body = b"".join(struct.pack(order + "HHI", t, k, c) + v.ljust(4, b"\0") for t, k, c, v in entries)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)) + body + struct.pack(order + "I", next_ifd) + tail


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b for m, b in segments)


SOF = b"\x08" + struct.pack(">HH", 3, 4) + b"\0"


@pytest.mark.parametrize("data,ext,want", [
    (png(width=5, height=7, rows=b""), ".png", (5, 7, [])), (png()[:20], ".png", (None, None, ["invalid_image_header"])), (jpeg((0xC0, SOF)), ".jpg", (4, 3, [])), (jpeg((0xE0, b"abc"), (0xC2, SOF)), ".jpeg", (4, 3, [])),
    (b"\xff\xd8\xff\xff\xff\xc0\x00\x0b" + SOF, ".jpg", (4, 3, [])), (jpeg((0xE0, b"x")), ".jpg", (None, None, ["invalid_image_header"])), (b"x", ".gif", (None, None, ["unsupported_extension"])),
    (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a\x05\x00\x06\x00", ".webp", (5, 6, [])),
    (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 4 | 5 << 14) + b"\0\0\0\0\0", ".webp", (5, 6, [])), (b"this is no webp", ".webp", (None, None, ["invalid_image_header"])),
])
def test_sizes(data, ext, want):
    assert B.probe(ext, data) == want


def test_png_text():
    twice = png(chunk(b"tEXt", b"k\0one"), chunk(b"tEXt", b"k\0t\xe9"), chunk(b"zTXt", b"z\0\0" + zlib.compress("é".encode())))
    assert B.png_text(twice) == {"k": "té", "z": "é"}
    assert B.metadata(".png", png(chunk(b"tEXt", b"no zero")))["error"]
    assert B.metadata(".png", png(chunk(b"iTXt", b"a\0\0")))["error"]
    assert B.metadata(".png", png())["source_format"] is None
    assert B.metadata(".png", png(chunk(b"zTXt", b"z\0\1x")))["error"]


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    n = lambda x: struct.pack(order + "I", x)
    at = 8 + 2 + 4 * 12 + 4
    block = tiff([(0x0110, 2, 3, b"ab\0"), (0x011A, 5, 1, n(at)), (0x8769, 4, 1, n(at + 8)), (0x1234, 77, 1, b"\1\2\3\4")], order, n(3) + n(2) + struct.pack(order + "H", 1) + struct.pack(order + "HHI", 0x9286, 7, 4) + b"hi\0\0" + n(8))
    exif = B.Tiff(block).read()
    assert exif == {"Model": "ab", "Tag_011A": [3, 2], "ExifIFD": {"UserComment": "hi", "NextIFD": {}}, "Tag_1234": "01020304"}
    assert B.strings_of(exif) == {"Model": "ab", "UserComment": "hi", "Tag_1234": "01020304"}
    found = B.metadata(".jpg", jpeg((0xE1, b"Exif\0\0" + block), (0xC0, SOF)))
    assert found["source_format"] == "jpeg_exif" and found["raw_text"]["Model"] == "ab"
    webp = b"RIFF\0\0\0\0WEBPABCD" + struct.pack("<I", 3) + b"xyz\0EXIF" + struct.pack("<I", len(block)) + block
    assert B.metadata(".webp", webp)["raw_text"]["UserComment"] == "hi"


def test_pixels():
    rows = bytes([0, 10, 20, 30, 1, 5, 5, 5])  # second line: each value adds to its left neighbour's
    gray = B.decode_png(png(width=1, height=2, rows=rows[:4] + bytes([2, 1, 1, 1]), color=2))
    assert gray.shape == (2, 1) and gray[0, 0] == pytest.approx(0.299 * 10 + 0.587 * 20 + 0.114 * 30) and gray[1, 0] == pytest.approx(gray[0, 0] + 1)
    r = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(float)
    h = B.perceptual_hash(r)
    assert len(h) == 16 and B.perceptual_hash(r + 10) == h and 24 <= bin(int(h, 16)).count("1") <= 40
    assert B.resize_nearest(np.arange(16).reshape(4, 4), 2, 2).tolist() == [[0, 2], [8, 10]]

"""Image containers read in Arrow batches: dimensions, embedded text, Exif, and the gray matrix with its hashes.

A file's bytes come from the `content` column of a binaryFile scan; each batch is parsed in numpy and the standard library, one result
struct per file, errors as values. What a parser cannot read is an error of that row alone.
"""

from __future__ import annotations

import json
import math
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
# JPEG frame markers, TIFF value sizes, TIFF tag names, tags that point to a further directory.
FRAME_MARKERS = frozenset((0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF))
VALUE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
TAG_NAMES = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x8769: "ExifIFD",
    0x8825: "GPSInfo", 0x9003: "DateTimeOriginal", 0x9286: "UserComment", 0x9C9B: "XPTitle", 0x9C9C: "XPComment", 0x9C9D: "XPAuthor",
    0x9C9E: "XPKeywords", 0x9C9F: "XPSubject", 0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA005: "InteropIFD",
}
DIRECTORIES = (0x8769, 0x8825, 0xA005)
PRINTABLE = frozenset(string.printable.encode())


class Broken(ValueError):
    """The bytes are not what their suffix says, or end too soon."""


def _number(data: bytes, at: int, n: int, order: str) -> int:
    part = data[at : at + n]
    if len(part) < n:
        raise Broken("it ends too soon")
    return int.from_bytes(part, "big" if order == ">" else "little")


# --- dimensions -------------------------------------------------------------------------------------------------------------
def png_size(data: bytes) -> tuple[int, int]:
    if len(data) < 24 or not data.startswith(PNG):
        raise Broken("no PNG header")
    return struct.unpack_from(">II", data, 16)


def jpeg_segments(data: bytes, fill: bool) -> Iterator[tuple[int, int, int]]:
    """(marker, begin, end) of the segments. `fill`: skip 0xFF fill bytes before a marker."""
    if data[:2] != b"\xff\xd8":
        raise Broken("no JPEG header")
    at = 2
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        at += 1
        while fill and at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            return
        marker, at = data[at], at + 1
        if marker in (0xD8, 0xD9):
            continue
        end = at + max(_number(data, at, 2, ">"), 2)
        yield marker, at + 2, end
        at = end


def jpeg_size(data: bytes) -> tuple[int, int]:
    for marker, begin, _ in jpeg_segments(data, fill=True):
        if marker in FRAME_MARKERS:
            return _number(data, begin + 3, 2, ">"), _number(data, begin + 1, 2, ">")
    raise Broken("no frame")


def webp_size(data: bytes) -> tuple[int, int]:
    if len(data) < 16 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("no WEBP header")
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + _number(data, 24, 3, "<"), 1 + _number(data, 27, 3, "<")
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        return _number(data, 26, 2, "<") % 0x4000, _number(data, 28, 2, "<") % 0x4000
    if kind == b"VP8L" and data[20:21] == b"\x2f":
        bits = _number(data, 21, 4, "<")
        return bits % 0x4000 + 1, (bits >> 14) % 0x4000 + 1
    raise Broken("no WEBP frame header")


SIZES = {".png": png_size, ".jpg": jpeg_size, ".jpeg": jpeg_size, ".webp": webp_size}


def probe(extension: str, data: bytes) -> tuple[int | None, int | None, list[str]]:
    """Width, height, issues."""
    read = SIZES.get(extension)
    if read is None:
        return None, None, ["unsupported_extension"]
    try:
        return (*read(data or b""), [])
    except (ValueError, struct.error):
        return None, None, ["invalid_image_header"]


# --- embedded text ----------------------------------------------------------------------------------------------------------
def _inflate(data: bytes, method: int) -> str:
    if method:
        raise Broken("unknown compression")
    return zlib.decompress(data).decode("utf-8", "replace")


def png_text(data: bytes) -> dict[str, str]:
    """Text of the tEXt (Latin-1), zTXt and iTXt chunks up to IEND; of a repeated key the last one. Checksums are not looked at."""
    if not data.startswith(PNG):
        raise Broken("no PNG header")
    found: dict[str, str] = {}
    at, kind = 8, b""
    while at + 8 <= len(data) and kind != b"IEND":
        end = at + 8 + _number(data, at, 4, ">")
        kind, body = data[at + 4 : at + 8], data[at + 8 : end]
        at = end + 4
        if kind not in (b"tEXt", b"zTXt", b"iTXt"):
            continue
        key, zero, rest = body.partition(b"\0")
        if not zero:
            raise Broken("a text chunk without a key")
        if kind == b"tEXt":
            value = rest.decode("latin-1")
        elif kind == b"zTXt":
            value = _inflate(rest[1:], rest[0] if rest else 1)
        else:
            if len(rest) < 2 or rest.count(b"\0", 2) < 2:
                raise Broken("a cut iTXt chunk")
            text = rest[2:].split(b"\0", 2)[2]
            value = _inflate(text, rest[1]) if rest[0] else text.decode("utf-8", "replace")
        found[key.decode("latin-1")] = value
    return found


class Tiff:
    """Reader of one TIFF block; each directory is entered once."""

    def __init__(self, data: bytes):
        if len(data) < 8 or data[:2] not in (b"II", b"MM"):
            raise Broken("no TIFF header")
        self.data, self.order, self.been = data, "<" if data[:2] == b"II" else ">", set()
        if self.number(2, 2) != 42:
            raise Broken("no TIFF header")

    def number(self, at: int, n: int) -> int:
        return _number(self.data, at, n, self.order)

    def read(self) -> dict:
        return self.directory(self.number(4, 4))

    def directory(self, at: int) -> dict:
        if at <= 0 or at + 2 > len(self.data) or at in self.been:
            return {}
        self.been.add(at)
        n, out = self.number(at, 2), {}
        for entry in range(at + 2, at + 2 + 12 * n, 12):
            if entry + 12 > len(self.data):
                break
            tag = self.number(entry, 2)
            value = self.value(self.number(entry + 2, 2), self.number(entry + 4, 4), entry + 8)
            if tag in DIRECTORIES and isinstance(value, int):
                value = self.directory(value)
            out[TAG_NAMES.get(tag, f"Tag_{tag:04X}")] = value
        further = at + 2 + 12 * n
        if further + 4 <= len(self.data) and (to := self.number(further, 4)):
            out["NextIFD"] = self.directory(to)
        return out

    def value(self, kind: int, count: int, at: int):
        if kind not in VALUE_SIZES:
            return self.data[at : at + 4].hex()
        size = VALUE_SIZES[kind] * count
        begin = at if size <= 4 else self.number(at, 4)
        raw = self.data[begin : begin + size]
        if kind == 2 or kind == 7 and (core := raw.rstrip(b"\0")) and PRINTABLE.issuperset(core):
            return raw.rstrip(b"\0").decode("utf-8", "replace")
        if kind == 7:
            return raw.hex()
        if kind == 1:
            return list(raw)
        unit = {3: "H", 4: "I", 5: "I", 9: "i", 10: "i"}[kind]
        width = struct.calcsize(unit)
        if len(raw) % VALUE_SIZES[kind]:
            raise Broken("a cut TIFF value")
        values = [x for (x,) in struct.iter_unpack(self.order + unit, raw[: len(raw) // width * width])]
        if kind in (5, 10):
            values = [list(x) for x in zip(values[::2], values[1::2])]
        return values[0] if count == 1 and values else values


def jpeg_exif(data: bytes) -> dict:
    for marker, begin, end in jpeg_segments(data, fill=False):
        if marker == 0xE1 and data[begin : begin + 6] == b"Exif\0\0":
            return Tiff(data[begin + 6 : end]).read()
    return {}


def webp_exif(data: bytes) -> dict:
    if len(data) < 16 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise Broken("no WEBP header")
    at = 12
    while at + 8 <= len(data):
        n = _number(data, at + 4, 4, "<")
        if data[at : at + 4] == b"EXIF":
            return Tiff(data[at + 8 : at + 8 + n].removeprefix(b"Exif\0\0")).read()
        at += 8 + n + n % 2
    return {}


def strings_of(exif: dict) -> dict[str, str]:
    """All non-empty strings of a nested Exif by key; deeper and later ones win."""
    out: dict[str, str] = {}
    for key, value in exif.items():
        if isinstance(value, dict):
            out |= strings_of(value)
        elif isinstance(value, str) and value:
            out[key] = value
    return out


def metadata(extension: str, data: bytes) -> dict:
    """source_format, raw_text, png_text, exif (JSON) and error of one file; source_format is null where nothing is embedded."""
    none = {"source_format": None, "raw_text": None, "png_text": None, "exif": None, "error": None}
    try:
        if extension == ".png":
            text = png_text(data)
            return none | {"source_format": "png_text", "raw_text": text, "png_text": text} if text else none
        if extension in (".jpg", ".jpeg", ".webp"):
            exif = webp_exif(data) if extension == ".webp" else jpeg_exif(data)
            if exif:
                return none | {"source_format": "webp_exif" if extension == ".webp" else "jpeg_exif", "raw_text": strings_of(exif), "exif": json.dumps(exif)}
        return none
    except (ValueError, struct.error, zlib.error) as e:
        return none | {"error": str(e) or type(e).__name__}


# --- pixels -----------------------------------------------------------------------------------------------------------------
def decode_png(data: bytes) -> np.ndarray:
    """Gray values [row, column] as floats of an 8-bit, not interlaced PNG: 0.299 R + 0.587 G + 0.114 B."""
    width, height = png_size(data)
    depth, color, _, _, interlace = data[24:29]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlace or channels is None or not width or not height:
        raise Broken("pixels of this kind are not decoded")
    at, packed, palette = 8, [], None
    while at + 8 <= len(data):
        n, kind = _number(data, at, 4, ">"), data[at + 4 : at + 8]
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        elif kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + n], np.uint8).reshape(-1, 3)
        at += n + 12
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) < height * (width * channels + 1):
        raise Broken("pixels are missing")
    raw = raw[: height * (width * channels + 1)].reshape(height, width * channels + 1)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y in range(height):
        line, kind = raw[y, 1:].astype(np.int64), raw[y, 0]
        if kind == 2:
            line = (line + above) & 255
        elif kind:
            for x in range(len(line)):
                a = line[x - channels] if x >= channels else 0
                c = above[x - channels] if x >= channels else 0
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + above[x]) // 2
                else:
                    p = a + above[x] - c
                    guess = min((abs(p - a), 0, a), (abs(p - above[x]), 1, above[x]), (abs(p - c), 2, c))[2]
                line[x] = (line[x] + guess) & 255
        out[y] = above = line
    pixels = out.reshape(height, width, channels)
    if color == 3:
        if palette is None:
            raise Broken("no palette")
        pixels = palette[np.minimum(pixels[:, :, 0], len(palette) - 1)]
    rgb = pixels[:, :, :3].astype(float) if pixels.shape[2] >= 3 else np.repeat(pixels[:, :, :1], 3, 2).astype(float)
    return rgb @ np.array([0.299, 0.587, 0.114])


def decode(extension: str, data: bytes) -> np.ndarray:
    """Gray values; formats other than PNG need the optional Pillow."""
    if extension == ".png":
        return decode_png(data)
    try:
        import io

        from PIL import Image
    except ImportError:
        raise Broken("no decoder for this format is installed") from None
    return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"), float) @ np.array([0.299, 0.587, 0.114])


def resize_nearest(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    rows, columns = (np.minimum(np.arange(n) * m // n, m - 1) for n, m in ((height, gray.shape[0]), (width, gray.shape[1])))
    return gray[rows][:, columns]


def perceptual_hash(gray: np.ndarray, size: int = 8) -> str:
    """16 hex digits: which of the size x size lowest DCT coefficients of a square matrix reach the median of all but the first."""
    n = len(gray)
    basis = np.cos((2 * np.arange(n) + 1) * np.arange(size)[:, None] * math.pi / (2 * n))
    scale = np.sqrt(np.where(np.arange(size) == 0, 1, 2) / n)
    low = (scale[:, None] * scale * (basis @ gray @ basis.T)).ravel()
    return f"{int(''.join('1' if v >= np.median(low[1:]) else '0' for v in low), 2):016x}"


PROBE = "width int, height int, issues array<string>"
METADATA = "source_format string, raw_text map<string,string>, png_text map<string,string>, exif string, error string"
PIXELS = "gray array<array<int>>, small array<array<int>>, perceptual_hash string, error string"


def probe_column(extension: Column, content: Column) -> Column:
    """struct<width, height, issues>, in Arrow batches."""

    @F.pandas_udf(PROBE)
    def run(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([probe(e, d) for e, d in zip(ext, data)], columns=["width", "height", "issues"]).astype({"width": "Int32", "height": "Int32"})

    return run(extension, content)


def metadata_column(extension: Column, content: Column) -> Column:
    """struct of METADATA, in Arrow batches."""

    @F.pandas_udf(METADATA)
    def run(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([metadata(e, d or b"") for e, d in zip(ext, data)], columns=["source_format", "raw_text", "png_text", "exif", "error"])

    return run(extension, content)


def pixels_column(extension: Column, content: Column) -> Column:
    """struct of PIXELS: the 32 x 32 gray matrix, its 9 x 8 reduction, the perceptual hash."""

    @F.pandas_udf(PIXELS)
    def run(ext: pd.Series, data: pd.Series) -> pd.DataFrame:
        out = []
        for e, d in zip(ext, data):
            try:
                gray = np.floor(resize_nearest(decode(e, d or b""), 32, 32) + 0.5).astype(int)
                out.append((gray.tolist(), resize_nearest(gray, 9, 8).tolist(), perceptual_hash(gray.astype(float)), None))
            except (ValueError, struct.error, zlib.error, OSError) as error:
                out.append((None, None, None, str(error)))
        return pd.DataFrame(out, columns=["gray", "small", "perceptual_hash", "error"])

    return run(extension, content)


def native_png_size(content: Column) -> Column:
    """struct<width, height> of a PNG header without any Python; null where there is none."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("bigint")
    good = (F.octet_length(content) >= 24) & (F.hex(F.substring(content, 1, 8)) == PNG.hex().upper())
    return F.when(good, F.struct(number(17).alias("width"), number(21).alias("height")))

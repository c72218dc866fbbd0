"""A small tree of files to try a run on: PNG files of single colours with embedded text, one file that is no image, one that is no candidate."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(width: int, height: int, colour: tuple[int, int, int] = (16, 240, 128), texts: dict[str, str] | None = None) -> bytes:
    """An RGB image of one colour, with a text chunk per entry of `texts`."""
    rows = (b"\0" + bytes(colour) * width) * height
    told = b"".join(chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1", "replace")) for k, v in (texts or {}).items())
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + told + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_tree(root: str | Path) -> Path:
    """The tree under `root`, which is made if need be; files of these names are written anew, others stay."""
    root = Path(root)
    blue, prompt = (20, 40, 200), "parameters"
    files = {
        "harbour.png": png(64, 48, blue, {prompt: "harbour at night, cinematic photo\nNegative prompt: blur\nSteps: 20, Sampler: Euler, CFG scale: 7, Seed: 11, Model: house-v1"}),
        "again/harbour_copy.png": png(64, 48, blue, {prompt: "harbour at night, cinematic photo\nNegative prompt: blur\nSteps: 20, Sampler: Euler, CFG scale: 7, Seed: 11, Model: house-v1"}),
        "again/garden.png": png(48, 64, (30, 160, 60), {prompt: "garden in spring, watercolor brush\nSteps: 24, Sampler: DDIM, CFG scale: 6, Seed: 5, Model: house-v2"}),
        "plain.png": png(32, 32, (90, 90, 90)),
        "damaged.png": b"not an image",
        "notes.txt": b"no candidate",
    }
    for name, content in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    return root

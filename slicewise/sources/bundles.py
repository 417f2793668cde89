"""Seekable Zstandard bundles: frames compressed on their own and a seek table as the footer.

A bundle is its frames and, in a skippable frame at its end, the sizes of all of them, so
that any frame can be found and read alone.
"""

from __future__ import annotations

import io
import struct

FRAME_BYTES = 1 << 18
LEVEL = 3
#: Fixed values of the format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


class Bundle:
    """A bundle being written: frames, then the seek table."""

    def __init__(self, out) -> None:
        import zstandard
        self.out, self.pack = out, zstandard.ZstdCompressor(level=LEVEL).compress
        self.sizes: list[tuple[int, int]] = []
        self.at, self.frame = 0, io.BytesIO()

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame number, frame's place in the bundle, offset in the frame) of a record."""
        place = len(self.sizes), self.at, self.frame.tell()
        self.frame.write(data)
        if self.frame.tell() >= FRAME_BYTES:
            self.flush()
        return place

    def flush(self) -> None:
        if plain := self.frame.getvalue():
            packed = self.pack(plain)
            self.out.write(packed)
            self.sizes.append((len(packed), len(plain)))
            self.at += len(packed)
            self.frame = io.BytesIO()

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        self.out.close()


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(place, packed bytes, plain bytes) of the frames, from the footer of an open bundle."""
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - 9 - 8 * n)
    flat = struct.unpack(f"<{2 * n}I", source.read(8 * n))
    out, at = [], 0
    for packed, plain in zip(flat[::2], flat[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(source, place: int, packed: int, plain: int) -> bytes:
    import zstandard
    source.seek(place)
    return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=plain)

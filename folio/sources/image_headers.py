"""Format, size and bands of an image from its header, through a window that reads what it is asked for.

``at(position, n)`` returns up to ``n`` bytes at ``position``: a slice of bytes in memory, or a seek and a
short read in a file. JPEG segments are skipped by their length and TIFF directories found by their
offset, so no format needs the bytes that lie between.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

Window = Callable[[int, int], bytes]
Facts = tuple[str, "int | None", "int | None", "int | None"]

# Fixed value: PNG colour type -> number of bands.
PNG_BANDS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png(at: Window) -> Facts:
    w, h, _, color = struct.unpack(">IIBB", at(16, 10))
    return "PNG", w, h, PNG_BANDS.get(color)


def _gif(at: Window) -> Facts:
    return "GIF", *struct.unpack("<HH", at(6, 4)), 1


def _bmp(at: Window) -> Facts:
    w, h = struct.unpack("<Ii", at(18, 8))
    (bits,) = struct.unpack("<H", at(28, 2))
    return "BMP", w, abs(h), 3 if bits >= 16 else 1


def _jpeg(at: Window) -> Facts | None:
    place = 2
    while len(head := at(place, 10)) == 10 and head[0] == 0xFF:
        marker = head[1]
        if marker == 0xFF:  # fill bytes may stand before a marker
            place += 1
        elif marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            place += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w, bands = struct.unpack(">HHB", head[5:10])
            return "JPEG", w, h, bands
        else:
            place += 2 + struct.unpack(">H", head[2:4])[0]
    return None


def _tiff(at: Window) -> Facts:
    order = "<" if at(0, 2) == b"II" else ">"
    (directory,) = struct.unpack(order + "I", at(4, 4))
    (n,) = struct.unpack(order + "H", at(directory, 2))
    entries = at(directory + 2, 12 * n)
    tags = {}
    for k in range(n):
        tag, kind, _, short, _ = struct.unpack(order + "HHIHH", entries[12 * k : 12 * k + 12])
        tags[tag] = short if kind == 3 else struct.unpack(order + "I", entries[12 * k + 8 : 12 * k + 12])[0]
    return "TIFF", tags.get(256), tags.get(257), tags.get(277, 1)


def _webp(at: Window) -> Facts | None:
    b = at(12, 20)
    kind = b[:4]
    if kind == b"VP8X":
        return "WEBP", int.from_bytes(b[12:15], "little") + 1, int.from_bytes(b[15:18], "little") + 1, 4 if b[8] & 0x10 else 3
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", b[14:18])
        return "WEBP", w & 0x3FFF, h & 0x3FFF, 3
    if kind == b"VP8L":
        bits = int.from_bytes(b[9:13], "little")
        return "WEBP", (bits & 0x3FFF) + 1, ((bits >> 14) & 0x3FFF) + 1, 4 if (bits >> 28) & 1 else 3
    return None


def read_facts(at: Window) -> Facts | None:
    """``(format, width, height, bands)``; None for bytes of no known kind, None fields where a header is cut."""
    magic = at(0, 12)
    try:
        if magic[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(at)
        if magic[:4] == b"GIF8":
            return _gif(at)
        if magic[:2] == b"BM":
            return _bmp(at)
        if magic[:4] == b"%PDF":
            return "PDF", None, None, None
        if magic[:3] == b"\xff\xd8\xff":
            return _jpeg(at)
        if magic[:4] in (b"II*\x00", b"MM\x00*"):
            return _tiff(at)
        if magic[:4] == b"RIFF" and magic[8:12] == b"WEBP":
            return _webp(at)
    except (struct.error, IndexError, ValueError):
        return None
    return None

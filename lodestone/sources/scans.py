"""Scans of bytes into rows: strings, numeric tables, containers, images, tagged fields.

Plain functions of one file's bytes; :mod:`lodestone.sources.files` runs them over tables of files."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from math import log2

#: How files begin, with the type and the confidence it gives.
MAGIC = (
    (b"CPYUA", "unicode_project", 0.99),
    (b"CPYA", "legacy_project", 0.99),
    (b"PK\x03\x04", "zip", 0.8),
    (b"SQLite format 3\x00", "sqlite_db", 0.8),
    (b"\x89PNG\r\n\x1a\n", "png", 0.9),
    (b"%PDF-", "pdf", 0.9),
    (b"\x1f\x8b", "gzip", 0.8),
)
#: Fixed value: the last bytes of a complete unicode project.
TRAILER = bytes.fromhex("04 10 00 00 04 95 04 10 00 00 05 80 01 18 90 01 3e c0 11 01 01 91 04 10 00 00 06 80 01 04 95 04 10 00 00 07 80 01 20 90 01 5d c0 11 03 01 00 01 96 0a")


def detect(head: bytes) -> tuple[str, float, str]:
    """Type, confidence and reason from the first bytes; a name is no evidence."""
    for magic, kind, confidence in MAGIC:
        if head.startswith(magic):
            return kind, confidence, "magic"
    return "unknown", 0.05, "no-match"


def string_spans(data: bytes, least: int = 4) -> list[tuple[int, str]]:
    """Runs of printable ASCII with their offsets."""
    return [(m.start(), m.group().decode("ascii")) for m in re.finditer(rb"[ -~]{%d,}" % max(1, least), data)]


_NUMBER = re.compile(r"[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?|[+-]?(?:inf|infinity|nan)", re.IGNORECASE)


def numeric_tables(data: bytes, min_rows: int = 5, min_columns: int = 2) -> list[tuple[int, int, int, list[str]]]:
    """Consecutive lines of numbers: table, row, offset, values.  Dropped tables keep their numbers."""
    out, table, row, at = [], 0, 0, 0
    held: list[tuple[int, int, int, list[str]]] = []

    def close() -> None:
        if len(held) >= min_rows:
            out.extend(held)
        held.clear()

    for raw in data.split(b"\n"):
        try:
            parts = re.split(r"[\t;,\s]+", raw.decode("utf-8").strip("\t;, \r\n\f\v"))
        except UnicodeDecodeError:
            parts = []
        if len(parts) >= min_columns and all(_NUMBER.fullmatch(p) for p in parts):
            if not held:
                table, row = table + 1, 0
            row += 1
            held.append((table, row, at, parts))
        else:
            close()
        at += len(raw) + 1
    close()
    return out


def entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * log2(c / n) for c in Counter(data).values()) if n else 0.0


def containers(data: bytes, least_text: int = 64) -> list[tuple[str, int, int, float]]:
    """Regions that look like other formats: kind, offset, length, confidence."""
    out = []
    for m in re.finditer(rb"PK\x03\x04", data):
        end = data.find(b"PK\x05\x06", m.start())
        if end >= 0 and end + 22 <= len(data):
            tail = int.from_bytes(data[end + 20 : end + 22], "little")
            out.append(("zip_like", m.start(), min(len(data), end + 22 + tail) - m.start(), 0.92))
    for m in re.finditer(re.escape(b"SQLite format 3\x00"), data):
        a = m.start()
        page, pages = int.from_bytes(data[a + 16 : a + 18], "big"), int.from_bytes(data[a + 28 : a + 32], "big")
        page = 65536 if page == 1 else page
        if page >= 512 and page & (page - 1) == 0 and pages:
            out.append(("sqlite_like", a, min(page * pages, len(data) - a), 0.96))
    for m in re.finditer(rb"\x78[\x01\x5e\x9c\xda]", data):
        inflate = zlib.decompressobj()
        try:
            got = inflate.decompress(data[m.start() :], 1 << 20)
        except zlib.error:
            continue
        if inflate.eof and got:
            out.append(("zlib_like", m.start(), len(data) - m.start() - len(inflate.unused_data), 0.88))
    for m in re.finditer(rb"[\t\r\n -~]{%d,}" % least_text, data):
        out.append(("text_island", m.start(), m.end() - m.start(), 0.5))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _png_end(data: bytes, at: int) -> int | None:
    p = at + 8
    while p + 12 <= len(data):
        size = int.from_bytes(data[p : p + 4], "big")
        end = p + 12 + size
        if end > len(data) or zlib.crc32(data[p + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if data[p + 4 : p + 8] == b"IEND":
            return end
        p = end
    return None


def _jpeg_end(data: bytes, at: int) -> int | None:
    p, frame = at + 2, False
    while p + 4 <= len(data) and data[p] == 0xFF:
        marker, size = data[p + 1], int.from_bytes(data[p + 2 : p + 4], "big")
        if size < 2 or p + 2 + size > len(data):
            return None
        frame |= 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)
        p += 2 + size
        if marker == 0xDA:
            end = data.find(b"\xff\xd9", p)
            return end + 2 if frame and end >= 0 else None
    return None


def _gif_end(data: bytes, at: int) -> int | None:
    if at + 13 > len(data):
        return None
    flags = data[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(data):
            if not data[p]:
                return p + 1
            p += 1 + data[p]
        return None

    while p is not None and p < len(data):
        if data[p] == 0x3B:
            return p + 1
        if data[p] == 0x21:
            p = blocks(p + 2)
        elif data[p] == 0x2C and p + 10 < len(data):
            local = data[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp_end(data: bytes, at: int) -> int | None:
    size, pixels, header = (int.from_bytes(data[at + a : at + a + 4], "little") for a in (2, 10, 14))
    return at + size if header in (12, 40, 52, 56, 108, 124) and 26 <= pixels < size and at + size <= len(data) else None


def _pdf_end(data: bytes, at: int) -> int | None:
    end = data.find(b"%%EOF", at)
    return end + 5 if end >= 0 else None


def _svg_end(data: bytes, at: int) -> int | None:
    m = re.compile(rb"</svg\s*>", re.IGNORECASE).search(data, at)
    return m.end() if m else None


_IMAGES = ((rb"\x89PNG\r\n\x1a\n", "png", _png_end), (rb"\xff\xd8\xff", "jpeg", _jpeg_end), (rb"GIF8[79]a", "gif", _gif_end), (rb"BM(?=....\x00\x00\x00\x00)", "bmp", _bmp_end), (rb"%PDF-", "pdf", _pdf_end), (rb"(?i:<svg\b)", "svg", _svg_end))


def images(data: bytes) -> list[tuple[str, int, int, bool]]:
    """Images by their signatures: kind, offset, length, whether the end is valid.  One that starts inside the last kept one is dropped."""
    hits = []
    for pattern, kind, find in _IMAGES:
        for m in re.finditer(pattern, data, re.DOTALL):
            end = find(data, m.start())
            if end is not None or kind == "png":
                hits.append((kind, m.start(), (end or len(data)) - m.start(), end is not None))
    out, limit = [], 0
    for hit in sorted(hits, key=lambda x: (x[1], x[0])):
        if hit[1] >= limit:
            out.append(hit)
            limit = hit[1] + hit[2] if hit[3] else hit[1] + 1
    return out


def _is_text(raw: bytes) -> bool:
    return all(b in (9, 10, 13) or 32 <= b < 127 for b in raw)


def tagged_strings(data: bytes, start: int = 0) -> list[tuple[int, int, int, str]]:
    """Fields ``length 80 tag text 00``: offset of the text, length, tag, text."""
    out, at = [], data.find(b"\x80")
    while at >= 0:
        n = data[at - 1] if at else 0
        raw = data[at + 2 : at + 2 + n]
        if n >= 2 and len(raw) == n and raw[-1] == 0 and _is_text(raw[:-1]):
            out.append((start + at + 2, n, data[at + 1], raw[:-1].decode("ascii")))
        at = data.find(b"\x80", at + 1)
    return out


#: Fixed values of the format: sizes that scalar fields have.
SCALAR_SIZES = frozenset({1, 3, 4, 5, 6, 9, 13, 21})


def tagged_scalars(data: bytes, start: int = 0) -> list[tuple[int, int, int, bytes]]:
    """Fields ``code c0 11 size value``: offset, field code, size, value."""
    out, at = [], data.find(b"\xc0\x11", 1)
    while at >= 0:
        size = data[at + 2] if at + 2 < len(data) else 0
        value = data[at + 3 : at + 3 + size]
        if size in SCALAR_SIZES and len(value) == size:
            out.append((start + at - 1, data[at - 1], size, value))
            at = data.find(b"\xc0\x11", at + 3 + size + 1)
        else:
            at = data.find(b"\xc0\x11", at + 1)
    return out

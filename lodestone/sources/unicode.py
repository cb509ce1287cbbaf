"""The unicode project format: stored columns, storage regions, and the walk over both.

A file begins with a line ``CPYUA version length``.  Columns have no directory:
a name, at most sixteen bytes, a fixed prefix, the payload's length, eight bytes
and the payload (see :mod:`columns`).  Markup lies between storage tags, plain or
as an LZ4 block.  What isn't recognised is left out; a gap says so.

Parameters and length blocks of the legacy format are here, too: like columns
they are found by sliding over bytes."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from . import codecs, columns

#: Fixed values of the format.
MAGIC = b"CPYUA"
LEGACY_MAGIC = b"CPYA"
ROW_PREFIX = b"\x18\x18" + b"\0" * 7
COLUMN_NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_@-]{1,63}")
SHORT_NAME = re.compile(rb"(?:N2N|O2O)_[A-Z](?:@\d+)?")
PRELUDE, PRELUDE_MARK = b"\xfa", b"\x01\x0bSYSTEM"
OPEN, CLOSE = b"<originstorage", b"</originstorage>"
MAX_PAYLOAD, NAME_REACH, NAME_GAP = 10_000_000, 80, 16
NEAR, FAR = 64, 512
MAX_PARAMETERS, SCAN_WINDOW = 128, 4 << 20


def column_name(data: bytes, prefix: int) -> re.Match | None:
    """The name before a column's prefix: the last one that its length byte frames, or a short name, that ends near the prefix."""
    found = []
    for pattern in (COLUMN_NAME, SHORT_NAME):
        for m in pattern.finditer(data, max(0, prefix - NAME_REACH), prefix):
            framed = m.start() > 0 and data[m.start() - 1] == len(m.group())
            if (framed or SHORT_NAME.fullmatch(m.group())) and prefix - m.end() <= NAME_GAP:
                found.append(m)
    return max(found, key=lambda m: (m.end(), m.start()), default=None)


def descriptors(data: bytes) -> Iterator[dict]:
    """Stored columns: name, start, end, where the payload lies, and what it decodes to (None if it isn't exactly a column)."""
    before = None
    at = data.find(ROW_PREFIX)
    while at >= 0:
        name = column_name(data, at)
        length_at = at + len(ROW_PREFIX)
        payload = length_at + 16
        size = int.from_bytes(data[length_at : length_at + 8], "little")
        if name is not None and payload <= len(data) and 0 < size <= MAX_PAYLOAD and payload + size <= len(data):
            start = name.start() - (name.start() > 0 and data[name.start() - 1] == len(name.group()))
            if before is not None:
                gap = data[before : name.start()] if before <= name.start() else b""
                if 0 <= name.start() - before <= NEAR or (0 < len(gap) <= FAR and gap.startswith(PRELUDE) and PRELUDE_MARK in gap[:64]):
                    start = before
            before = payload + size
            yield {"name": name.group().decode("ascii"), "start": start, "end": before, "payload": payload, "size": size, "column": columns.decode(data[payload:before])}
        at = data.find(ROW_PREFIX, at + len(ROW_PREFIX))


def column_rows(data: bytes) -> Iterator[tuple]:
    """A row for each stored column: ordinal, name, start, end, payload offset and length, encoding, rows, missing cells, value type."""
    for n, d in enumerate(descriptors(data)):
        c = d["column"]
        yield n + 1, d["name"], d["start"], d["end"], d["payload"], d["size"], c.encoding if c else None, len(c.cells) if c else None, c.missing if c else None, columns.value_type(c) if c else None


def cells(data: bytes) -> Iterator[tuple]:
    """All stored values: ordinal, name, row, kind, double, integer, text."""
    for n, d in enumerate(descriptors(data)):
        for row, c in enumerate(d["column"].cells if d["column"] else ()):
            yield n + 1, d["name"], row, c.kind, c.value if c.kind == "float" else None, c.integer, c.text


def matching_close(low: bytes, start: int) -> int:
    """The end of the storage element that opens at `start`, nested ones counted; -1 without one."""
    depth, at = 0, start
    while True:
        opens, closes = low.find(OPEN, at), low.find(CLOSE, at)
        if closes < 0:
            return -1
        if 0 <= opens < closes:
            depth, at = depth + 1, opens + len(OPEN)
        else:
            depth, at = depth - 1, closes + len(CLOSE)
            if depth <= 0:
                return at


def raw_regions(data: bytes) -> Iterator[tuple[int, int]]:
    """Spans of plain storage elements, by their outermost tags; without a matching close up to the first one."""
    low, at = data.lower(), 0
    while (start := low.find(OPEN, at)) >= 0:
        end = matching_close(low, start)
        if end < 0:
            close = low.find(CLOSE, start + len(OPEN))
            end = close + len(CLOSE) if close >= 0 else -1
        if end < 0:
            at = start + len(OPEN)
            continue
        yield start, end
        at = end


def decoded_regions(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Regions packed as a size of four bytes and an LZ4 block whose first literals are a storage tag: start, end, payload."""
    low, at = data.lower(), 0
    while (tag := low.find(OPEN, at)) >= 0:
        at = tag + len(OPEN)
        size = int.from_bytes(data[tag - 6 : tag - 2], "little") if tag >= 6 else 0
        if 0 < size <= 1 << 28:
            try:
                payload, used = codecs.lz4_decode(data[tag - 2 :], size)
            except codecs.CodecError:
                continue
            if payload.lower().startswith(OPEN):
                yield tag - 2, tag - 2 + used, payload


def walk(data: bytes) -> Iterator[tuple]:
    """What is in a file, by start, end, kind and name: header, columns, plain and decoded regions, and the gaps between them."""
    if not data.startswith(MAGIC):
        return
    line = data.find(b"\n") + 1
    found = [(0, line or len(data), "header", "header")]
    found += [(d["start"], d["end"], "column", d["name"]) for d in descriptors(data)]
    packed = [(a, b, "decoded_region", f"decoded_{a}") for a, b, _ in decoded_regions(data)]
    found += packed
    found += [(a, b, "raw_region", f"raw_{a}") for a, b in raw_regions(data) if not any(x <= a < y for x, y, *_ in packed)]
    found = sorted(set(found))
    reach = 0
    for a, b, *_ in list(found):
        if a > reach:
            found.append((reach, a, "gap", f"gap_{reach}"))
        reach = max(reach, b)
    if reach < len(data):
        found.append((reach, len(data), "gap", f"gap_{reach}"))
    yield from sorted(found)


def parameters(data: bytes) -> Iterator[tuple[str, float, int, int]]:
    """Records of the legacy format of a name, a line feed, a double and a line feed: name, value, offset, length."""
    if not data.startswith(LEGACY_MAGIC):
        return
    end, at, n = min(len(data), SCAN_WINDOW), data.find(b"\n") + 1, 0
    while at + 10 < end and n < MAX_PARAMETERS:
        if data[at] == 0:
            if data[at + 1 : at + 2] == b"\n":
                return
            at += 1
        elif data[at] == 0x0A:
            at += 1
        else:
            feed = data.find(b"\n", at + 1, end)
            if feed < 0:
                return
            name, good = data[at:feed], True
            good = len(name) <= 64 and all(0x21 <= c <= 0x7E for c in name) and (name[:1].isalpha() or name[:1] == b"_")
            if good and feed + 10 > end:
                return
            if good and data[feed + 9] == 0x0A:
                yield name.decode("ascii"), struct.unpack_from("<d", data, feed + 1)[0], at, feed + 10 - at
                at, n = feed + 10, n + 1
            else:
                at = feed + 1


def length_blocks(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Framed blocks of the legacy format, found by sliding over its first bytes: start, end, payload."""
    line = data.find(b"\n")
    if not data.startswith(LEGACY_MAGIC) or line < 0:
        return
    at, stop = line + 1, min(len(data), line + 1 + SCAN_WINDOW)
    while at < stop:
        if at + 5 > len(data) or data[at + 4] != 0x0A:
            at += 1
            continue
        size = int.from_bytes(data[at : at + 4], "little")
        if not 0 < size <= SCAN_WINDOW:
            at += 5
            continue
        end = at + 5 + size
        if end + 1 > len(data) or data[end] != 0x0A:
            at += 1
            continue
        yield at, end + 1, data[at + 5 : end]
        at = end + 1


# An encoder, for fixtures and round trips.


def pack_column(name: str, payload: bytes, between: bytes = b"") -> bytes:
    return bytes([len(name)]) + name.encode() + between + ROW_PREFIX + len(payload).to_bytes(8, "little") + bytes(8) + payload


def pack_region(text: bytes) -> bytes:
    """A storage element as an LZ4 block of literals behind its size."""
    return len(text).to_bytes(4, "little") + codecs.lz4_encode(text)


def pack_file(parts: list[bytes], version: str = "4.3380") -> bytes:
    return f"{MAGIC.decode()} {version} 200\n".encode() + b"".join(parts)


def pack_parameters(values: list[tuple[str, float]]) -> bytes:
    return LEGACY_MAGIC + b" 4.2673 552#\n" + b"".join(n.encode() + b"\n" + struct.pack("<d", v) + b"\n" for n, v in values) + b"\0\n"

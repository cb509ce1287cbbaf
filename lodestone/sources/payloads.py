"""What a decoded region holds: markup, a set of strings, references to calculations, or style holders.

A payload is of a family only if it is exactly one; with a family's mark but
other bytes it is invalid, and everything else is unknown."""

from __future__ import annotations

import struct

#: Fixed values of the format: marks at the start, and the size and number of reference records.
STRINGS, STYLES, STYLE_CHILD = 0x11111177, 0x11111172, b"\x6d\x11\x11\x11"
REFERENCE, MOST = 24, 1024


def _number(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 4], "little")


def string_set(data: bytes) -> list[str] | None:
    """Texts of a string set: header (28 bytes in all with the end), texts each ended by a zero, four more bytes."""
    _, _, _, _, _, size, count = struct.unpack_from("<IHHIIII", data)
    body = data[24 : 24 + size]
    if len(data) != size + 28 or body[-1:] != b"\0" or body.count(b"\0") != count:
        return None
    try:
        return [x.decode("utf-8") for x in body[:-1].split(b"\0")]
    except UnicodeDecodeError:
        return None


def family(data: bytes) -> tuple[str, int | None]:
    """The family of a payload and how many records it has."""
    if data[:64].lstrip().lower().startswith((b"<originstorage", b"<?xml")):
        return "origin_storage_xml", None
    if len(data) >= 28 and _number(data, 0) == STRINGS:
        texts = string_set(data)
        return ("recognized_payload_invalid", None) if texts is None else ("mser_strings_pset", len(texts))
    if len(data) >= 12 and _number(data, 0) == 0:
        n = _number(data, 4)
        if 0 < n <= MOST and len(data) == 12 + REFERENCE * n and _number(data, len(data) - 4) == 0:
            return "storage_cell_ref_data", n
    if len(data) >= 24 and _number(data, 0) == STYLES:
        n = _number(data, 12)
        good = 0 < n <= MOST and _number(data, len(data) - 4) == 0 and data[16:20] == STYLE_CHILD and data.count(STYLE_CHILD, 16, len(data) - 4) == n
        return ("style_holder_source_info_v1", n) if good else ("recognized_payload_invalid", None)
    return "unknown", None


def pack_strings(texts: list[str]) -> bytes:
    body = b"".join(t.encode() + b"\0" for t in texts)
    return struct.pack("<IHHIIII", STRINGS, 1, 0, 0, 0, len(body), len(texts)) + body + bytes(4)


def pack_references(n: int) -> bytes:
    return bytes(4) + n.to_bytes(4, "little") + bytes(REFERENCE * n) + bytes(4)

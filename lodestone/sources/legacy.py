"""The legacy project format as rows: framed objects, datasets, cells, parameters.

A file is a signature line and then frames: a little-endian size with a line
feed, and, for a size over 0, that many bytes with a line feed.  A size of 0 ends a
list.  One pass turns the bytes into numbered frames with their nesting known
from the lists' order; everything else is a function of frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

#: Fixed value of the format: what a missing cell holds.
MISSING = -1.23456789e-300
#: Fixed values of the format: where a dataset header's fields lie (offset, size).
FIELDS = {"data_type": (0x16, 2), "data_type2": (0x18, 1), "total_rows": (0x19, 4), "first_row": (0x1D, 4), "last_row": (0x21, 4), "value_size": (0x3D, 1), "data_type_u": (0x3F, 1), "data_type3": (0x71, 2)}
NAME = (0x58, 25)


class Damaged(ValueError):
    """A frame doesn't follow the format at `offset`."""

    def __init__(self, why: str, offset: int):
        super().__init__(f"{why} at {offset}")
        self.offset = offset


class Truncated(Damaged):
    """A declared size runs past the end of the file: definitive evidence of a cut."""


@dataclass(frozen=True)
class Frame:
    start: int
    payload: int
    size: int
    end: int


def signature(data: bytes) -> tuple[str, str, int]:
    """Version, build and the offset after the signature line."""
    line = data[: data.find(b"\n")] if b"\n" in data[:256] else b""
    parts = line.decode("latin-1").split()
    if len(parts) < 3 or parts[0] != "CPYA":
        raise Damaged("no signature line", 0)
    return parts[1], parts[2].rstrip("#"), len(line) + 1


def frame(data: bytes, at: int, strict: bool = True) -> Frame:
    """The frame at an offset."""
    if at + 5 > len(data):
        raise Truncated("no room for a size", at)
    size = int.from_bytes(data[at : at + 4], "little")
    if strict and data[at + 4] != 0x0A:
        raise Damaged("no line feed after a size", at + 4)
    if not size:
        return Frame(at, at + 5, 0, at + 5)
    end = at + 5 + size
    if end + 1 > len(data):
        raise Truncated("an object runs past the end", at)
    if strict and data[end] != 0x0A:
        raise Damaged("no line feed after an object", end)
    return Frame(at, at + 5, size, end + 1)


def header_fields(raw: bytes) -> dict | None:
    """A dataset header's fields; None if it isn't one."""
    if len(raw) < 0x73:
        return None
    name = raw[NAME[0] : NAME[0] + NAME[1]].split(b"\0", 1)[0].decode("utf-8", "replace")
    if not name or name[0].isdigit() or not all(c.isalnum() or c in "._-@" for c in name):
        return None
    return {"name": name} | {k: int.from_bytes(raw[a : a + n], "little") for k, (a, n) in FIELDS.items()}


def cell(raw: bytes, size: int, data_type: int, unsigned: bool) -> tuple[str, float | None, int | None, str | None]:
    """Kind, double, integer and text of one stored value."""
    if size in (1, 2) or size == 4 and data_type & 0x800:
        return "integer", None, int.from_bytes(raw, "little", signed=not unsigned), None
    mixed = size > 8 and data_type & 0x100
    if size in (4, 8) or mixed and raw[:1] != b"\1":
        value = struct.unpack("<f", raw)[0] if size == 4 else struct.unpack("<d", raw[2:10].ljust(8, b"\0") if mixed else raw)[0]
        return ("missing", None, None, None) if value == MISSING else ("float", value, None, None)
    text = (raw[2:] if mixed else raw).split(b"\0", 1)[0].decode("utf-8", "replace")
    return "text", None, None, text


def elements(data: bytes, tolerant: bool = True) -> Iterator[dict]:
    """Header, datasets and, as far as they are framed, the lists after them: kind, name, start, end, and a dataset's fields.

    A tolerant walk ends where the format does; a strict one raises."""
    try:
        _, _, at = signature(data)
        top = frame(data, at)
        mark = frame(data, top.end)
        if mark.size:
            raise Damaged("the global header isn't ended", mark.start)
        yield {"kind": "global_header", "name": "global_header", "start": top.start, "end": mark.end}
        at = mark.end
        while (head := frame(data, at)).size:
            values = frame(data, head.end)
            mask = frame(data, values.end)
            fields = header_fields(data[head.payload : head.payload + head.size]) or {"name": "dataset"} | dict.fromkeys(FIELDS, 0)
            yield {"kind": "dataset", "start": head.start, "end": mask.end, "data_offset": values.payload, "data_size": values.size, **fields}
            at = mask.end
        at = head.end
        while at < len(data):  # windows and what follows: framed objects, whose inner lists aren't told apart here
            own = frame(data, at)
            yield {"kind": "object" if own.size else "list_end", "name": _label(data[own.payload : own.payload + own.size]), "start": own.start, "end": own.end}
            at = own.end
    except Damaged:
        if not tolerant:
            raise


def _label(raw: bytes) -> str:
    """The first name in an object: a run of name characters that a zero ends."""
    for part in raw[:256].split(b"\0"):
        if 2 <= len(part) <= 64 and part.isascii() and part[:1].isalpha() and all(chr(c).isalnum() or c in b"._-@" for c in part):
            return part.decode()
    return ""


def truncated_at(data: bytes) -> int | None:
    """Where a declared size runs past the end; None without such evidence."""
    try:
        for _ in elements(data, tolerant=False):
            pass
    except Truncated as e:
        return e.offset
    except Damaged:
        pass
    return None


def cells(data: bytes) -> Iterator[tuple]:
    """All stored values: dataset number, name, row, kind, double, integer, text."""
    for n, e in enumerate(x for x in elements(data) if x["kind"] == "dataset"):
        size = e["value_size"]
        for row in range(min(e["total_rows"], e["data_size"] // size) if size else 0):
            a = e["data_offset"] + row * size
            yield n, e["name"], row, *cell(data[a : a + size], size, e["data_type"], e["data_type_u"] == 8)


# An encoder, for fixtures and round trips.


def pack_frame(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + b"\n" + (raw + b"\n" if raw else b"")


def pack_dataset(name: str, raw: bytes, rows: int, value_size: int, data_type: int = 0, unsigned: bool = False) -> bytes:
    head = bytearray(0x7B)
    for key, value in {"data_type": data_type, "total_rows": rows, "last_row": rows, "value_size": value_size, "data_type_u": 8 if unsigned else 0}.items():
        a, n = FIELDS[key]
        head[a : a + n] = value.to_bytes(n, "little")
    head[NAME[0] : NAME[0] + len(name)] = name.encode()
    return pack_frame(bytes(head)) + pack_frame(raw) + pack_frame(b"")


def pack_file(datasets: list[bytes], rest: bytes = b"", version: str = "4.2673", build: str = "552") -> bytes:
    return f"CPYA {version} {build}#\n".encode() + pack_frame(bytes(0x27)) + pack_frame(b"") + b"".join(datasets) + pack_frame(b"") + rest


#: Fixed values of the format: the type of a function's dataset, the code of a polar one, and where its points, begin and step are.
FUNCTION, POLAR, POINTS, CODE = 0x6081, 0x1194, 0x21, 0x0A


def function_record(head: bytes) -> tuple[str, int, str | None, str | None] | None:
    """A function's type, number of points, and first and last argument with all digits; None if the header is no function's."""
    a, n = FIELDS["data_type"]
    if len(head) < POINTS + 20 or int.from_bytes(head[a : a + n], "little") != FUNCTION:
        return None
    points, begin, step = struct.unpack_from("<Idd", head, POINTS)
    kind = "polar" if int.from_bytes(head[CODE : CODE + 2], "little") == POLAR else "normal"
    return (kind, points, format(begin, ".17g"), format(begin + step * (points - 1), ".17g")) if points else (kind, 0, None, None)


def pack_function(points: int, begin: float, step: float, polar: bool) -> bytes:
    head = bytearray(0x7B)
    head[CODE : CODE + 2] = (POLAR if polar else 0).to_bytes(2, "little")
    struct.pack_into("<Idd", head, POINTS, points, begin, step)
    a, n = FIELDS["data_type"]
    head[a : a + n] = FUNCTION.to_bytes(n, "little")
    return bytes(head)

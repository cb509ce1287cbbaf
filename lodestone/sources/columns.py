"""Stored columns of the unicode project format.

A column is a prefix, its number of rows, and runs up to the terminator.  All its
observed forms are one grammar:

    column  = prefix rows (run* | scalars) ce
    run     = 01 00 00                          one missing cell
            | ff ff n 00 segment+               n numbers
            | ff ff n 01 part+ 00               n cells
    segment = odd m, 0c, stream                 (m + 1) / 2 numbers, FPC
            | even m, scalar                    the scalar m / 2 times
    part    = odd m, literal+                   (m + 1) / 2 texts or integers
            | even m                            m / 2 missing cells
    scalars = (00 00)? (scalar | missing run), until the rows are full

Anything else is not decoded: no value is made up."""

from __future__ import annotations

import math
from dataclasses import dataclass

from . import codecs
from .legacy import MISSING

#: Fixed values of the format: prefixes, and how many high bytes a scalar stores by its code.
TYPED, INTEGERS, END = b"\x0a\x05", b"\x0a\x04", b"\xce"
SCALARS = {0x64: 0, 0x1A: 2, 0x23: 3, 0x3E: 6, 0x47: 7, 0x50: 8}
NO_SCALAR = 0x65
MISSING_BITS = codecs.patterns([MISSING])[0]


@dataclass(frozen=True)
class Cell:
    kind: str
    bits: int | None = None
    integer: int | None = None
    text: str | None = None

    @property
    def value(self):
        return codecs.doubles([self.bits])[0] if self.kind == "float" else self.integer if self.kind == "unsigned_integer" else self.text


GONE = Cell("missing")


@dataclass(frozen=True)
class Column:
    encoding: str
    cells: tuple[Cell, ...]

    @property
    def missing(self) -> int:
        return sum(c is GONE for c in self.cells)


class Reader:
    def __init__(self, data: bytes, integers: bool):
        self.data, self.at, self.integers, self.shape = data, 2, integers, []

    def need(self, good: bool) -> None:
        if not good:
            raise codecs.CodecError(f"not a column at {self.at}")

    def skip(self, mark: bytes) -> bool:
        if self.data.startswith(mark, self.at):
            self.at += len(mark)
            return True
        return False

    def number(self) -> int:
        value, self.at = codecs.varuint_decode(self.data, self.at)
        return value

    def take(self, n: int) -> bytes:
        self.need(self.at + n <= len(self.data))
        self.at += n
        return self.data[self.at - n : self.at]

    def scalar(self) -> Cell:
        code = self.take(1)[0]
        if code == NO_SCALAR:
            return GONE
        self.need(code in SCALARS)
        n = SCALARS[code]
        return Cell("float", int.from_bytes(self.take(n), "little") << 8 * (8 - n) if n else 0)

    def numbers(self, n: int) -> list[Cell]:
        out: list[Cell] = []
        while len(out) < n:
            mark = self.number()
            self.need(mark > 0)
            if mark & 1:
                self.need(self.skip(bytes([codecs.FPC_BITS])))
                bits, self.at = codecs.fpc_decode(self.data, (mark + 1) // 2, self.at)
                out += [GONE if b == MISSING_BITS else Cell("float", b) for b in bits]
            else:
                out += [self.scalar()] * (mark // 2)
            self.shape.append("literal" if mark & 1 else "repeat")
        self.need(len(out) == n)
        return out

    def parts(self, n: int) -> list[Cell]:
        out: list[Cell] = []
        while len(out) < n:
            mark = self.number()
            self.need(mark > 0)
            if not mark & 1:
                out += [GONE] * (mark // 2)
                self.shape.append("missing")
                continue
            for _ in range((mark + 1) // 2):
                if self.integers:
                    out.append(Cell("unsigned_integer", integer=self.number()))
                else:
                    out.append(Cell("text", text=self.take(self.number()).decode("utf-8")))
            self.shape.append("cells")
        self.need(len(out) == n)
        if not self.integers or self.shape[-1] == "missing":
            self.need(self.skip(b"\0"))
        return out

    def run(self, room: int) -> list[Cell]:
        if self.skip(b"\x01\0\0"):
            self.shape.append("missing")
            return [GONE]
        self.need(self.skip(b"\xff\xff"))
        n, kind = self.number(), self.number()
        self.need(0 < n <= room and kind in (0, 1))
        return self.parts(n) if kind else self.numbers(n)


def _encoding(shape: list[str], integers: bool) -> str:
    kinds = [s for s in shape if s != "missing"]
    if not kinds:
        return "empty"
    if "scalar" in kinds:
        return "compact-double-sequence"
    if "cells" in kinds:
        return "unsigned-varint-sequence" if integers else "utf8-sequence"
    return {("literal",): "fpc-fcm-dfcm", ("repeat", "literal"): "constant-prefix-fpc-fcm-dfcm"}.get(tuple(kinds), "segmented-fpc-fcm-dfcm")


def decode(data: bytes) -> Column | None:
    """The column in these bytes, or None if they aren't exactly one."""
    if data[:2] not in (TYPED, INTEGERS):
        return None
    r = Reader(data, data[:2] == INTEGERS)
    try:
        rows = r.number()
        cells: list[Cell] = []
        if r.data.startswith(b"\0\0", r.at):
            while len(cells) < rows:
                r.skip(b"\0\0")
                if r.data.startswith(b"\xff\xff", r.at):
                    cells += r.run(rows - len(cells))
                else:
                    cells.append(r.scalar())
                    r.shape.append("scalar")
        while len(cells) < rows:
            cells += r.run(rows - len(cells))
        r.need(data[r.at :] == END)
    except (codecs.CodecError, UnicodeDecodeError):
        return None
    if any(c.kind == "float" and not math.isfinite(c.value) for c in cells):
        return None
    return Column(_encoding(r.shape, r.integers), tuple(cells))


def value_type(column: Column) -> str:
    kinds = {c.kind for c in column.cells} - {"missing"}
    names = {"float": "numeric", "text": "text", "unsigned_integer": "unsigned_integer"}
    return "empty" if not kinds else names[kinds.pop()] if len(kinds) == 1 else "mixed"


def encode_numbers(values: list[float | None]) -> bytes:
    """A column of numbers: one stream, then the missing cells of the end; those inside are stored as such."""
    rows = len(values)
    stored = rows
    while stored and values[stored - 1] is None:
        stored -= 1
    n = codecs.varuint_encode
    out = TYPED + n(rows)
    if stored:
        bits = [MISSING_BITS if v is None else codecs.patterns([v])[0] for v in values[:stored]]
        out += b"\xff\xff" + n(stored) + b"\0" + n(2 * stored - 1) + bytes([codecs.FPC_BITS]) + codecs.fpc_encode(bits)
    if rows > stored:
        out += b"\xff\xff" + n(rows - stored) + b"\1" + n(2 * (rows - stored)) + b"\0"
    return out + END

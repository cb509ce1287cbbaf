"""Byte codecs of the project formats, decoders and encoders, pure functions of bytes."""

from __future__ import annotations

import struct

import numpy as np

MASK = (1 << 64) - 1


class CodecError(ValueError):
    """The bytes aren't of this codec."""


# LZ4 block format: sequences of a token, literals, a 2-byte distance and a match.


def _length(data: bytes, at: int, nibble: int) -> tuple[int, int]:
    total = nibble
    if nibble == 15:
        while True:
            if at >= len(data):
                raise CodecError("length runs past the end")
            step = data[at]
            total, at = total + step, at + 1
            if step != 255:
                break
    return total, at


def lz4_decode(data: bytes, size: int) -> tuple[bytes, int]:
    """A raw block of a declared size: the bytes, and how many input bytes it took."""
    if size < 0:
        raise CodecError("negative size")
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise CodecError("block is shorter than declared")
        token = data[at]
        literal, at = _length(data, at + 1, token >> 4)
        out += data[at : at + literal]
        at = min(at + literal, len(data))
        if len(out) >= size:
            break
        if at + 2 > len(data):
            raise CodecError("no distance")
        distance = data[at] | data[at + 1] << 8
        if not 0 < distance <= len(out):
            raise CodecError("distance is out of range")
        match, at = _length(data, at + 2, token & 15)
        match = min(match + 4, size - len(out))
        unit = bytes(out[len(out) - distance :])
        out += (unit * (match // distance + 1))[:match]
    if len(out) != size:
        raise CodecError("block is longer than declared")
    return bytes(out), at


def lz4_encode(data: bytes) -> bytes:
    """A valid block, by a hash of four bytes; the last five bytes are literals, as the format asks."""
    out, anchor, at, seen = bytearray(), 0, 0, {}
    while at + 12 <= len(data):
        key = data[at : at + 4]
        back = seen.get(key, -1)
        seen[key] = at
        if back < 0 or at - back > 65535:
            at += 1
            continue
        end = at + 4
        while end < len(data) - 5 and data[end] == data[back + end - at]:
            end += 1
        literals, match = data[anchor:at], end - at
        out.append(min(15, len(literals)) << 4 | min(15, match - 4))
        if len(literals) >= 15:
            out.extend(b"\xff" * ((len(literals) - 15) // 255) + bytes([(len(literals) - 15) % 255]))
        out.extend(literals)
        out.extend((at - back).to_bytes(2, "little"))
        if match - 4 >= 15:
            out.extend(b"\xff" * ((match - 19) // 255) + bytes([(match - 19) % 255]))
        anchor = at = end
    literals = data[anchor:]
    out.append(min(15, len(literals)) << 4)
    if len(literals) >= 15:
        out.extend(b"\xff" * ((len(literals) - 15) // 255) + bytes([(len(literals) - 15) % 255]))
    return bytes(out + literals)


# Unsigned base-128 integers, of ten bytes at most.


def varuint_decode(data: bytes, at: int = 0) -> tuple[int, int]:
    for n in range(10):
        if at + n >= len(data):
            break
        if data[at + n] < 0x80:
            return sum((b & 0x7F) << 7 * i for i, b in enumerate(data[at : at + n + 1])), at + n + 1
    raise CodecError("unfinished integer")


def varuint_encode(value: int) -> bytes:
    groups = max(1, -(-value.bit_length() // 7))
    return bytes((value >> 7 * i & 0x7F) | (0x80 if i < groups - 1 else 0) for i in range(groups))


# FPC (Burtscher and Ratanaworabhan): each double is XORed with the better of two predictions,
# and a nibble tells which one and how many bytes of the residual follow; pairs of nibbles share a byte.

FPC_BITS = 12
#: Fixed values of the format: residual bytes by the nibble's low three bits (four bytes have no code).
FPC_BYTES = (0, 1, 2, 3, 5, 6, 7, 8)


class Predictors:
    """The value table (FCM) and the stride table (DFCM)."""

    def __init__(self, bits: int = FPC_BITS):
        self.mask = (1 << bits) - 1
        self.values, self.strides = [0] * (1 << bits), [0] * (1 << bits)
        self.at_value = self.at_stride = self.last = 0

    def guesses(self) -> tuple[int, int]:
        return self.values[self.at_value], (self.last + self.strides[self.at_stride]) & MASK

    def learn(self, bits: int) -> None:
        stride = (bits - self.last) & MASK
        self.values[self.at_value], self.strides[self.at_stride] = bits, stride
        self.at_value = (self.at_value << 6 ^ bits >> 48) & self.mask
        self.at_stride = (self.at_stride << 2 ^ stride >> 40) & self.mask
        self.last = bits


def fpc_decode(data: bytes, count: int, at: int = 0) -> tuple[list[int], int]:
    """`count` 64-bit patterns, and where the stream ends."""
    out, state, low = [], Predictors(), True
    control = 0
    while len(out) < count:
        if low:
            if at >= len(data):
                raise CodecError("stream ends early")
            control, at = data[at], at + 1
        code = control & 15 if low else control >> 4
        low = not low
        size = FPC_BYTES[code & 7]
        if at + size > len(data):
            raise CodecError("stream ends early")
        bits = state.guesses()[code >> 3] ^ int.from_bytes(data[at : at + size], "little")
        at += size
        state.learn(bits)
        out.append(bits)
    return out, at


def fpc_encode(patterns: list[int]) -> bytes:
    state, coded = Predictors(), []
    for bits in patterns:
        choice, residual = min(((k, bits ^ g) for k, g in enumerate(state.guesses())), key=lambda x: (x[1].bit_length() + 7) // 8)
        size = (residual.bit_length() + 7) // 8
        code = next(i for i, n in enumerate(FPC_BYTES) if n >= size)
        coded.append((choice << 3 | code, residual.to_bytes(FPC_BYTES[code], "little")))
        state.learn(bits)
    out = bytearray()
    for i in range(0, len(coded), 2):
        pair = coded[i : i + 2]
        out.append(pair[0][0] | (pair[1][0] << 4 if len(pair) > 1 else 0))
        out += b"".join(residual for _, residual in pair)
    return bytes(out)


def doubles(patterns: list[int]) -> list[float]:
    return np.array(patterns, np.uint64).view(np.float64).tolist()


def patterns(values: list[float]) -> list[int]:
    return np.array(values, np.float64).view(np.uint64).tolist()


# Byte runs: 01-7f copy that many bytes, c0-ff repeat the next byte (n & 3f) + 3 times.


def byte_runs_decode(data: bytes, first_control: int = 0, start: int = 0, stop: bool = False) -> tuple[bytes, list[int], str]:
    """Decoded bytes, the source offset of each, and why decoding ended.

    Bytes before `first_control` are copied.  Other controls end it if `stop`, else they are an error."""
    if not 0 <= first_control <= len(data):
        raise CodecError("first control is outside")
    out, source, at = bytearray(data[:first_control]), list(range(start, start + first_control)), first_control
    while at < len(data):
        control = data[at]
        if 1 <= control <= 0x7F:
            if at + 1 + control > len(data):
                raise CodecError("literal runs past the end")
            out += data[at + 1 : at + 1 + control]
            source += range(start + at + 1, start + at + 1 + control)
            at += 1 + control
        elif control >= 0xC0:
            if at + 1 >= len(data):
                raise CodecError("repeat without a byte")
            n = (control & 0x3F) + 3
            out += data[at + 1 : at + 2] * n
            source += [start + at + 1] * n
            at += 2
        elif stop:
            return bytes(out), source, f"control_0x{control:02x}"
        else:
            raise CodecError(f"unassigned control 0x{control:02x} at {start + at}")
    return bytes(out), source, "eof"


def byte_runs_encode(data: bytes) -> bytes:
    out, at, literal = bytearray(), 0, bytearray()

    def flush() -> None:
        for a in range(0, len(literal), 0x7F):
            part = literal[a : a + 0x7F]
            out.append(len(part))
            out.extend(part)
        literal.clear()

    while at < len(data):
        run = 1
        while at + run < len(data) and run < 66 and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush()
            out.extend((0xC0 + run - 3, data[at]))
        else:
            literal.extend(data[at : at + run])
        at += run
    flush()
    return bytes(out)


# Arrays of one element type.

#: Fixed values of the format: element codes.
ELEMENTS = {1: "<u1", 2: "<u2", 3: "<u4", 4: "<f4", 5: "<f8", 6: "<f8"}


def elements(data: bytes, code: int) -> list[float]:
    kind = ELEMENTS.get(code)
    if kind is None:
        raise CodecError("unknown element type")
    size = np.dtype(kind).itemsize
    return np.frombuffer(data[: len(data) // size * size], kind).tolist()


def double_bits(value: float) -> str:
    return struct.pack(">d", value).hex()

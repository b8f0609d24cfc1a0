"""Reading the protobuf wire format: fields of a message as (number, kind, value)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

VARINT, I64, BYTES, I32 = 0, 1, 2, 5


class WireError(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, where it ends)"""
    out = shift = 0
    while at < len(data):
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
        if shift > 63:
            break
    raise WireError("truncated or overlong varint")


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == VARINT:
            value, at = varint(data, at)
        elif kind in (I64, I32):
            size = 8 if kind == I64 else 4
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise WireError("truncated number")
        elif kind == BYTES:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
            if len(value) < size:
                raise WireError("truncated bytes")
        else:
            raise WireError(f"unknown wire type {kind}")
        yield tag >> 3, kind, value


def double(value: int | bytes) -> float:
    if not isinstance(value, bytes) or len(value) != 8:
        raise WireError("not a double")
    return struct.unpack("<d", value)[0]


def text(value: int | bytes) -> str:
    if not isinstance(value, bytes):
        raise WireError("not a text")
    return value.decode("utf-8", "replace")


def put_varint(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def put(number: int, value: int | float | bytes | str) -> bytes:
    """A field: ints as varints, floats as doubles, bytes and texts with their length."""
    if isinstance(value, float):
        return put_varint(number << 3 | I64) + struct.pack("<d", value)
    if isinstance(value, int):
        return put_varint(number << 3 | VARINT) + put_varint(value)
    data = value.encode() if isinstance(value, str) else value
    return put_varint(number << 3 | BYTES) + put_varint(len(data)) + data

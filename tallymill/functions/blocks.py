"""Unpacking of the block formats that Spark writes event logs in.

Each is a sequence of blocks with a header. A file that is still written, or
whose writer was lost, ends in the middle of one; the whole blocks before count.
"""

from __future__ import annotations

import struct

import pyarrow as pa

# Magic bytes and headers of the formats.
_LZ4_MAGIC, _LZ4_HEADER, _LZ4_RAW, _LZ4_PACKED = b"LZ4Block", 21, 0x10, 0x20
_SNAPPY_MAGIC, _SNAPPY_HEADER = b"\x82SNAPPY\0", 16
_LZF_MAGIC, _LZF_RAW, _LZF_PACKED = b"ZV", 0, 1


def _lz4(data: bytes):
    at = 0
    while at + _LZ4_HEADER <= len(data):
        magic, token, packed, size, _ = struct.unpack_from("<8sBIII", data, at)
        if magic != _LZ4_MAGIC:
            raise ValueError("not a block of lz4")
        at += _LZ4_HEADER
        if at + packed > len(data):
            return
        block = data[at : at + packed]
        # a block of no bytes ends a stream; another may follow
        if size:
            yield block if token & 0xF0 == _LZ4_RAW else pa.decompress(block, size, "lz4_raw", asbytes=True)
        at += packed


def _snappy(data: bytes):
    if len(data) < _SNAPPY_HEADER:
        return
    if not data.startswith(_SNAPPY_MAGIC):
        raise ValueError("not a stream of snappy blocks")
    at = 0
    while at + 4 <= len(data):
        if data.startswith(_SNAPPY_MAGIC, at):
            at += _SNAPPY_HEADER
            continue
        (packed,) = struct.unpack_from(">I", data, at)
        at += 4
        if at + packed > len(data):
            return
        block = data[at : at + packed]
        size, shift = 0, 0
        # the size stands before the block, seven bits a byte
        for byte in block:
            size |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
        yield pa.decompress(block, size, "snappy", asbytes=True)
        at += packed


def _lzf_block(block: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(block):
        control = block[at]
        at += 1
        if control < 32:
            out += block[at : at + control + 1]
            at += control + 1
            continue
        length = control >> 5
        if length == 7:
            length += block[at]
            at += 1
        begin = len(out) - ((control & 31) << 8 | block[at]) - 1
        at += 1
        length += 2
        while length:
            part = out[begin : begin + length]
            out += part
            begin += len(part)
            length -= len(part)
    if len(out) != size:
        raise ValueError("a block of lzf has another size than it says")
    return bytes(out)


def _lzf(data: bytes):
    at = 0
    while at + 5 <= len(data):
        magic, kind, packed = struct.unpack_from(">2sBH", data, at)
        if magic != _LZF_MAGIC:
            raise ValueError("not a block of lzf")
        at += 5
        if kind == _LZF_RAW:
            if at + packed > len(data):
                return
            yield data[at : at + packed]
        else:
            if at + 2 + packed > len(data):
                return
            (size,) = struct.unpack_from(">H", data, at)
            at += 2
            yield _lzf_block(data[at : at + packed], size)
        at += packed


_FORMATS = {"lz4": _lz4, "snappy": _snappy, "lzf": _lzf}


def unpacked(data: bytes, codec: str) -> bytes:
    """The bytes of all whole blocks of ``data``."""
    return b"".join(_FORMATS[codec](data))

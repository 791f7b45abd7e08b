"""What chunks are compressed by."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Codecs of a Blosc frame, by their number in its flags; the first, its own, is not among them.
BLOSC = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}


def unblosc(data: bytes) -> bytes:
    """The bytes of a Blosc frame: a header of 16 bytes, where each block begins, and each block's streams, its bytes dealt by their place in an item."""
    flags, size = data[2], data[3]
    total, block, _ = struct.unpack("<III", data[4:16])
    if flags & 2:  # stored as they are
        return data[16 : 16 + total]
    codec = BLOSC.get(flags >> 5)
    if codec is None or flags & 4:
        raise ValueError("Blosc frames of its own codec or with shuffled bits cannot be read")
    count, out = -(-total // block), []
    for k, at in enumerate(struct.unpack(f"<{count}I", data[16 : 16 + 4 * count])):
        n = min(block, total - k * block)
        streams = size if not flags & 16 and size <= 16 and n == block and block // size >= 128 else 1
        parts = []
        for _ in range(streams):
            packed, want = struct.unpack("<i", data[at : at + 4])[0], n // streams
            piece = data[at + 4 : at + 4 + packed]
            parts.append(piece if packed == want else unpacked(piece, codec, want))
            at += 4 + packed
        whole = b"".join(parts)
        if flags & 1 and size > 1:
            items = n // size * size
            whole = np.frombuffer(whole[:items], np.uint8).reshape(size, -1).T.tobytes() + whole[items:]
        out.append(whole)
    return b"".join(out)


def unpacked(data: bytes, codec: str, size: int) -> bytes:
    return zlib.decompress(data) if codec == "zlib" else pa.decompress(data, size, codec, asbytes=True)


def decompressed(data: bytes, kind: str | None) -> bytes:
    if kind is None:
        return data
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "lz4":  # the size stands before the block
        return pa.decompress(data[4:], struct.unpack("<I", data[:4])[0], "lz4_raw", asbytes=True)
    if kind == "blosc":
        return unblosc(data)
    raise ValueError(f"chunks compressed by {kind!r} cannot be read")

"""Whole texts as compressed bytes, for the few shuffles that must carry them."""

from __future__ import annotations

import pyarrow as pa
import zstandard

from ._words import string_buffers


def pack(column: pa.Array) -> pa.Array:
    data, off = string_buffers(column)
    raw = data.tobytes()
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([press(raw[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())


def unpack(column: pa.Array) -> pa.Array:
    open_ = zstandard.ZstdDecompressor().decompress
    return pa.array([open_(b) if b is not None else b"" for b in column.to_pylist()], pa.binary()).cast(pa.large_binary()).cast(
        pa.large_string()
    )

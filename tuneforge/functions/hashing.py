"""Seeded, partition-independent uniforms.

Every random draw in the library is ``u(seed, parts...)``: the first 8 hex digits of
``md5(seed:part1:part2...)`` read as an unsigned 32-bit integer and divided by 2^32.
It depends only on the row's identity, never on partitioning or task order, so a
re-executed task (lost executor) reproduces the same draws, and DuckDB can compute
the identical value for the oracle.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _as_col(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    if isinstance(p, str):
        return F.col(p).cast("string")
    return F.lit(str(p))


def hash_uniform(seed, *parts) -> Column:
    """Uniform in [0, 1) from ``md5(seed:parts...)``; parts are columns, names or literals."""
    key = F.concat_ws(":", F.lit(str(seed)), *[_as_col(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def hash_below(threshold: float, seed, *parts) -> Column:
    """``hash_uniform(seed, *parts) < threshold``, told by the digits of the hash as they are: no number is made."""
    top = math.ceil(threshold * TWO_POW_32)
    if not 0 < top < 1 << 32:
        return hash_uniform(seed, *parts) < F.lit(float(threshold))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[_as_col(p) for p in parts])) < F.lit(f"{top:08x}")


def hash_uniform_sql(seed, *parts: str) -> str:
    """The same uniform as DuckDB SQL; ``parts`` are SQL expressions."""
    args = ", ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(('0x' || substr(md5(concat_ws(':', {args})), 1, 8))::BIGINT / 4294967296.0)"


def row_key(prefix: str = "l_") -> Column:
    """Unique lineitem row key ``orderkey-linenumber-partkey-suppkey-cents``.

    (orderkey, linenumber) alone is not unique in the driver tables; the price in cents
    (an integer, so both engines print it the same) makes it unique.
    """
    p = prefix
    cents = F.round(F.col(f"{p}extendedprice") * 100).cast("bigint")
    return F.concat_ws(
        "-",
        F.col(f"{p}orderkey").cast("string"),
        F.col(f"{p}linenumber").cast("string"),
        F.col(f"{p}partkey").cast("string"),
        F.col(f"{p}suppkey").cast("string"),
        cents.cast("string"),
    )


def row_key_sql() -> str:
    return (
        "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
        "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
        "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))"
    )


_SINES = [np.uint32(int(abs(math.sin(i + 1)) * TWO_POW_32)) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_word(words: np.ndarray) -> np.ndarray:
    """The first 32 bits of the md5 of messages of one block each: ``words`` is [16, messages]."""
    a, b, c, d = (np.full(words.shape[1], v) for v in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i, (sine, turn) in enumerate(zip(_SINES, _TURNS, strict=True)):
        if i < 16:
            at = i
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            f ^= c
        f += a
        f += sine
        f += words[at]
        np.left_shift(f, np.uint32(turn), out=t)
        f >>= np.uint32(32 - turn)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (a + _START[0]).byteswap()


def md5_heads(texts: pa.Array, prefixes: list[bytes], rows: int = 4096) -> np.ndarray:
    """[prefixes, texts]: the first 32 bits of ``md5(prefix + text)``, the number that its first eight digits
    name, by vectors over many texts (a message of more than a block, 55 bytes, is hashed alone)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    out = np.empty((len(prefixes), len(texts)), np.uint32)
    for start in range(0, len(texts), rows):
        ends = offsets[start : start + rows + 1]
        sizes, n = np.diff(ends), len(ends) - 1
        for width in {len(p) for p in prefixes}:
            short = sizes + width <= 55
            kept = np.where(short, sizes, 0)
            block = np.zeros((n, 64), np.uint8)
            row = np.repeat(np.arange(n), kept)
            place = np.arange(len(row)) - np.repeat(np.cumsum(kept) - kept, kept)
            block[row, place + width] = data[place + ends[row]]
            block[np.arange(n), kept + width] = 0x80
            block[:, 56:58] = np.stack([(kept + width) * 8 & 255, (kept + width) * 8 >> 8], axis=1)
            for i, prefix in enumerate(prefixes):
                if len(prefix) == width:
                    block[:, :width] = np.frombuffer(prefix, np.uint8)
                    out[i, start : start + n] = _first_word(np.ascontiguousarray(block.view("<u4").T))
                    for j in np.flatnonzero(~short).tolist():
                        out[i, start + j] = int.from_bytes(hashlib.md5(prefix + data[ends[j] : ends[j + 1]].tobytes()).digest()[:4], "big")
    return out

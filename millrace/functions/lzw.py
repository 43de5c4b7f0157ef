"""LZW with 12-bit codes, packed low bits first, with an end code; the table stays as it is once full.

Each code depends on all before it, so a text is coded by a loop over its bytes, in Arrow batches of texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .strings import hex_decode, hex_encode

BITS, END = 12, 4095  # fixed values: code width and end code
SEEDS = 256


def compress(data: bytes) -> bytes:
    """The codes of the longest known strings, then the end code. A string is known by the code of its start and its last
    byte, in one number."""
    table: dict[int, int] = {}
    codes, known = [], -1
    for byte in data:
        if known < 0:
            known = byte
        elif (longer := table.get(known << 8 | byte)) is not None:
            known = longer
        else:
            codes.append(known)
            if SEEDS + len(table) < END:
                table[known << 8 | byte] = SEEDS + len(table)
            known = byte
    if known >= 0:
        codes.append(known)
    return pack_codes([*codes, END])


def pack_codes(codes: list[int]) -> bytes:
    """Two codes fill three bytes; an odd last one two."""
    c = np.array(codes + [0] * (len(codes) % 2), np.uint32)
    pairs = c[::2] | c[1::2] << BITS
    out = np.stack([pairs & 255, pairs >> 8 & 255, pairs >> 16], 1).astype(np.uint8).tobytes()
    return out[: -(-len(codes) * BITS // 8)]


def unpack_codes(data: bytes) -> list[int]:
    """The 12-bit codes up to the end code."""
    n = len(data) * 8 // BITS
    raw = np.frombuffer(data + bytes(-len(data) % 3), np.uint8).reshape(-1, 3).astype(np.uint32)
    pairs = raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16
    codes = np.stack([pairs & END, pairs >> BITS], 1).reshape(-1)[:n]
    ends = np.flatnonzero(codes == END)
    return codes[: ends[0] if len(ends) else n].tolist()


def decompress(data: bytes) -> bytes:
    """The original bytes; empty if a code can't be."""
    table = [bytes([i]) for i in range(SEEDS)]
    out, last = [], b""
    for code in unpack_codes(data):
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):  # a string that starts with itself
            entry = last + last[:1]
        else:
            return b""
        if last and len(table) < END:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
    return b"".join(out)


@F.pandas_udf(BinaryType())
def lzw_compress(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else compress(bytes(b)))


@F.pandas_udf(BinaryType())
def lzw_decompress(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decompress(bytes(b)))


def compress_text(text: Column) -> Column:
    """Compressed UTF-8 of a text, as hex digits."""
    return hex_encode(lzw_compress(text.cast("binary")))


def decompress_text(digits: Column) -> Column:
    """The text of such digits; null for an odd number of digits or another character."""
    return F.decode(lzw_decompress(hex_decode(digits)), "UTF-8")

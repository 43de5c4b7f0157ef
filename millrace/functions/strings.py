"""Scalar string functions as Column expressions: ASCII case, normalising, splitting, searching, hex."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = ".,!?;:\"'()[]{}-/\\"  # fixed value: the marks that remove_punctuation drops
BLANKS = " \t\n\r"  # fixed value: what trim strips


def to_lower(s: Column) -> Column:
    """A-Z to lower case; other letters stay."""
    return F.translate(s, string.ascii_uppercase, string.ascii_lowercase)


def to_upper(s: Column) -> Column:
    return F.translate(s, string.ascii_lowercase, string.ascii_uppercase)


def normalize(s: Column) -> Column:
    """Only [A-Za-z0-9], in lower case."""
    return F.lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def remove_punctuation(s: Column) -> Column:
    return F.translate(s, PUNCTUATION, "")


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def split(s: Column, mark: str) -> Column:
    """The parts between single-character marks, empty ones dropped."""
    return F.array_remove(F.split(s, f"\\Q{mark}\\E", -1), "")


def join(parts: Column, glue: str) -> Column:
    return F.array_join(parts, glue)


def find(s: Column, part: str, start: int = 0) -> Column:
    """0-based position of ``part`` from ``start`` on, -1 if absent."""
    return F.locate(part, s, start + 1) - 1


def rfind(s: Column, char: str) -> Column:
    """0-based position of the last ``char``, -1 if absent."""
    back = F.locate(char, F.reverse(s))
    return F.when(back > 0, F.length(s) - back).otherwise(-1)


def substr(s: Column, start: int, n: int | None = None) -> Column:
    """From 0-based ``start``, at most ``n`` characters; empty beyond the end."""
    return F.substring(s, start + 1, n if n is not None else 2147483647)


def starts_with(s: Column, part: str) -> Column:
    return F.startswith(s, F.lit(part))


def ends_with(s: Column, part: str) -> Column:
    return F.endswith(s, F.lit(part))


def size_bytes(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def hash_key(s: Column) -> Column:
    """A 64-bit key for grouping; not stable across engines."""
    return F.xxhash64(s)


def number_text(x: Column) -> Column:
    return x.cast("string")


def double_text(x: Column, places: int) -> Column:
    """Fixed decimals, truncated towards minus infinity, not rounded."""
    power = float(10**places)
    return F.format_string(f"%.{places}f", F.floor(x * power) / power)


def append(text: Column, *parts: Column) -> Column:
    """The text and what follows it; null parts count as empty."""
    return F.concat(*(F.coalesce(p, F.lit("")) for p in (text, *parts)))


def repeated(char: str, n: int) -> Column:
    """A character n times."""
    return F.repeat(F.lit(char), F.lit(n))


def hex_encode(b: Column) -> Column:
    return F.lower(F.hex(b))


def hex_decode(s: Column) -> Column:
    """Bytes of hex digits; null for an odd number of digits or another character."""
    return F.when(F.length(s) % 2 == 0, F.unhex(s))

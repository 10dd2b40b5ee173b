"""String functions. Lengths and offsets are in bytes of UTF-8 where the name says so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def str_len(s: Column) -> Column:
    """Bytes, not characters."""
    return F.octet_length(s).cast("long")


def str_contains(s: Column, part: str) -> Column:
    return F.contains(s, F.lit(part))


def str_starts_with(s: Column, part: str) -> Column:
    return F.startswith(s, F.lit(part))


def str_ends_with(s: Column, part: str) -> Column:
    return F.endswith(s, F.lit(part))


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def str_replace(s: Column, old: str, new: str) -> Column:
    """The first occurrence only. An empty `old` puts `new` in front."""
    if not old:
        return F.concat(F.lit(new), s)
    at = F.instr(s, F.lit(old))
    return F.when(at > 0, F.overlay(s, F.lit(new), at, F.lit(len(old)))).otherwise(s)


def str_slice(s: Column, offset: int, length: int) -> Column:
    """By bytes; a negative offset counts from the end. A cut inside a character leaves its bytes out as replacements."""
    at = offset + 1 if offset >= 0 else offset
    return F.decode(F.substring(F.encode(s, "UTF-8"), at, length), "UTF-8")

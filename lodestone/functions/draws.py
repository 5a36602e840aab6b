"""Uniform draws that are the same in every run, on every machine, and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("string")


def uniform(*keys) -> Column:
    """A number in [0, 1) for each combination of keys: 48 bits of the MD5 of the keys joined by hyphens."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *map(_text, keys)).cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)


def uniform_sql(*keys: str) -> str:
    """The same in SQL; keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(keys)})), 1, 12))::UBIGINT::DOUBLE / {1 << 48})"

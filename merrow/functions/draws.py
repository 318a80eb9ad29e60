"""Repeatable draws from digests, which any SQL engine can take too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 40


def draw(*parts: Column) -> Column:
    """An integer below 2 ** 40: the first ten hexadecimal digits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same for DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 10) AS BIGINT)"

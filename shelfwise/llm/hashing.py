"""Hashes that Spark and other SQL engines give alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash52(*parts: Column) -> Column:
    """A 52-bit number from the MD5 of the parts, joined by colons; a null part counts as ``null``."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")

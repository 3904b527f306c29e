"""XAR archives: header and table of contents, as native expressions; only inflating needs Python."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

HEADER_BYTES = 28
MAX_LENGTH = (1 << 31) - 1  # of a binary value in Spark
MAGIC = bytearray(b"xar!")


def _number(content: Column, at: int, size: int) -> Column:
    """A big-endian number as DECIMAL(20, 0), which holds 64 bits."""
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("decimal(20,0)")


def is_xar(content: Column) -> Column:
    return (F.octet_length(content) >= HEADER_BYTES) & (F.substring(content, 1, 4) == F.lit(MAGIC))


def header(content: Column) -> Column:
    """Struct of the header's fields; NULL if ``content`` is too short or no archive."""
    return F.when(
        is_xar(content),
        F.struct(
            _number(content, 4, 2).cast("int").alias("header_size"),
            _number(content, 6, 2).cast("int").alias("version"),
            _number(content, 8, 8).alias("toc_len"),
            _number(content, 16, 8).alias("toc_raw_len"),
            _number(content, 24, 4).cast("long").alias("cksum_alg"),
        ),
    )


def toc(content: Column) -> Column:
    """The stored table of contents; NULL without a header or if it reaches past the end.  Any header size is taken as it is."""
    size, start = _number(content, 8, 8), _number(content, 4, 2)
    inside = is_xar(content) & (start + size <= F.octet_length(content))
    return F.when(inside, F.substr(content, start.cast("int") + 1, F.when(size <= MAX_LENGTH, size).cast("int")))


def inflate(stored: bytes | None, size: int | None) -> bytes | None:
    """Raw deflate between two leading and four trailing bytes, at most ``size`` bytes of output; the checksum isn't
    looked at.  None for six bytes or less, broken data, and empty output."""
    if stored is None or size is None or len(stored) <= 6 or size <= 0:
        return None
    try:
        return zlib.decompressobj(-15).decompress(bytes(stored[2:-4]), min(int(size), MAX_LENGTH)) or None
    except zlib.error:
        return None


@F.pandas_udf(BinaryType())
def _inflate(stored: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([inflate(a, None if pd.isna(b) else int(b)) for a, b in zip(stored, size)], dtype=object)


def inflated_toc(content: Column) -> Column:
    """The table of contents inflated, up to the length the header declares."""
    return _inflate.asNondeterministic()(toc(content), _number(content, 16, 8))

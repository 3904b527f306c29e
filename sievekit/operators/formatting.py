"""Results as lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.config import Algorithm

# Widths of the columns.
SSDEEP_WIDTH, SCORE_WIDTH = 107, {Algorithm.SSDEEP: 3, Algorithm.TLSH: 4}


def padded(digest: Column, algorithm: str | Algorithm) -> Column:
    """ssdeep digests padded on the right, never cut; others as they are."""
    if Algorithm.parse(algorithm) is not Algorithm.SSDEEP:
        return digest
    return F.concat(digest, F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(SSDEEP_WIDTH) - F.length(digest))))


def line(digest: Column, path: Column, algorithm: str | Algorithm) -> Column:
    """``digest``, two spaces, ``path``."""
    return F.concat(padded(digest, algorithm), F.lit("  "), path)


def match_line(digest: Column, score: Column, path: Column, algorithm: str | Algorithm) -> Column:
    """``digest``, a space, the score right-aligned (nothing for other than fuzzy algorithms), two spaces, ``path``."""
    width = SCORE_WIDTH.get(Algorithm.parse(algorithm))
    shown = F.format_string(f"%{width}d", score) if width else F.lit("")
    return F.concat(padded(digest, algorithm), F.lit(" "), shown, F.lit("  "), path)


def result_line(algorithm: str | Algorithm, matched: bool, quiet: bool) -> Column:
    """The line of a result with ``digest``, ``path``, ``file_path`` and, where ``matched``, ``score``."""
    digest, path = F.col("digest"), F.col("path")
    if quiet:
        return F.coalesce(F.col("file_path"), path) if matched else digest
    plain = line(digest, path, algorithm)
    if not matched:
        return plain
    return F.when(F.col("score").isNull(), plain).otherwise(match_line(digest, F.col("score"), path, algorithm))

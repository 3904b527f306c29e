"""Digest queries over growing tables and folders, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.functions.spelling import plain_digest
from sievekit.plans.pipeline import DigestQuery


def live_results(stream: DataFrame, query: DigestQuery) -> DataFrame:
    """Results of the rows of a stream (``seq``, ``path``, ``content``) as they arrive; targets as in the query's settings.

    Everything a query does to a row needs only that row, so there is no state; sorting and the first slice of a file
    are left out.
    """
    found = query.decoded(stream)
    return query.matched(found) if not query.spec.targets else _matches(found, query)


def _matches(found: DataFrame, query: DigestQuery) -> DataFrame:
    from sievekit.operators.matching import match

    return match(found, list(query.spec.targets), query.algo, query.spec.threshold)


def live_counts(stream: DataFrame, when: str = "received_at", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Rows of each plain digest by window of arrival, of a stream of digest results; rows later than ``late`` are left out."""
    plain = stream.withColumn("plain", plain_digest(F.col("algo"), F.col("digest"))).where(F.col("plain").isNotNull())
    return (
        plain.withWatermark(when, late)
        .groupBy(F.window(when, window).alias("window"), F.col("plain").alias("digest"))
        .agg(F.count("*").alias("n_rows"))
        .select(F.col("window.start").alias("window_start"), "digest", "n_rows")
    )

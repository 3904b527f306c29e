"""Most frequent values of a column, exactly and in bounded memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of ``value`` and their exact row counts.

    Rows are counted on the map side first, then in hash partitions whose aggregation spills to disk when memory
    runs out; each partition keeps its own top ``k``, and one ordered limit merges those.  So no task holds more
    than a partition's counts, the driver ``k`` rows a partition, and a hot value costs one row a map task.

    Result: ``value``, ``n_rows``.  Nulls aren't counted; ties go to the smaller value; with fewer than ``k`` values all
    come out, with an empty table none; other columns are ignored.
    """
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("value"))
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.desc("n_rows"), "value")
        .limit(k)  # planned as a top k of each partition and a merge of those
    )

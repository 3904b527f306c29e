"""Per-key results where a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.session import written

CHUNK_ROWS = 100_000
_INDEX_BITS = (1 << 33) - 1


def numbered(df: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """``df`` with ``number``, from 0: the place of each row in the order of ``order``, without a task that gets all rows.

    Rows are range-partitioned on ``order``, which must end in a column that tells equal keys apart, so that a
    key of any size spreads over partitions; each partition is sorted and its rows indexed, and the table written
    once, because partition numbers must not change between counting and numbering.  The number of a row is its
    partition's offset (prefix sum of the row counts, one row a partition) plus its index.
    """
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    table = written(
        spread.sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_index", F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX_BITS)))
    )
    counts = table.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_offset"))
    number = F.col("_offset") + F.col("_index")
    return table.join(F.broadcast(offsets), "_part").withColumn("number", number).drop("_part", "_index", "_offset")  # bounded: one row a partition


def numbered_chunks(df: DataFrame, order: list, chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """``df`` with ``chunk``: rows in the order of ``order`` cut into chunks of exactly ``chunk_rows`` (the last may be shorter)."""
    return numbered(df, order, partitions).withColumn("chunk", F.floor(F.col("number") / chunk_rows)).drop("number")


def per_key_results(df: DataFrame, key: str, member: str, when: str, chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """Rows, distinct members, first and last time of each key, by exact offset chunking.

    Rows are ordered by key and member and cut into equal chunks whatever their keys; each chunk gives one state for
    each key in it, and the states of a key are merged in order: a member on both sides of a boundary counts once.
    No task gets more than a chunk's worth of one key, and no key's rows meet in one task.

    Result: ``key``, ``n_rows``, ``n_members``, ``first_at``, ``last_at``.  Rows without a key have no result; null
    members count as rows but not as members; null times are left out (a key without any has nulls); repeated rows
    each count as rows; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    f = F.col(member)
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        # A 128-bit fingerprint stands for the member.
        F.when(f.isNotNull(), F.struct(F.xxhash64(f).alias("a"), F.xxhash64(F.lit(7), f).alias("b"))).alias("member"),
        F.col(when).alias("at"),
        F.monotonically_increasing_id().alias("salt"),
    )
    chunks = numbered_chunks(rows, ["key", "member", "salt"], chunk_rows, partitions)
    states = (
        # One row for each member of a key in a chunk, then one for each key in a chunk.
        chunks.groupBy("chunk", "key", "member")
        .agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
        .groupBy("chunk", "key")
        .agg(
            F.sum("n").alias("n"), F.count("member").alias("members"), F.min("member").alias("low"), F.max("member").alias("high"),
            F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        )
    )
    earlier = F.last("high", ignorenulls=True).over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return (
        states.withColumn("again", F.coalesce((F.col("low") == earlier).cast("long"), F.lit(0)))
        .groupBy("key")
        .agg(F.sum("n").alias("n_rows"), F.sum(F.col("members") - F.col("again")).alias("n_members"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    )

"""Pairs of ids that have a key in common, without hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BLOCK = 2_000


def pairs_with_common_key(keys: DataFrame, block: int = KEY_BLOCK) -> DataFrame:
    """Distinct pairs ``id_1 < id_2`` of ids under one key, of ``keys`` (``key`` long, ``id`` long, read twice).

    Keys of a single id are dropped before the join.  The ids of a key that has more than ``block`` are cut into blocks,
    and each pair of blocks is joined by itself, so no task gets a whole hot key.
    """
    many = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    held = keys.join(many, "key").select("key", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("own"))
    spread = held.select("key", "id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "id", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )
    a, b = spread.alias("a"), spread.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "low", "high")]
    apart = (F.col("a.low") == F.col("a.high")) | (F.col("a.own") != F.col("b.own"))
    return (
        a.join(b, [*on, F.col("a.id") < F.col("b.id"), apart])
        .select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"))
        .distinct()
    )


def with_values(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """``id_1``, ``id_2`` and the value of each: ``value_1``, ``value_2``."""
    for i in (1, 2):
        pairs = pairs.join(values.select(F.col("id").alias(f"id_{i}"), F.col(value).alias(f"value_{i}")), f"id_{i}")
    return pairs

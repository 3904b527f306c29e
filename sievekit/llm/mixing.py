"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.session import written

SLOTS = 16_384  # blocks that the mix is cut into, as far as their bounds of size allow
LEAST_BLOCK, MOST_BLOCK = 256, 8_192  # tokens
BUCKET_DOCS = 20_000
CHUNK_SLOTS = 65_536
MAX_SOURCES = 10_000
BINS = 4_096
GOLDEN = (math.sqrt(5) - 1) / 2


def golden_point(i: Column) -> Column:
    """The fractional part of ``i`` times the golden ratio, exact enough for billions of points."""
    part = (GOLDEN * 65_536) % 1.0
    return (F.floor(i / 65_536) * F.lit(part) + F.pmod(i, F.lit(65_536)) * F.lit(GOLDEN)) % 1.0


class Mixture:
    """Documents mixed so that each source has its target share of the tokens.

    ``docs``: ``id`` long, ``source`` (plain), ``n`` tokens; ``targets``: ``source``, ``target_share``, ``max_repeats``.

    Documents of a source are shuffled by hash and laid end to end, round after round, as often as ``max_repeats`` allows; that row is
    cut into blocks of ``block_tokens``, which are all full but the very last; a document that reaches over a boundary is in both blocks
    with its part (``start``, ``n``).  The mix has as many slots as all documents that have a source have blocks; the points of the golden-ratio
    sequence, mapped through the cumulative target shares, give each slot its source, so shares hold for every stretch
    of the mix.  The r-th slot of a source takes its block r; slots beyond the last block stay empty.  Positions come from prefix
    sums over hash buckets and over chunks of slots, so no source, however large, meets in one task.

    Documents without a source, or of a source without target, aren't mixed; those without tokens come with their
    block.  Shares are taken relative to their sum; null or negative ones count as 0.  An empty table gives no slots.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, block_tokens: int | None = None, bucket_docs: int = BUCKET_DOCS, chunk_slots: int = CHUNK_SLOTS, seed: int = 0) -> None:
        self.spark, self.chunk_slots = docs.sparkSession, chunk_slots
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("r"))
        rows = wanted.orderBy("source").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources have targets")
        self.docs = written(
            docs.where(F.col("source").isNotNull()).select(
                "id", "source", F.greatest(F.coalesce(F.col("n"), F.lit(0)), F.lit(0)).cast("long").alias("n"), F.xxhash64("id", F.lit(seed)).alias("h")
            )
        )
        # One row for each source that has a target, at most MAX_SOURCES; the rest is one sum.
        totals = self.docs.groupBy(F.when(F.col("source").isin([r[0] for r in rows]), F.col("source")).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("c")).collect()
        have = {t["s"]: t["n"] for t in totals}
        self.total, self.count = sum(have.values()), sum(t["c"] for t in totals)
        share = {r["source"]: max(0.0, r["w"] or 0.0) for r in rows}
        whole = sum(share.values()) or 1.0
        self.sources = [(s, share[s] / whole, max(0, {r["source"]: r["r"] or 0 for r in rows}[s]), have.get(s, 0)) for s in share]
        self.block_tokens = block_tokens or min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(self.total / SLOTS)))
        self.slots = math.ceil(self.total / self.block_tokens)
        self.buckets = max(1, math.ceil(self.count / bucket_docs))

    def _plan(self) -> DataFrame:
        """``source``, ``share``, ``max_repeats``, ``available`` tokens, ``blocks`` of all rounds, and the ``low`` to ``high`` of its points."""
        out, low = [], 0.0
        for k, (s, w, r, n) in enumerate(self.sources):
            high = 1.0 if k + 1 == len(self.sources) else low + w
            out.append((s, w, r, n, math.ceil(r * n / self.block_tokens), low, high))
            low = high
        return self.spark.createDataFrame(out, "source string, share double, max_repeats int, available long, blocks long, low double, high double")

    def _drawn(self) -> DataFrame:
        """``slot``, ``chunk``, and ``source``, ``blocks`` of its point."""
        point = golden_point(F.col("id"))
        slots = self.spark.range(self.slots).select(F.col("id").alias("slot"), point.alias("u"), F.floor(F.col("id") / self.chunk_slots).alias("chunk"), F.floor(point * BINS).cast("int").alias("bin"))
        first = F.floor(F.col("low") * BINS).cast("int")
        last = F.greatest(first, F.ceil(F.col("high") * BINS).cast("int") - 1)
        bins = self._plan().where("high > low").select("source", "blocks", "low", "high", F.explode(F.sequence(first, last)).alias("bin"))
        within = (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))
        return slots.join(F.broadcast(bins), "bin").where(within).select("slot", "chunk", "source", "blocks")  # at most MAX_SOURCES + BINS rows

    def drawn(self) -> dict[str, int]:
        """Slots of each source, filled or not."""
        if not hasattr(self, "_slots_of"):
            self._slots_of = {r["source"]: r["n"] for r in self._drawn().groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row a source
        return self._slots_of

    def blocks(self) -> DataFrame:
        """``source``, ``round`` (from 0), ``id``, ``start``, ``n``, ``block`` of every part of a document that the slots of its source may ask for."""
        drawn = self.drawn()
        rounds = [(s, n, drawn.get(s, 0), min(r, math.ceil(drawn.get(s, 0) * self.block_tokens / n)) if n else 0) for s, _, r, n in self.sources]
        rounds = F.broadcast(self.spark.createDataFrame(rounds, "source string, available long, drawn long, rounds int").where("rounds > 0"))  # a row a source
        docs = self.docs.join(rounds, "source").withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(self.buckets)))
        sums = docs.groupBy("source", "bucket").agg(F.sum("n").alias("s"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
        within = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
        size = F.lit(self.block_tokens)
        laid = docs.join(offsets, ["source", "bucket"]).withColumn("start", start).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        laid = laid.withColumn("at", F.col("round") * F.col("available") + F.col("start")).withColumn("end", F.col("at") + F.col("n"))
        first, last = F.floor(F.col("at") / size), F.least(F.floor((F.col("end") - 1) / size), F.col("drawn") - 1)
        cut = laid.where(first < F.col("drawn")).withColumn("block", F.explode(F.sequence(first, F.greatest(first, last))))
        begin = F.greatest("at", F.col("block") * size)
        return cut.select("source", "round", "id", (begin - F.col("at")).alias("start"), (F.least("end", (F.col("block") + 1) * size) - begin).alias("n"), "block")

    def schedule(self) -> DataFrame:
        """``slot``, ``source``, ``block``; slots that stay empty are left out."""
        drawn = self._drawn()
        counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("c"))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("source", "chunk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
        own = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
        ranked = drawn.withColumn("own", own).join(offsets, ["source", "chunk"]).withColumn("block", F.col("offset") + F.col("own"))
        return ranked.where(F.col("block") < F.col("blocks")).select("slot", "source", "block")

    def mix(self) -> DataFrame:
        """``slot``, ``source``, ``round``, ``id``, ``start``, ``n``: the parts of documents of the mix, in tokens."""
        return self.schedule().join(self.blocks(), ["source", "block"]).select("slot", "source", "round", "id", "start", "n")

    def report(self) -> DataFrame:
        """One row a target source: shares wanted and reached, tokens available and used, rounds, and ``standing``, all as the mix
        came out: ``short`` if slots of the source stay empty, ``repeated`` if documents come again, ``once`` otherwise."""
        used = self.mix().groupBy("source").agg(F.sum("n").alias("used"), F.max("round").alias("last"))
        drawn = self.spark.createDataFrame(list(self.drawn().items()), "source string, drawn long")
        all_used = F.sum("used").over(Window.partitionBy(F.lit(0)))  # a row a source
        rounds = F.coalesce(F.col("last") + 1, F.lit(0))
        return (
            self._plan().join(used, "source", "left").join(F.broadcast(drawn), "source", "left")
            .select(
                "source", F.col("share").alias("target_share"), "max_repeats", "available", F.coalesce("used", F.lit(0)).alias("used"), rounds.alias("rounds"),
                F.coalesce(F.col("used") / F.when(all_used > 0, all_used), F.lit(0.0)).alias("actual_share"),
                F.when(F.coalesce("drawn", F.lit(0)) > F.col("blocks"), "short").when(rounds > 1, "repeated").otherwise("once").alias("standing"),
            )
        )

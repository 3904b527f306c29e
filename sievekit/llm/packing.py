"""Filling containers of a fixed capacity: best-fit decreasing with a segment tree."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.session import written

CAPACITY = 2048
GROUP_ITEMS = 50_000
_SCHEMA = "id long, piece int, start long, size long, container long"


class OpenBins:
    """Open bins by remaining capacity, in a segment tree that knows which capacities are there."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.there = [False] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, which: int) -> None:
        self.bins[remaining].append(which)
        at = self.leaves + remaining
        while at and not self.there[at]:
            self.there[at] = True
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least remaining capacity of at least ``size``, and that capacity."""
        there, at = self.there, self.leaves + size
        if not there[at]:
            at = self._right(at)
            if at == 0:
                return None
        while at < self.leaves:
            at = 2 * at if there[2 * at] else 2 * at + 1
        remaining = at - self.leaves
        which = self.bins[remaining].pop()
        if not self.bins[remaining]:
            while at:
                there[at] = at < self.leaves and (there[2 * at] or there[2 * at + 1])
                if there[at]:
                    break
                at >>= 1
        return which, remaining

    def _right(self, at: int) -> int:
        """The next node to the right of the subtree of ``at`` that holds something, or 0."""
        while at > 1:
            if not at & 1 and self.there[at + 1]:
                return at + 1
            at >>= 1
        return 0


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, 0 upwards, for sizes 1 to ``capacity``."""
    out, bins, opened = [0] * len(sizes), OpenBins(capacity), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        found = bins.take(size)
        which, remaining = found if found else (opened, capacity)
        opened += found is None
        out[i] = which
        if remaining > size:
            bins.put(remaining - size, which)
    return out


def _pack(capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        rows, rests, first = [], [], int(group["grp"].iloc[0]) << 32
        used = 0
        for key, n in zip(group["id"].tolist(), group["n"].tolist()):
            full, rest = divmod(n, capacity)
            for p in range(full):
                rows.append((key, p, p * capacity, capacity, first + used))
                used += 1
            if rest:
                rests.append((key, full, full * capacity, rest))
            elif not full:
                rows.append((key, 0, 0, 0, None))
        for r, b in zip(rests, best_fit_decreasing([r[3] for r in rests], capacity)):
            rows.append((*r, first + used + b))
        out = pd.DataFrame(rows, columns=["id", "piece", "start", "size", "container"])
        return out.astype({"piece": "int32", "container": "Int64"})

    return run


def pack(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Items of ``df`` (``key`` long) put into containers of ``capacity``, with little unused space.

    Items are spread by hash over groups of about ``group_items``, each packed by best-fit decreasing: by falling size into
    the open bin with the least room that is enough, found in logarithmic time.  A group wastes next to
    nothing but its last bins, so groups cost about a bin each.  An item larger than the capacity, and only such, is cut:
    into pieces that fill a container each and a last piece that is packed like an item.

    Result: ``id``, ``piece`` (from 0), ``start``, ``size``, ``container``.  Items of size 0 or null take no room: one piece
    without a container.  Repeated rows are packed each; rows without a key are packed too; an empty table gives no rows.
    """
    items = written(df.select(F.col(key).cast("long").alias("id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n")))  # sizes may be dear
    groups = max(1, math.ceil(items.count() / group_items))
    return items.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("grp").applyInPandas(_pack(capacity), _SCHEMA)

"""Groups of what is linked by pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.session import written

MAX_ROUNDS = 60


def linked_groups(pairs: DataFrame) -> DataFrame:
    """Connected components of ``pairs`` (``id_1``, ``id_2`` long): ``id``, ``group_id`` (the smallest id of the group), ``n_links``.

    In each round an id takes the smallest label among its own and its neighbours', and then the label of that label, so
    chains shrink by half or more; each round is a written table, which cuts the lineage, and the last is the one that
    changes nothing.  Only counts come to the driver.  Nulls and pairs of an id with itself are left out, repeated pairs
    count once, an empty table gives no rows.
    """
    links = pairs.where("id_1 IS NOT NULL AND id_2 IS NOT NULL AND id_1 <> id_2").select("id_1", "id_2")
    both = written(links.unionByName(links.select(F.col("id_2").alias("id_1"), F.col("id_1").alias("id_2"))).distinct())
    labels = written(both.groupBy(F.col("id_1").alias("id")).agg(F.least(F.min("id_2"), F.first("id_1")).alias("label"), F.count("*").alias("n_links")))
    for _ in range(MAX_ROUNDS):
        known = labels.select(F.col("id").alias("id_2"), F.col("label").alias("other"))
        least = both.join(known, "id_2").groupBy(F.col("id_1").alias("id")).agg(F.min("other").alias("least"))
        nearer = labels.join(least, "id").select("id", "n_links", F.col("label").alias("before"), F.least("label", "least").alias("step"))
        jump = labels.select(F.col("id").alias("step"), F.col("label").alias("far"))
        after = written(nearer.join(jump, "step", "left").select("id", "n_links", "before", F.least("step", F.coalesce("far", "step")).alias("label")))
        changed = after.where("label <> before").limit(1).count()
        labels = after.select("id", "label", "n_links")
        if not changed:
            return labels.select("id", F.col("label").alias("group_id"), "n_links")
    raise RuntimeError(f"groups didn't settle in {MAX_ROUNDS} rounds")

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sievekit.operators.skew import numbered, numbered_chunks, per_key_results

SCHEMA = "key string, member string, at timestamp, n_rows int, chunk string"


def rows(seed, n):
    r = random.Random(seed)
    day = datetime(2025, 1, 1)
    out = []
    for _ in range(n):
        key = "hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None, "", *map(str, range(20))])
        member = None if r.random() < 0.2 else f"m{r.randrange(15)}" if r.random() < 0.7 else f"one{r.random()}"
        out.append((key, member, None if r.random() < 0.1 else day + timedelta(seconds=r.randrange(1000)), 1, "x"))
    return out


def want(data):
    out = {}
    for key, member, at, *_ in data:
        if key is not None:
            n, members, times = out.setdefault(key, [0, set(), []])
            out[key][0] += 1
            members.update([member] if member is not None else [])
            times.extend([at] if at is not None else [])
    return {k: (n, len(m), min(t, default=None), max(t, default=None)) for k, (n, m, t) in out.items()}


@pytest.mark.parametrize("chunk", [1, 3, 50, 100_000])
def test_per_key_results(spark, chunk):
    data = rows(chunk, 700)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r.key: (r.n_rows, r.n_members, r.first_at, r.last_at) for r in per_key_results(df, "key", "member", "at", chunk, 4).collect()}
    assert got == want(data)


def test_one_key_one_member(spark):
    df = spark.createDataFrame([("k", "m", None, 1, "")] * 40, SCHEMA)
    assert per_key_results(df, "key", "member", "at", 7).collect() == [("k", 40, 1, None, None)]


def test_empty_and_keyless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert per_key_results(none, "key", "member", "at").count() == 0
    assert per_key_results(spark.createDataFrame([(None, "m", None, 1, "")], SCHEMA), "key", "member", "at").count() == 0


def test_chunks_are_equal_whatever_the_keys(spark):
    df = spark.createDataFrame([("hot", "m", None, 1, "")] * 95 + [("a", "m", None, 1, "")] * 10, SCHEMA).select("key", F.monotonically_increasing_id().alias("salt"))
    sizes = [r["count"] for r in numbered_chunks(df, ["key", "salt"], 20, 4).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [20, 20, 20, 20, 20, 5]


def test_numbers_follow_the_order(spark):
    data = [(x, i) for i, x in enumerate(random.Random(1).choices(range(30), k=400))]
    got = numbered(spark.createDataFrame(data, "x int, i int"), ["x", "i"], 6).orderBy("number").collect()
    assert [(r.x, r.i) for r in got] == sorted(data) and [r.number for r in got] == list(range(400))

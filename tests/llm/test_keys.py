import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import bloom, topk
from sievekit.llm.pairs import pairs_with_common_key


def truth(rows, known):
    seen, out = set(known), {}
    for order, key in sorted(rows):
        if key is not None:
            out[order] = key in seen
            seen.add(key)
    return out


@pytest.mark.parametrize("keys_a_bucket", [20, 500_000])
def test_seen_before(spark, keys_a_bucket, monkeypatch):
    monkeypatch.setattr(bloom, "GATHERED_ROWS", 64)
    r = random.Random(1)
    rows = [(i, "hot" if r.random() < 0.4 else None if r.random() < 0.1 else f"k{r.randrange(800)}") for i in range(3000)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "clash") for x in rows], "row_id long, plain string, kind int, h string").repartition(7)
    known = spark.createDataFrame([("k1",), ("k2",), ("other",), (None,)], "plain string")
    out = bloom.seen_before(df, "plain", "row_id", known, absent=5000, keys_a_bucket=keys_a_bucket)
    got = {x.ord: x.seen for x in out.where("kind = 1").collect()}
    want = truth(rows, ["k1", "k2", "other"])
    assert got.keys() == want.keys() and all(got[k] for k, v in want.items() if v)  # a wrong answer is always "seen"
    assert sum(got[k] != v for k, v in want.items()) <= 1
    report = bloom.error_rate(out).first()
    assert report.n_rows == len(want) and report.absent_keys == 5000 and report.wrong <= 2 and report.wrong_rate == report.wrong / 5000


def test_seen_before_of_nothing(spark):
    none = spark.createDataFrame([], "row_id long, plain string")
    assert bloom.seen_before(none, "plain", "row_id").count() == 0
    nulls = spark.createDataFrame([(1, None)], "row_id long, plain string")
    assert bloom.seen_before(nulls, "plain", "row_id").count() == 0
    report = bloom.error_rate(bloom.seen_before(none, "plain", "row_id")).first()
    assert report.n_rows == 0 and report.wrong_rate is None
    assert [r.seen for r in bloom.seen_before(spark.createDataFrame([(1, ""), (2, "")], "row_id long, plain string"), "plain", "row_id").orderBy("ord").collect()] == [False, True]


@pytest.mark.parametrize("rate", [1e-2, 1e-4])
def test_filter_keeps_its_rate(rate):
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 150_000).astype(np.uint64) * np.uint64(2)
    f = bloom.BlockedBloom(50_000, rate)
    f.insert(keys[:50_000])
    assert f.query(keys[:50_000]).all()
    assert f.query(keys[50_000:]).mean() < 1.5 * rate + 5e-5
    with pytest.raises(ValueError):
        bloom.shape(1e-30)


def test_most_frequent(spark):
    df = spark.createDataFrame([(v,) for v in ["b"] * 5 + ["a"] * 5 + ["c"] * 9 + [None] * 30 + ["", "d"]], "value string")
    assert topk.most_frequent(df, "value", 3).collect() == [("c", 9), ("a", 5), ("b", 5)]
    assert topk.most_frequent(df, "value", 100).count() == 5
    assert topk.most_frequent(df.where("false"), "value", 3).count() == 0
    plan = topk.most_frequent(df, "value", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "partial_count" in plan


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_pairs_with_common_key(spark, block):
    r = random.Random(block)
    keys = {(r.choice([1, 1, 1, *range(30)]), r.randrange(60)) for _ in range(150)}
    by = {}
    for k, i in keys:
        by.setdefault(k, []).append(i)
    want = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    df = spark.createDataFrame(sorted(keys) * 2, "key long, id long")  # repeated rows too
    assert {tuple(x) for x in pairs_with_common_key(df, block).collect()} == want
    assert pairs_with_common_key(df, block).count() == len(want)
    assert pairs_with_common_key(df.where(F.lit(False))).count() == 0


def test_kept_filters(spark, tmp_path):
    r = random.Random(4)
    folder, before = str(tmp_path / "seen"), set()
    for number in range(4):
        keys = bloom.SeenKeys(spark, folder, buckets=3, keys_a_bucket=50, rate=1e-4)  # opened anew each time
        assert keys.batches == number and keys.buckets == 3
        batch = [(i, r.choice(["hot", f"k{r.randrange(400)}", None])) for i in range(300)]
        got = {x.ord: x.seen for x in keys.add(spark.createDataFrame(batch, "i long, key string"), "key", "i").collect()}
        want, own = {}, set(before)
        for i, k in batch:
            if k is not None:
                want[i] = k in own
                own.add(k)
        assert got.keys() == want.keys() and all(got[i] for i in want if want[i])
        assert sum(got[i] != want[i] for i in want) <= 2
        before = own
    none = bloom.SeenKeys(spark, folder).add(spark.createDataFrame([], "i long, key string"), "key", "i")
    assert none.count() == 0 and bloom.SeenKeys(spark, folder).batches == 5
    # A batch that didn't come to its end doesn't count.
    again = bloom.SeenKeys(spark, folder)
    broken = spark.createDataFrame([(1, "new key")], "i long, key string").withColumn("i", F.raise_error(F.lit("x")).cast("long"))
    with pytest.raises(Exception):
        again.add(broken, "key", "i")
    assert [x.seen for x in bloom.SeenKeys(spark, folder).add(spark.createDataFrame([(1, "new key")], "i long, key string"), "key", "i").collect()] == [False]


def test_growing_filter():
    f, r = bloom.GrowingBloom(100, 1e-3), np.random.default_rng(1)
    h = r.integers(0, 1 << 64, 5000, dtype=np.uint64)
    for k in range(0, 5000, 37):
        f.insert(h[k : k + 37])
    g = bloom.GrowingBloom.load(f.dump())
    assert len(g.filters) == 6 and g.left == f.left and g.query(h).all()
    assert g.query(r.integers(0, 1 << 64, 100_000, dtype=np.uint64)).mean() <= 2e-3

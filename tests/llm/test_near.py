import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievekit.functions import ctph, tlsh
from sievekit.llm import hamming
from sievekit.llm import segments
from sievekit.llm.segments import SegmentIndex
from tests.test_fuzzy import some_digests


def tlsh_family(r, families, size):
    out = []
    for _ in range(families):
        base = r.randbytes(35)
        for _ in range(size):
            x = bytearray(base)
            for _ in range(r.randint(0, 14)):
                x[r.choice((0, 1, 2, *range(3, 35)))] ^= r.choice((1, 2, 4, 8, 16, 32, 64, 128))
            out.append("T1" + bytes(x).hex().upper())
    return list(dict.fromkeys(out))


@pytest.mark.parametrize("limit", [0, 15, 16, 40, 47])
@pytest.mark.parametrize("unit", [7, 16_384])
def test_tlsh_pairs(spark, limit, unit):
    texts = tlsh_family(random.Random(limit), 6, 12)
    df = spark.createDataFrame([(100 - i, t, "x") for i, t in enumerate(texts)] + [(1000, None, ""), (1001, "bad", "")], "id long, plain string, sig string")
    want = {(min(100 - i, 100 - j), max(100 - i, 100 - j), d) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and (d := tlsh.distance(x, y)) <= limit}
    got = [tuple(r) for r in hamming.tlsh_pairs(df, limit, unit).collect()]
    assert set(got) == want and len(got) == len(want)


def test_tlsh_pairs_by_pigeonhole():
    assert all(sum(r + 1 for r in hamming.chunk_radii(n)) == n + 1 for n in range(48))
    r = random.Random(9)
    for radius in (0, 1, 2):
        starts, around = hamming._balls(radius)
        for _ in range(40):
            v = r.randrange(1 << 16)
            codes = lambda x: [x >> s & 3 for s in range(0, 16, 2)]
            want = {w for w in (r.randrange(1 << 16) for _ in range(500)) if sum(abs(a - b) for a, b in zip(codes(v), codes(w))) <= radius}
            mine = around[starts[v] : starts[v + 1]].tolist()
            assert want <= set(mine) and len(mine) == len(set(mine)) and v in mine
            assert all(sum(abs(a - b) for a, b in zip(codes(v), codes(w))) <= radius for w in mine)


def test_tlsh_limits(spark):
    df = spark.createDataFrame([], "id long, plain string")
    assert hamming.tlsh_pairs(df).count() == 0
    with pytest.raises(ValueError):
        hamming.tlsh_pairs(df, 48)


def test_ssdeep_pairs(spark):
    texts = list(dict.fromkeys([*some_digests(random.Random(4), 25), "3:aaaab:c", "3:aaaaaab:c", "3::", "6::"]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "bad")], "id long, plain string")
    want = {(i, j, s) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and (s := ctph.score(x, y)) >= 40}
    got = {tuple(r) for r in hamming.ssdeep_pairs(df).collect()}
    assert got == want
    assert hamming.ssdeep_pairs(df.where(F.lit(False))).count() == 0
    with pytest.raises(ValueError):
        hamming.ssdeep_pairs(df, 0)


def paths(r, n):
    word = lambda: "".join(r.choices(["ka", "lo", "mir", "stu", "pex", "qua", "vin", "dro"], k=3))
    out = []
    for _ in range(n):
        parts = ["/Applications", word() + ".app", "Contents", r.choice(["MacOS", "Resources"]), word(), f"{word()}-{word()}_{word()}.bin"]
        out.append("/".join(parts))
        for _ in range(2):
            t = list(out[-1])
            for _ in range(r.randint(1, 4)):
                t[r.randrange(len(t))] = r.choice("abcxyz ü")
            out.append("".join(t))
    return list(dict.fromkeys(out))


def grams(t, n):
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def test_text_pairs(spark):
    texts = paths(random.Random(2), 120)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (9002, "abc"), (9003, "x" * 50_000), (9004, "x" * 50_001)], "id long, text string")
    sets = [grams(t, 4) for t in texts]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and len(x & y) / len(x | y) >= 0.7}
    got = {(r.id_1, r.id_2) for r in hamming.text_pairs(df).collect()}
    assert got == want | {(9003, 9004)} and len(want) > 50
    assert hamming.text_pairs(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("unit", [9, 100, 16_384])
def test_text_pairs_in_one_folder(spark, unit):
    r = random.Random(5)
    name = lambda least, most: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(least, most)))
    folder = "/Applications/" + "/".join(name(15, 15) for _ in range(6))
    texts = list(dict.fromkeys([folder + "/" + name(8, 30) for _ in range(150)] + paths(r, 100)))
    r.shuffle(texts)
    sets = [grams(t, 4) for t in texts]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 10 * len(x & y) >= 7 * len(x | y)}
    got = [(p.id_1, p.id_2) for p in hamming.text_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), unit_rows=unit).collect()]
    assert set(got) == want and len(got) == len(want) > 1000


def test_copies_of_tlsh_rows(spark):
    """Three units a row up to 65,536 digests a cell; beyond that one more for each further block."""
    rows = spark.range(3000).select("id", F.concat(F.lit("T1000000"), F.lpad(F.hex("id"), 64, "0")).alias("plain"))
    copies = lambda unit_rows: hamming.tlsh_units(rows, unit_rows).count() / 3000
    assert copies(hamming.UNIT_ROWS) == copies(3000) == 3 and copies(300) == 12


@pytest.mark.parametrize("least", [0.3, 0.7, 1.0])
def test_text_pairs_at_limits(spark, least):
    r = random.Random(7)
    texts = list(dict.fromkeys("".join(r.choices("ab", k=r.randint(0, 40))) for _ in range(150)))
    sets = [grams(t, 4) for t in texts]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and y and len(x & y) / len(x | y) >= least}
    assert {(p.id_1, p.id_2) for p in hamming.text_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), 4, least).collect()} == want


@pytest.mark.parametrize("rows", [40, 200])  # pairs one by one, and in tiles
def test_filter_of_text_pairs_drops_none(rows):
    r = random.Random(rows)
    name = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=k))
    folder = name(110)
    texts = [folder + name(r.randint(4, 40)) for _ in range(rows // 2)] + [name(r.randint(20, 900)) for _ in range(rows // 4)]
    texts += [t[: r.randint(len(t) * 7 // 10, len(t))] for t in texts[-(rows // 4) :]]
    h, starts = hamming.text_grams(texts, 4)
    n = np.diff(starts)
    words = hamming.parities(h, np.repeat(np.arange(len(texts)), n), len(texts))
    sets = [grams(t, 4) for t in texts]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            assert np.bitwise_count(words[i] ^ words[j]).sum() <= len(x ^ y)
    for side in (np.zeros(len(texts)), np.where(np.arange(len(texts)) % 2, 1, -1)):
        columns = [np.full(len(texts), 7), side.astype(np.int32), np.arange(len(texts)), n.astype(np.int32), *words.view(np.int64).T]
        batch = pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "side", "id", "n", *(f"w{k}" for k in range(4))])
        cut = rows // 3  # the unit goes on in the next batch
        got = {(p["id_1"], p["id_2"]) for b in hamming._candidates(0.7)(iter([batch.slice(0, cut), batch.slice(cut)])) for p in b.to_pylist()}
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and 10 * len(x & y) >= 7 * len(x | y) and (not side[i] or side[i] != side[j])}
        assert want and want <= got < {(i, j) for j in range(len(texts)) for i in range(j)}


def near(algo, x, y):
    return x == y or algo == "ssdeep" and ctph.score(x, y) >= 40 or algo == "tlsh" and tlsh.distance(x, y) <= 40


def test_segment_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "PART_ROWS", {"digests": 30, "segments": 100, "chunks": 6})
    r = random.Random(8)
    pool = [("ssdeep", t) for t in [*some_digests(r, 30), "3:aaaab:c", "3:aaaaaab:c", "3:a:"]] + [("tlsh", t) for t in tlsh_family(r, 8, 6)] + [("md5", "%032x" % r.getrandbits(128)) for _ in range(20)]
    index, accepted = SegmentIndex(spark, str(tmp_path / "index")), {0: [], 1: []}
    for number in range(4):
        batch = [(r.randrange(2), *r.choice(pool), "x") for _ in range(90)]
        batch += batch[:20]  # repeated rows
        df = spark.createDataFrame([*batch, (0, "md5", None, "x"), (None, "md5", "0" * 32, "x")], "space int, algo string, plain string, id string")
        got = {(s.space, s.plain): s.status for s in index.add(df, number).collect()}
        want = {}
        for space, algo, plain, _ in batch:
            old = [p for a, p in accepted[space] if a == algo]
            want[space, plain] = "equal" if plain in old else "near" if any(near(algo, plain, p) for p in old) else "new"
        assert got == want
        for space, algo, plain, _ in {(*b[:3], "") for b in batch}:
            if want[space, plain] == "new":
                accepted[space].append((algo, plain))
    assert index.accepted().count() == sum(map(len, accepted.values())) and {"equal", "near", "new"} <= {s.status for s in index.judged().collect()}


def test_segment_index_of_nothing(spark, tmp_path):
    index = SegmentIndex(spark, str(tmp_path / "index"))
    none = spark.createDataFrame([], "space int, algo string, plain string")
    assert index.accepted().count() == 0 and index.add(none, 0).count() == 0 and index.add(none, 1).count() == 0


def test_segment_index_is_opened_again(spark, tmp_path):
    r = random.Random(5)
    digests = [("ssdeep", t) for t in some_digests(r, 12)] + [("tlsh", t) for t in tlsh_family(r, 3, 3)] + [("md5", "%032x" % k) for k in range(9)]
    frame = lambda part: spark.createDataFrame([(0, *d) for d in part], "space int, algo string, plain string")
    one, two = SegmentIndex(spark, str(tmp_path / "a"), buckets=5), SegmentIndex(spark, str(tmp_path / "b"), buckets=5)
    for index in (one, two):
        index.add(frame(digests[::2]), 0)
    two = SegmentIndex(spark, str(tmp_path / "b"))  # from its folder alone
    assert two.buckets == 5 and two.stored == one.stored and two.accepted().count() == one.accepted().count()
    answers = [{(x.plain, x.status) for x in index.add(frame(digests), 1).collect()} for index in (one, two)]
    assert answers[0] == answers[1] and len(answers[0]) == len(set(digests))
    # What a failed batch left behind doesn't count.
    rest = spark.createDataFrame([(0, "md5", "ff" * 16)], "space int, algo string, plain string").withColumns({"id": F.xxhash64("space", "plain"), "commit": F.lit("c7")})
    rest.withColumn("bucket", two._bucket(F.col("id"))).write.mode("append").partitionBy("bucket", "commit").parquet(str(tmp_path / "b" / "digests"))
    assert SegmentIndex(spark, str(tmp_path / "b")).accepted().count() == one.accepted().count()
    assert [x.status for x in SegmentIndex(spark, str(tmp_path / "b")).add(frame([("md5", "ff" * 16)]), 2).collect()] == ["new"]


@pytest.mark.parametrize("batches", [3, 9])
def test_batch_reads_the_buckets_it_asks_only(spark, tmp_path, monkeypatch, batches):
    index = SegmentIndex(spark, str(tmp_path / "index"), buckets=8)
    frame = lambda part: spark.createDataFrame([(0, "md5", p) for p in part], "space int, algo string, plain string")
    bucket = {r.plain: r.b for r in frame(f"{k:032x}" for k in range(800)).select("plain", index._bucket(F.xxhash64("space", "plain")).alias("b")).collect()}
    asked, others = [p for p in bucket if bucket[p] == 3], [p for p in bucket if bucket[p] != 3]
    index.add(frame(asked[:40]), 0)
    for k in range(batches):
        index.add(frame(others[50 * k : 50 * k + 50]), 1 + k)
    assert index.accepted().count() == 40 + 50 * batches
    read = []
    stored = segments.Stored(index.folder, index.commits)
    whole = stored.read
    monkeypatch.setattr(stored, "read", lambda *a: (read.append(t.num_rows) or t for t in whole(*a)))
    rows = frame(asked[35:45]).select(F.lit(3).alias("bucket"), F.lit(0).alias("part"), F.xxhash64("space", "plain").alias("key"), F.xxhash64("space", "plain").alias("id"))
    found = [p for b in segments._find_digests(stored, {})(iter(rows.toArrow().to_batches())) for p in b.column("plain").to_pylist()]
    assert sum(read) == 40 and sorted(found) == sorted(asked[35:40])
    assert {r.status for r in index.add(frame(asked[35:40]), 99).collect()} == {"equal"}

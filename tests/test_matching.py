import random

import pytest
from pyspark.sql import functions as F

from sievekit import queries
from sievekit.config import DigestSpec
from sievekit.functions import ctph, tlsh
from sievekit.operators.matching import first_of_file, match, ssdeep_score, tlsh_distance
from sievekit.plans.pipeline import DigestQuery


def frame(spark, digests, name="digest"):
    return spark.createDataFrame([(i, d, "x") for i, d in enumerate(digests)], f"id long, {name} string, target string")


def both(spark, digests, targets, algo, threshold=40):
    """Result of a list and of a table of targets, which must be the same."""
    rows = frame(spark, digests)
    table = spark.createDataFrame([(t,) for t in targets], "target string")
    pick = lambda df: sorted((r.id, r.score) for r in df.collect())
    inline, joined = pick(match(rows, targets, algo, threshold)), pick(match(rows.drop("target"), table, algo, threshold))
    assert inline == joined
    return inline


def test_exact(spark):
    assert both(spark, ["abc123", "ABC123", "def456", None, "", "abc"], ["abc123", "Abc123", None, "zzz"], "sha256") == [(0, None), (1, None)]
    assert both(spark, ["a"], [], "md5") == [] == both(spark, [], ["a"], "md5")
    assert both(spark, ["a", "a"], ["a"], "git") == [(0, None), (1, None)]


def test_many_targets(spark):
    assert [r.id for r in match(frame(spark, ["5", "x"]), [str(i) for i in range(3000)], "md5").collect()] == [0]


def test_prefix(spark):
    rows = ["abcdef" * 10, "ABCDEF", "abc", "bcd", None, ""]
    assert both(spark, rows, ["abcdef", "abcde"], "cdhash") == [(0, None), (1, None), (2, None), (5, None)]
    assert [i for i, _ in both(spark, rows, [""], "cdhash")] == [0, 1, 2, 3, 5]
    assert [i for i, _ in both(spark, rows, ["BCDX"], "cdhash")] == [3, 5]
    assert both(spark, rows, [], "cdhash") == []
    r = random.Random(3)
    text = lambda: "".join(r.choices("ab", k=r.randint(0, 9)))
    rows, targets = [text() for _ in range(60)], [text() for _ in range(8) if r.random() < 0.8]
    want = [i for i, d in enumerate(rows) if any(d.startswith(t) or t.startswith(d) for t in targets)]
    assert [i for i, _ in both(spark, rows, targets, "cdhash")] == want


@pytest.mark.parametrize("threshold", [1, 40, 100])
def test_ssdeep(spark, threshold):
    from tests.test_fuzzy import some_digests

    r = random.Random(7)
    rows = [*some_digests(r, 12), None, "malformed", "3:ab:cd"]
    targets = [*r.sample(rows[:-3], 8), "broken", "3:ab:cd"]
    want = []
    for i, d in enumerate(rows):
        s = [x for t in targets if d is not None and (x := ctph.score(d, t)) >= threshold]
        want += [(i, max(s))] if s else []
    assert both(spark, rows, targets, "ssdeep", threshold) == want


def test_ssdeep_thresholds_that_all_meet(spark):
    rows = ["96:abcdefgh:abc", "3:xyz:x", "malformed", None]
    assert both(spark, rows, ["96:abcdefgh:abc"], "ssdeep", 0) == [(0, 100), (1, 0)]
    assert both(spark, rows, ["96:abcdefgh:abc"], "ssdeep", -1) == [(0, 100), (1, 0), (2, 0)]
    assert both(spark, rows, ["malformed"], "ssdeep", 0) == [] == both(spark, rows, [], "ssdeep", 0)


@pytest.mark.parametrize("threshold", [0, 11, 40, 300])
def test_tlsh(spark, threshold):
    r = random.Random(2)
    base = [r.randbytes(35) for _ in range(4)]
    rows = []
    for b in base:
        for _ in range(12):
            x = bytearray(b)
            for _ in range(r.randint(0, 9)):
                x[r.choice((0, 1, 2, *range(3, 35)))] ^= 1 << r.randint(0, 7)
            rows.append("T1" + bytes(x).hex().upper())
    rows += [rows[0].lower(), rows[1][2:], None, "malformed", ""]
    targets = [*rows[:3], rows[20][2:], "bad"]
    want = []
    for i, d in enumerate(rows):
        n = [x for t in targets if d is not None and 0 <= (x := tlsh.distance(d, t)) <= threshold]
        want += [(i, min(n))] if n else []
    assert both(spark, rows, targets, "tlsh", threshold) == want
    assert both(spark, rows, targets, "tlsh", -5) == []


def test_first_of_file(spark):
    df = spark.createDataFrame([(1, 3, "a (x)", "a"), (1, 2, "a (y)", "a"), (2, 1, "b", "b")], "seq long, slice_idx int, path string, file_path string")
    assert sorted((r.slice_idx, r.path) for r in first_of_file(df).collect()) == [(1, "b"), (2, "a")]


def test_distances_of_examples(spark):
    assert "distances_of_examples" not in queries.QUERIES  # it read no table
    t = "T1" + "A0" * 35
    rows = spark.createDataFrame([(t, t.lower(), "96:" + "abcdefgh" * 4 + ":" + "abcdefgh" * 2)], "a string, b string, s string")
    score, distance = ssdeep_score.asNondeterministic(), tlsh_distance.asNondeterministic()
    got = rows.select(distance("a", "b"), distance(F.lit("invalid"), F.lit("alsobad")), score("s", "s"), score(F.lit("3:abc:def"), F.lit("96:zzz:yyy"))).first()
    assert tuple(got) == (0, -1, 100, 0)


@pytest.mark.parametrize("algo,near,far", [("ssdeep", "12:abcdefghijklm:x", "12:abcdefgzzzzzz:y"), ("tlsh", "T1" + "0" * 70, "T1" + "0" * 66 + "0055")])
def test_score_of_zero_for_a_list_and_a_table(spark, algo, near, far):
    """Not given in a query, whatever the targets come from; zero in the functions."""
    rows = spark.createDataFrame([(1, 0, "p", "p", None, near)], "seq long, slice_idx int, path string, file_path string, arch string, digest string")
    table = spark.createDataFrame([(far,)], "target string")
    spec = DigestSpec(algorithm=algo, score=0)
    of_list = DigestQuery(DigestSpec(algorithm=algo, score=0, targets=(far,))).matched(rows).collect()
    of_table = DigestQuery(spec).matched(rows, table).collect()
    assert [r.score for r in of_list] == [r.score for r in of_table]
    assert [r.score for r in match(rows, [far], algo, 0).collect()] == [r.score for r in match(rows, table, algo, 0).collect()]


@pytest.mark.parametrize("algo", ["ssdeep", "tlsh", "cdhash"])
def test_digests_are_computed_once_for_a_table_of_targets(spark, algo):
    count = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def dear(s):
        count.add(1)
        return s

    rows = spark.range(20).select(F.col("id").alias("seq"), dear.asNondeterministic()(F.format_string("T1%070X", "id")).alias("digest"))
    targets = spark.createDataFrame([("T1" + "0" * 70,)], "target string")
    assert match(rows, targets, algo, 40).count() >= 1 - (algo == "ssdeep")
    assert count.value == 20

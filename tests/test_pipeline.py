import hashlib

import pytest
from pyspark.sql import functions as F

from sievekit.config import DigestSpec
from sievekit.formats.build import ARM64, X86_64, directory, fat_file, signature_blob, signed_file, with_symbols
from sievekit.operators.formatting import line, match_line, padded
from sievekit.plans.pipeline import DigestQuery, write_lines
from sievekit.streaming.live import live_counts, live_results

PART = [signed_file(signature_blob([(0, directory(b"%d" % i, 2))])) for i in range(2)]
CD = [hashlib.sha256(directory(b"%d" % i, 2)).hexdigest() for i in range(2)]
SYMBOLS = with_symbols([(1, "_a")])
FILES = [(1, "b", fat_file([(X86_64, 3, PART[0]), (ARM64, 0, PART[1])])), (2, "a", b"hello"), (3, "c", fat_file([(X86_64, 3, SYMBOLS), (ARM64, 0, SYMBOLS)]))]
MD5A = hashlib.md5(b"_a").hexdigest()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "seq long, path string, content binary")


def lines(files, **spec):
    return [r.line for r in DigestQuery(DigestSpec(sort=True, **spec)).lines(files).collect()]


def test_lines(files):
    sha = [hashlib.sha256(b).hexdigest() for _, _, b in FILES]
    assert lines(files) == [f"{sha[1]}  a", f"{sha[0]}  b", f"{sha[2]}  c"]
    assert lines(files, quiet=True) == [sha[1], sha[0], sha[2]]
    assert lines(files, targets=(sha[1].upper(),)) == [f"{sha[1]}  a"]
    assert lines(files, targets=(sha[1],), quiet=True) == ["a"]


def test_slices_may_print_a_path_twice(files):
    whole, part = hashlib.sha256(FILES[2][2]).hexdigest(), hashlib.sha256(SYMBOLS).hexdigest()
    assert lines(files, slices=True, targets=(whole, part), quiet=True) == ["c", "c", "c"]
    assert lines(files, slices=True, targets=(part,)) == [f"{part}  c (x86_64)", f"{part}  c (arm64)"]


def test_cdhash(files):
    assert lines(files, algorithm="cdhash") == [f"{CD[0]}  b (x86_64)", f"{CD[1]}  b (arm64)"]
    assert lines(files, algorithm="cdhash", targets=(CD[1][:40],)) == [f"{CD[1]}  b (arm64)"]
    assert lines(files, algorithm="cdhash", targets=(CD[1][:40], CD[0]), quiet=True) == ["b"]


def test_symhash_first_match(files):
    assert lines(files, symhash=True) == [f"{MD5A}  c (x86_64)", f"{MD5A}  c (arm64)"]
    assert lines(files, symhash=True, targets=(MD5A,)) == [f"{MD5A}  c"]
    assert lines(files, symhash=True, slices=True, targets=(MD5A,)) == [f"{MD5A}  c (x86_64)", f"{MD5A}  c (arm64)"]
    assert lines(files, symhash=True, slices=True, quiet=True, targets=(MD5A,)) == ["c"]


def test_fuzzy_lines(spark):
    import random

    data = random.Random(1).randbytes(2000)
    df = spark.createDataFrame([(1, "p", data)], "seq long, path string, content binary")
    for algo, width in (("tlsh", 4), ("ssdeep", 3)):
        plain = lines(df, algorithm=algo)[0]
        digest = plain.split()[0]
        assert plain == (digest.ljust(107) if algo == "ssdeep" else digest) + "  p"
        score = "0" if algo == "tlsh" else "100"
        assert lines(df, algorithm=algo, targets=(digest,), score=0) == [plain[:-3] + " " + score.rjust(width) + "  p"]
        assert lines(df, algorithm=algo, quiet=True) == [digest]


def test_formats(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(line(F.lit("d"), F.lit("p"), "md5")) == "d  p"
    assert one(match_line(F.lit("d"), F.lit(7), F.lit("p"), "tlsh")) == "d    7  p"
    assert one(match_line(F.lit("d"), F.lit(7), F.lit("p"), "md5")) == "d   p"
    assert len(one(padded(F.lit("x" * 120), "ssdeep"))) == 120 and len(one(padded(F.lit("x"), "ssdeep"))) == 107


def test_unknown_algorithm_fails_at_once():
    with pytest.raises(ValueError):
        DigestQuery(DigestSpec(algorithm="nope"))


def test_write_lines(files, tmp_path, spark):
    write_lines(DigestQuery(DigestSpec()).lines(files), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_streams(spark, files, tmp_path):
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    digest = hashlib.md5(b"hello").hexdigest()
    q = live_results(stream, DigestQuery(DigestSpec(algorithm="md5", targets=(digest,)))).writeStream.format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    assert [r.path for r in spark.table("live").collect()] == ["a"]


def test_windowed_counts(spark, tmp_path):
    rows = spark.sql(f"SELECT 'md5' algo, '{'a' * 32}' digest, timestamp'2025-01-01 00:10:00' + make_interval(0, 0, 0, 0, 5 * id, 0, 0) received_at FROM range(3)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = live_counts(stream).writeStream.format("memory").outputMode("complete").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n_rows for r in spark.table("counts").collect()) == [1, 1, 1]

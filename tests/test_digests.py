import hashlib

import pytest
from pyspark.sql import functions as F

from sievekit.functions.digests import digest, digest_bytes, hex_text, register
from sievekit.sources.chunked import digest_file

VECTORS = [
    (b"", "md5", "d41d8cd98f00b204e9800998ecf8427e"),
    (b"", "sha1", "da39a3ee5e6b4b0d3255bfef95601890afd80709"),
    (b"", "sha256", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"),
    (b"hello", "md5", "5d41402abc4b2a76b9719d911017c592"),
    (b"hello", "sha1", "aaf4c61ddcc5e8a2dabede0f3b482cd9aea9434d"),
    (b"hello", "sha256", "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"),
    (b"", "git", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"),
    (b"hello", "git", "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"),
    (b"", "git256", "473a0f4c3be8a93681a267e3b1e9a7dcda1185436fe141f7749120a303721813"),
    (b"hello", "git256", "8aec4e4876f854f688d0ebfc8f37598f38e5fd6903cccc850ca36591175aeb60"),
]
DATA = [b"", b"hello", b"\0\xff" * 40, "äöü".encode() * 33, bytes(range(256)) * 300, None]


@pytest.mark.parametrize("data,algo,want", VECTORS)
def test_vectors(data, algo, want, tmp_path):
    assert digest_bytes(data, algo) == want
    (tmp_path / "f").write_bytes(data)
    assert digest_file(str(tmp_path / "f"), algo) == want


@pytest.mark.parametrize("algo", ["md5", "sha1", "sha256", "sha384", "sha512", "git", "git256", "ssdeep", "tlsh", "cdhash"])
def test_columns_equal_python(spark, algo):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(DATA)], "i int, content binary")
    got = dict(df.select("i", digest(F.col("content"), algo)).collect())
    assert got == {i: None if b is None else digest_bytes(b, algo) for i, b in enumerate(DATA)}


def test_large_file_in_chunks(tmp_path):
    data = bytes(i * i % 251 for i in range(3_000_000))
    p = tmp_path / "big"
    p.write_bytes(data)
    assert len(data) > 2 << 20
    for algo in ("sha384", "git", "git256", "tlsh", "ssdeep"):
        assert digest_file(str(p), algo) == digest_bytes(data, algo)
    assert digest_file(str(p), "md5", chunk=1000) == hashlib.md5(data).hexdigest()
    with pytest.raises(OSError):
        digest_file(str(tmp_path / "missing"), "md5")


def test_empty_part_has_no_ssdeep_digest(spark):
    df = spark.createDataFrame([(b"",)], "content binary")
    assert df.select(digest(F.col("content"), "ssdeep"), digest(F.col("content"), "ssdeep", part=True)).first() == ("3::", None)


def test_fuzzy_digest_is_computed_once(spark):
    df = spark.createDataFrame([(b"x" * 100,)], "content binary").select(digest(F.col("content"), "ssdeep").alias("d")).where("d <> ''")
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_sql_functions_and_hex(spark):
    register(spark)
    row = spark.sql("SELECT digest_ssdeep(X'00') a, ssdeep_score('3:abc:def', '96:zzz:yyy') b, tlsh_distance('x', 'y') c").first()
    assert row == ("3:F:F", 0, -1) or row[1:] == (0, -1)
    assert spark.range(1).select(hex_text(F.lit(bytearray(b"\x0a\xff")))).first()[0] == "0aff"

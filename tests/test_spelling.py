import pytest
from pyspark.sql import functions as F

from sievekit.functions.spelling import plain_digest, plain_name

H = "0123456789abcdef" * 2
T = "T1" + "0A" * 35
S = "96:AbC+/d:efG"
CASES = [
    ("md5", H, H), ("md5", H.upper(), H), ("md5", " " + H + "\r\n", H), ("md5", "0x" + H, H), ("md5", "md5:" + H, H), ("md5", "MD5 (/a (b) = c) = " + H, H),
    ("md5", ":".join(H[i : i + 2] for i in range(0, 32, 2)), H), ("md5", "-".join(H[i : i + 8] for i in range(0, 32, 8)).upper(), H), ("md5", H + "  /a b", H), ("md5", H + " */a", H),
    ("md5", H[:-1], None), ("md5", H + "0", None), ("md5", "g" + H[1:], None), ("md5", "", None), ("md5", None, None), ("md5", "no such file", None), ("crc", H, None), (None, H, None),
    ("git", H + "01234567", H + "01234567"), ("sha512", H * 4, H * 4), ("sha384", H * 3, H * 3), ("cdhash", H * 2, H * 2),
    ("tlsh", T, T), ("tlsh", T.lower(), T), ("tlsh", T[2:].lower(), T), ("tlsh", "TLSH:" + T, T), ("tlsh", T + "  /a", T), ("tlsh", T[:-2], None), ("tlsh", T + "00", None), ("tlsh", T[:-1] + "x", None),
    ("ssdeep", S, S), ("ssdeep", "\t" + S + "\n", S), ("ssdeep", S + ',"/a b"', S), ("ssdeep", S + "     /a", S), ("ssdeep", "AbC:efG", None), ("ssdeep", "96:AbC", None), ("ssdeep", "96:A#:b", None),
    ("ssdeep", "96:" + "a" * 65 + ":b", None), ("ssdeep", "96:a:" + "b" * 33, None),
]


def test_plain(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, algo string, digest string, want string")
    bad = [r for r in df.withColumn("got", plain_digest(F.col("algo"), F.col("digest"))).collect() if r.got != r.want]
    assert not bad


@pytest.mark.parametrize("text,want", [("Tinker Yard", "tinker-yard"), (" a_B\t", "a-b"), ("", None), (" - ", None), (None, None)])
def test_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(plain_name(F.col("t"))).first()[0] == want

import pytest

from sievekit.config import Algorithm, DigestSpec, Mode
from sievekit.functions.digests import digest_bytes


def test_names_case_and_alias():
    assert Algorithm.parse("SHA2") is Algorithm.SHA256 and Algorithm.parse("Tlsh") is Algorithm.TLSH
    with pytest.raises(ValueError, match="unsupported"):
        Algorithm.parse("crc32")
    with pytest.raises(ValueError):
        digest_bytes(b"", "whirlpool")
    assert {a for a in Algorithm if a.is_fuzzy} == {Algorithm.SSDEEP, Algorithm.TLSH}


def test_default_algorithms():
    assert DigestSpec().algo == "sha256" and DigestSpec(symhash=True).algo == "md5" and DigestSpec(xar_toc=True).algo == "sha1"
    assert DigestSpec(algorithm="sha512", symhash=True).algo == "sha512"


def test_mode_precedence():
    assert DigestSpec(symhash=True, xar_toc=True).mode is Mode.SYMHASH
    assert DigestSpec(xar_toc=True, algorithm="cdhash").mode is Mode.XAR_TOC
    assert DigestSpec(algorithm="cdhash", slices=True).mode is Mode.CDHASH
    assert DigestSpec(slices=True).mode is Mode.SLICES and DigestSpec().mode is Mode.REGULAR


def test_threshold():
    assert DigestSpec().threshold == 40
    assert DigestSpec(algorithm="tlsh", targets=("T1",), score=0).threshold == 40
    assert DigestSpec(algorithm="tlsh", score=0).threshold == 0
    assert DigestSpec(algorithm="md5", targets=("a",), score=0).threshold == 0
    assert DigestSpec(algorithm="ssdeep", targets=("a",), score=-1).threshold == -1


def test_separator_and_jobs():
    assert DigestSpec(separator=r"a\n\0\t").joiner == "a\n\0\t"
    assert [DigestSpec(jobs=j).parallelism(6) for j in (0, -3, 1, 4)] == [6, 1, 1, 4]

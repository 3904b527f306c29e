import hashlib

import pytest
from pyspark.sql import functions as F

from sievekit.formats import macho
from sievekit.formats.build import ARM64, X86_64, directory, fat_file, signature_blob, signed_file, with_symbols, xar_file
from sievekit.functions.digests import digest_bytes
from sievekit.operators import decode

SIGNED = [signed_file(signature_blob([(0, directory(b"%d" % i, 2))])) for i in range(2)]
FILES = {
    "fat": fat_file([(X86_64, 3, b"first" * 30), (ARM64, 2, b"second!" * 30)]),
    "text": b"plain text" * 10,
    "empty": b"",
    "missing": None,
    "outside": fat_file([(7, 3, b"x" * 50)])[:-10],
    "signed": fat_file([(X86_64, 3, SIGNED[0]), (7, 3, b"unsigned"), (ARM64, 0, SIGNED[1])]),
    "thin": SIGNED[1],
    "symbols": fat_file([(X86_64, 3, with_symbols([(1, "_printf"), (1, "_malloc"), (1, "_free")])), (ARM64, 0, with_symbols([]))]),
    "archive": xar_file(b"fake-toc-data"),
    "java": b"\xca\xfe\xba\xbe\0\0\0\x34" + b"x" * 100,
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(i, n, b, "clash", 1) for i, (n, b) in enumerate(FILES.items())]
    return spark.createDataFrame(rows, "seq long, path string, content binary, digest string, slice_idx int").repartition(3)


def shown(df):
    return {(r.path, r.slice_idx): r.digest for r in df.collect()}


def test_columns_and_empty_table(spark, files):
    none = files.where(F.lit(False))
    for made in (decode.whole_files(none, "md5"), decode.with_slices(none, "tlsh"), decode.cdhashes(none), decode.symhashes(none), decode.xar_tocs(none, decompress=True)):
        assert made.columns == decode.COLUMNS and made.count() == 0


def test_native_fat_headers_equal_python(files):
    got = {r.path: [tuple(a) for a in r.a or []] for r in files.select("path", decode.fat_archs(F.col("content")).alias("a")).collect()}
    assert got == {n: [tuple(a) for a in macho.fat_archs(b or b"")] for n, b in FILES.items()}


@pytest.mark.parametrize("algo", ["md5", "git256", "ssdeep", "tlsh"])
def test_slices(files, algo):
    want = {(n, 0): digest_bytes(b, algo) for n, b in FILES.items() if b is not None}
    for n, b in FILES.items():
        for k, a in enumerate(macho.fat_archs(b or b"")):
            want[f"{n} ({a.name})", k + 1] = digest_bytes(macho.slice_bytes(b, a), algo, part=True)
    assert shown(decode.with_slices(files, algo)) == {k: d for k, d in want.items() if d is not None}


def test_out_of_range_slice_has_the_digest_of_nothing(files):
    assert shown(decode.with_slices(files, "md5"))["outside (i386)", 1] == hashlib.md5(b"").hexdigest()
    assert not any(p.startswith("outside (") for p, _ in shown(decode.with_slices(files, "ssdeep")))


def test_cdhashes(files):
    d = [hashlib.sha256(directory(b"%d" % i, 2)).hexdigest() for i in range(2)]
    got = shown(decode.cdhashes(files))
    assert {p: v for (p, _), v in got.items()} == {"signed (x86_64)": d[0], "signed (arm64)": d[1], "thin": d[1]}


def test_symhashes(files):
    got = {p: v for (p, _), v in shown(decode.symhashes(files)).items()}
    # Of the joined names.
    assert got == {"symbols (x86_64)": "3dab64a86cb9ed1fc560ff5d363a6b6d", "symbols (arm64)": hashlib.md5(b"").hexdigest()}
    assert shown(decode.symhashes(files, sort_symbols=False))["symbols (x86_64)", 1] == "80ea70bf26cf5fc918fdf92a1a7f228b"
    lines = shown(decode.symhashes(files, "sha1", separator="\n"))["symbols (x86_64)", 1]
    assert lines == hashlib.sha1(b"_free\n_malloc\n_printf").hexdigest()
    for algo in ("git", "git256", "cdhash"):
        assert decode.symhashes(files, algo).count() == 0
    assert decode.symhashes(files, "tlsh").count() == 0  # too short


def test_xar_tocs(files):
    # Of the table of contents.
    assert shown(decode.xar_tocs(files)) == {("archive", 0): "24b7eee218ca9bd4037760c7952b97ce47bf1079"}
    assert shown(decode.xar_tocs(files, "sha256")) == {("archive", 0): "f99250d25d522b8a6c085b1a3adb2933a86e1da83ef60fc00affbc23ec690cce"}
    assert decode.xar_tocs(files, "cdhash").count() == 0


def test_repeated_rows(files):
    assert decode.whole_files(files.union(files), "md5").count() == 2 * decode.whole_files(files, "md5").count()

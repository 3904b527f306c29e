import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from sievekit.formats import macho, xar
from sievekit.formats.build import ARM64, X86_64, directory, fat_file, signature_blob, signed_file, thin_file, with_symbols, xar_file
from sievekit.operators import decode

FAT = fat_file([(X86_64, 3, b"first"), (ARM64, 2, b"second!")])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("bits", [32, 64])
def test_thin_headers(order, bits):
    f = thin_file([(2, b"\1" * 16)], order=order, bits=bits, cpu=(7, 3))
    assert macho.kind(f) == "thin" and macho.thin_cpu(f) == (7, 3)
    assert macho.load_commands(f) == [(2, struct.pack(order + "II", 2, 24) + b"\1" * 16)]
    assert macho.kind(f[: 27 if bits == 32 else 31]) == "none"


def test_not_executables():
    for data in (b"", b"\xca\xfe\xba", b"hello", b"\xca\xfe\xba\xbe", b"\xca\xfe\xba\xbf" + FAT[4:]):
        assert macho.kind(data) == "none" and not macho.slices_of(data) and not macho.load_commands(data)
    assert macho.slices_of(None) == []


def test_fat_counts_and_slices():
    assert [a.name for a in macho.fat_archs(FAT)] == ["x86_64", "arm64e"]
    assert [macho.slice_bytes(FAT, a) for a in macho.fat_archs(FAT)] == [b"first", b"second!"]
    assert len(macho.fat_archs(b"\xbe\xba\xfe\xca" + FAT[4:])) == 2  # read alike
    count = lambda n: len(macho.fat_archs(b"\xca\xfe\xba\xbe" + struct.pack(">I", n) + b"\0" * 600))
    assert [count(n) for n in (0, 1, 24, 25)] == [0, 1, 24, 0]
    assert len(macho.fat_archs(FAT[:40])) == 1 and macho.fat_archs(FAT[:20]) == []
    outside = struct.pack(">IIiiIII", 0xCAFEBABE, 1, 7, 3, 20, 4000, 0)
    assert macho.slice_bytes(outside, macho.fat_archs(outside)[0]) == b""


def test_arch_names(spark):
    cases = [(7, 3, "i386"), (12, 0, "arm"), (18, 0, "ppc"), (X86_64, 3, "x86_64"), (ARM64, 0, "arm64"), (ARM64, 2, "arm64e"), (ARM64, -2147483646, "arm64e"), (0x01000012, 0, "ppc64"), (99, 0, "unknown"), (None, None, "unknown"), (ARM64, None, "arm64")]
    assert [macho.arch_name(a, b) for a, b, _ in cases] == [n for *_, n in cases]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a int, b int, n string")
    assert all(r.got == r.n for r in df.withColumn("got", decode.arch_name(F.col("a"), F.col("b"))).collect())


def test_load_commands_stop_early():
    f = thin_file([(1, b"abcd"), (2, b"efgh")])
    assert [c.cmd for c in macho.load_commands(f)] == [1, 2]
    assert [c.cmd for c in macho.load_commands(f[:-1])] == [1]
    small = bytearray(f)
    small[32 + 12 + 4 : 32 + 12 + 8] = struct.pack("<I", 7)
    assert [c.cmd for c in macho.load_commands(bytes(small))] == [1]
    less = bytearray(f)
    less[20:24] = struct.pack("<I", 12)
    assert [c.cmd for c in macho.load_commands(bytes(less))] == [1]


def test_symbols():
    entries = [(0x01, "_b"), (0x0F, "_defined"), (0x21, "_stab"), (0x11, "_private_external"), (0x01, "_a"), (0x01, "_a")]
    f = with_symbols(entries)
    assert macho.symbols(f) == entries
    assert macho.imported_names(f) == ["_b", "_private_external", "_a", "_a"]
    assert macho.imported_names(thin_file([])) is None
    assert macho.imported_names(with_symbols([])) == []
    assert macho.symbols(thin_file([(2, struct.pack("<IIII", 0, 100, 0, 0))])) == []  # reaches past the end
    assert macho.symbols(thin_file([(2, b"short")])) is None
    cut = with_symbols([(0x01, "_open_ended")])[:-1]
    assert macho.symbols(cut) == [(1, "_open_ended")]
    far = bytearray(f)
    far[56:60] = struct.pack("<I", 1 << 30)
    assert macho.symbols(bytes(far)) == entries[1:]
    odd = thin_file([(2, struct.pack("<IIII", 56, 1, 72, 4))], struct.pack("<IBBHQ", 0, 1, 0, 0, 0) + b"\xff\0")
    assert macho.symbols(odd) == [(1, "�")]


def test_symbols_of_32_bits_and_swapped_files():
    table = struct.pack("<IBBHI", 1, 1, 0, 0, 0) + struct.pack("<IBBHI", 4, 1, 0, 0, 0)
    f = thin_file([(2, struct.pack("<IIII", 52, 2, 76, 7))], table + b"\0_a\0_b\0" + b"\0" * 40, bits=32)
    assert [n for _, n in macho.symbols(f, strict_layout=True)] == ["_a", "_b"]
    assert macho.symbols(f) != macho.symbols(f, strict_layout=True)  # read as 64-bit entries
    swapped = thin_file([(2, struct.pack(">IIII", 56, 1, 72, 4))], struct.pack(">IBBHQ", 1, 1, 0, 0, 0) + b"\0_a\0", order=">")
    assert macho.symbols(swapped) == [] and [n for _, n in macho.symbols(swapped, strict_layout=True)] == ["_a"]


@pytest.mark.parametrize("kind,name", [(1, "sha1"), (2, "sha256"), (4, "sha384"), (3, None), (9, None)])
def test_code_directory_types(kind, name):
    blob = directory(b"x" * 50, kind)
    assert macho.code_directory_hash(signed_file(signature_blob([(0, blob)]))) == (name and hashlib.new(name, blob).hexdigest())


def test_code_directory_choice():
    one, two, three = directory(b"one", 1), directory(b"two", 2), directory(b"three", 2)
    of = lambda *d: macho.code_directory_hash(signed_file(signature_blob(list(d))))
    assert of((0, one), (0x1000, two)) == hashlib.sha256(two).hexdigest()
    assert of((0, two), (0x1004, three)) == hashlib.sha256(two).hexdigest()  # the first of equals
    assert of((0, one), (0x1005, two)) == hashlib.sha1(one).hexdigest()  # not a slot of directories
    assert of((0, one), (0x1000, directory(b"", 3))) is None  # the greatest type counts, known or not
    assert of() is None and of((5, one)) is None
    assert of((0, struct.pack(">II", 0xFADE0C02, 4000) + two[8:]), (0x1000, one)) == hashlib.sha1(one).hexdigest()
    assert of((0, b"\0\0\0\0" + two[4:])) is None


def test_signature_places():
    sig = signature_blob([(0, directory(b"x", 2))])
    good = signed_file(sig)
    place = lambda start, size: (0x1D, struct.pack("<II", start, size))
    skipping = thin_file([place(0, 10), place(50, 0), place(50, 1 << 30), (0x1D, b"abcd"), place(32 + 16 * 4 + 12, len(sig))], sig)
    assert macho.code_directory_hash(skipping) == macho.code_directory_hash(good) is not None
    assert macho.code_directory_hash(good[:-1]) is None
    assert macho.code_directories(b"short") == [] and macho.code_directories(b"\0" * 20) == []


def test_xar(spark):
    toc = b"fake-toc-data"
    packed = zlib.compress(toc)
    files = {
        "plain": xar_file(toc), "packed": xar_file(packed, len(toc)), "cut": xar_file(b"x" * 1000)[:100], "short": b"xar!" + b"\0" * 20, "other": b"rax!" + xar_file(toc)[4:],
        "small": xar_file(b"123456", 10), "limit": xar_file(packed, 4), "broken": xar_file(b"x" * 40, 100), "none": None, "empty": xar_file(b"", 0),
        "huge": b"xar!" + struct.pack(">HHQQI", 28, 1, 1 << 63, (1 << 64) - 1, 1) + toc, "early": xar_file(toc, header_size=4), "half": xar_file(zlib.compress(toc * 50)[:-20], 650),
    }
    df = spark.createDataFrame(list(files.items()), "name string, content binary")
    rows = {r.name: r for r in df.select("name", xar.header(F.col("content")).alias("h"), xar.toc(F.col("content")).alias("toc"), xar.inflated_toc(F.col("content")).alias("raw")).collect()}
    assert rows["plain"].h == (28, 1, 13, 13, 1) and bytes(rows["plain"].toc) == toc
    assert rows["huge"].h.toc_len == 1 << 63 and rows["huge"].h.toc_raw_len == (1 << 64) - 1 and rows["huge"].toc is None
    assert bytes(rows["packed"].raw) == toc and bytes(rows["limit"].raw) == toc[:4]
    assert {n for n, r in rows.items() if r.toc is None} == {"cut", "short", "other", "none", "huge"}
    assert {n for n, r in rows.items() if r.h is None} == {"short", "other", "none"}
    assert {n for n, r in rows.items() if r.raw is not None} - {"plain", "early"} == {"packed", "limit", "half"}  # those two may look like deflate
    assert bytes(rows["early"].toc) == xar_file(toc, header_size=4)[4:17] and bytes(rows["empty"].toc) == b""

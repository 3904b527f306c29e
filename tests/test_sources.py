import hashlib
import json
import os

import pytest

from sievekit import cli
from sievekit.config import DigestSpec
from sievekit.plans.pipeline import DigestQuery
from sievekit.sources.chunked import digest_paths
from sievekit.sources import filetree
from sievekit.sources.filetree import files, walk_errors


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    (root / "sub" / "deep").mkdir(parents=True)
    for name, data in {".hidden": b"h", "_under": b"u", "empty": b"", "a.txt": b"hello", "sub/b": b"b", "sub/deep/c": b"c" * (3 << 20)}.items():
        (root / name).write_bytes(data)
    os.symlink(root / "a.txt", root / "link")
    os.symlink(root / "sub", root / "folder_link")
    os.symlink("..", root / "sub" / "loop")
    os.symlink("nowhere", root / "broken")
    return root


def paths(df, root):
    return sorted(os.path.relpath(r.path, root) for r in df.collect())


PLAIN = sorted([".hidden", "_under", "empty", "a.txt", "sub/b", "sub/deep/c"])


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_walk(spark, tree, partitions):
    df = files(spark, str(tree), partitions=partitions)
    assert paths(df, tree) == PLAIN
    assert df.select("seq").distinct().count() == len(PLAIN)
    sizes = {os.path.basename(r.path): r.size for r in df.collect()}
    assert sizes["empty"] == 0 and sizes["c"] == 3 << 20


def test_follow_links_without_running_in_circles(spark, tree):
    want = sorted([*PLAIN, "link", "folder_link/b", "folder_link/deep/c"])
    # Through the linked folder the loop leads to the root once more, not further.
    got = paths(files(spark, str(tree), follow=True, partitions=2), tree)
    assert [p for p in got if "loop" not in p] == want and len(got) == len(set(got)) < 40
    assert any("contains itself" in r.error for r in walk_errors(spark, str(tree), follow=True).collect())


def test_roots(spark, tree):
    assert paths(files(spark, [str(tree / "sub"), str(tree / "sub" / "deep")]), tree).count("sub/deep/c") == 2
    assert paths(files(spark, [str(tree / "link")]), tree) == ["link"]
    assert paths(files(spark, [str(tree / "folder_link")]), tree) == []
    assert paths(files(spark, [str(tree / "folder_link")], follow=True), tree)[:1] == ["folder_link/b"]
    assert paths(files(spark, [str(tree / "missing"), str(tree / "a.txt")]), tree) == ["a.txt"]
    assert files(spark, [str(tree / "missing")]).count() == 0
    assert [r.path for r in walk_errors(spark, [str(tree / "missing")]).collect()] == [str(tree / "missing")]
    assert files(spark, str(tree / "sub") + "/").count() == 2


def test_unreadable(spark, tree):
    locked = tree / "locked"
    locked.mkdir()
    (locked / "x").write_bytes(b"x")
    locked.chmod(0)
    try:
        if not os.access(locked, os.R_OK):
            assert paths(files(spark, str(tree)), tree) == PLAIN
            assert any(r.path == str(locked) for r in walk_errors(spark, str(tree)).collect())
    finally:
        locked.chmod(0o700)


def test_content_and_digests(spark, tree):
    got = {os.path.relpath(r.path, tree): bytes(r.content) for r in files(spark, str(tree), content=True).collect()}
    assert got["a.txt"] == b"hello" and len(got) == len(PLAIN)
    digests = {os.path.relpath(r.path, tree): r.digest for r in digest_paths(files(spark, str(tree)), "md5").collect()}
    assert digests == {n: hashlib.md5(b).hexdigest() for n, b in got.items()}


def test_lost_files(spark, tree):
    df = spark.createDataFrame([(1, str(tree / "gone")), (2, str(tree / "a.txt")), (3, None)], "seq long, path string")
    assert [r.seq for r in digest_paths(df, "sha256").collect()] == [2]
    assert [r.path for r in digest_paths(df, "sha256", errors=True).collect()] == [str(tree / "gone")]


def test_query_over_files(spark, tree):
    q = DigestQuery(DigestSpec(algorithm="tlsh", sort=True, jobs=2))
    assert q.over_files(spark, str(tree)).count() == 0  # too short, or all alike
    lines = [r.line for r in DigestQuery(DigestSpec(algorithm="git", sort=True, slices=True)).lines_over_files(spark, [str(tree)]).collect()]
    assert [line.split("  ")[1] for line in lines] == [str(tree / n) for n in PLAIN]


def test_command_line(spark, tree, capsys):
    assert cli.main(["--algo", "SHA2", "--sort", "-j", "2", str(tree / "a.txt"), str(tree / "sub" / "b")]) == 0
    assert capsys.readouterr().out.splitlines() == [f"{hashlib.sha256(d).hexdigest()}  {tree / n}" for n, d in (("a.txt", b"hello"), ("sub/b", b"b"))]
    spec = cli.spec_of(cli.parser().parse_args(["-m", "a", "-m", "b", "-s", "0", "--no-sort-symbols", "--symhash", "-q", "-L", "--xar-toc", "--decompress"]))
    assert spec.targets == ("a", "b") and spec.score == 0 and not spec.sort_symbols and spec.mode == "symhash" and spec.follow and spec.decompress
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["-a", "crc"])


def test_only_containers_are_loaded(spark, tmp_path):
    """A plain file of 3 GiB isn't read; an archive of that size is too large for a row, which is an error."""
    for name, head in {"plain": b"text", "archive": b"xar!"}.items():
        with open(tmp_path / name, "wb") as f:
            f.write(head)
            f.truncate(3 << 30)
    toc = b"table"
    (tmp_path / "small").write_bytes(b"xar!" + (28).to_bytes(2, "big") + (1).to_bytes(2, "big") + len(toc).to_bytes(8, "big") * 2 + (1).to_bytes(4, "big") + toc)
    query = DigestQuery(DigestSpec(xar_toc=True))
    assert [(os.path.basename(r.path), r.digest) for r in query.over_files(spark, str(tmp_path)).collect()] == [("small", hashlib.sha1(toc).hexdigest())]
    assert [(os.path.basename(r.path), r.error) for r in query.errors_over_files(spark, str(tmp_path)).collect()] == [("archive", "too large")]
    for spec in (DigestSpec(algorithm="cdhash"), DigestSpec(symhash=True)):
        assert DigestQuery(spec).over_files(spark, str(tmp_path)).count() == DigestQuery(spec).errors_over_files(spark, str(tmp_path)).count() == 0


def test_slices_over_files_digest_whole_files_in_chunks(spark, tmp_path):
    one, two = b"a" * 100, b"b" * 50
    entry = lambda cpu, at, n: b"".join(v.to_bytes(4, "big") for v in (cpu, 3, at, n, 0))
    fat = b"\xca\xfe\xba\xbe" + (2).to_bytes(4, "big") + entry(0x01000007, 48, 100) + entry(0x0100000C, 148, 50) + one + two
    (tmp_path / "fat").write_bytes(fat)
    (tmp_path / "plain").write_bytes(b"x" * (5 << 20))
    got = {(os.path.basename(r.file_path), r.slice_idx): r.digest for r in DigestQuery(DigestSpec(slices=True)).over_files(spark, str(tmp_path)).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("fat", 0): sha(fat), ("fat", 1): sha(one), ("fat", 2): sha(two), ("plain", 0): sha(b"x" * (5 << 20))}


def test_files_that_go_away_are_errors(spark, tree, monkeypatch, capsys):
    reader = filetree.TreeReader({"roots": json.dumps([str(tree)]), "partitions": "2"})
    parts = reader.partitions()
    os.remove(tree / "a.txt")
    seen = [r[1] for p in parts for r in reader.read(p)]
    assert sorted(os.path.relpath(p, tree) for p in seen) == sorted(set(PLAIN) - {"a.txt"})
    reader.want_errors = True
    assert str(tree / "a.txt") in {r[0] for p in parts for r in reader.read(p)}
    locked = tree / "sub" / "b"
    locked.chmod(0)
    lines = DigestQuery(DigestSpec(algorithm="md5")).lines_over_files(spark, [str(tree), str(tree / "missing")], errors=True).collect()
    errors = {r.path for r in lines if r.error}
    assert str(tree / "missing") in errors and (os.access(locked, os.R_OK) or str(locked) in errors)
    assert sum(r.line is not None for r in lines) >= len(PLAIN) - 2


def test_folders_of_many_entries_are_shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(filetree, "MANY_ENTRIES", 20)
    for k in range(50):
        (tmp_path / str(k)).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "y").write_bytes(b"y")
    reader = filetree.TreeReader({"roots": json.dumps([str(tmp_path)]), "partitions": "4"})
    parts = reader.partitions()
    assert sum(len(p.start) for p in parts) == 4
    read = [[r[1] for r in reader.read(p)] for p in parts]
    assert sorted(p for part in read for p in part) == sorted([*(str(tmp_path / str(k)) for k in range(50)), str(tmp_path / "sub" / "y")])
    assert min(map(len, read)) > 2


def test_targets_table_over_files(spark, tree):
    targets = spark.createDataFrame([(hashlib.md5(b"hello").hexdigest().upper(),), (None,)], "target string")
    query = DigestQuery(DigestSpec(algorithm="md5"))
    assert [os.path.basename(r.path) for r in query.over_files(spark, str(tree), targets).collect()] == ["a.txt"]
    assert [r.line for r in query.lines_over_files(spark, str(tree), targets).collect()] == [hashlib.md5(b"hello").hexdigest() + "  " + str(tree / "a.txt")]


def test_file_url(tree):
    assert filetree.file_url("/a b/ü") == "file:///a%20b/%C3%BC" and filetree.file_url("/x/").endswith("/x/") and filetree.file_url("/") == "file:///"
    assert filetree.file_url("x") == "file://" + os.path.abspath("x")

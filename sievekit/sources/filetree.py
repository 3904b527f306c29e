"""File trees as a Spark source: ``spark.read.format("filetree")``.

Options: ``roots`` (JSON list of paths, default ``["."]``; or ``load(path)`` for one), ``follow`` (symbolic links, default
false), ``content`` (``true`` adds the bytes, and ``error`` for a file that can't be read or is too large for a row), ``magic`` (JSON list of
first bytes in hex; with ``content`` only files that begin so come out, and of others no more than those bytes are read),
``partitions`` (parallel walks, default 8), ``errors`` (``true``: rows for what the walk couldn't read instead of files).

Only regular files come out, with dotfiles and empty ones.  Without ``follow`` links are left out, but a root that is a link to
a file comes out.  A directory that contains itself through links isn't entered again; broken links, unreadable and missing
paths are skipped.  Roots aren't deduplicated.  The order is undefined; sort by ``path`` where it matters.
"""

from __future__ import annotations

import itertools
import json
import os
import stat
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_FIELDS = "seq long, path string, size long, device long, inode long"
_SHIFT = 40  # a walk has less than 2 ** 40 files
MOST_BYTES = (1 << 31) - (1 << 20)  # of content in a row
MANY_ENTRIES = 10_000  # of a folder that several tasks share


class Walk:
    """Walks below directories; ``errors`` collects what couldn't be read."""

    def __init__(self, follow: bool) -> None:
        self.follow, self.errors = follow, []

    def look(self, path: str) -> os.stat_result | None:
        try:
            return os.stat(path) if self.follow else os.lstat(path)
        except OSError as e:
            self.errors.append((path, e.strerror or str(e)))
            return None

    def entries(self, folder: str) -> list[str]:
        try:
            return [join(folder, e) for e in sorted(os.listdir(folder))]
        except OSError as e:
            self.errors.append((folder, e.strerror or str(e)))
            return []

    def step(self, path: str, above: frozenset) -> tuple[str, os.stat_result | None, frozenset]:
        """``file``, ``folder`` or ``none``; of a folder with those above it and itself."""
        s = self.look(path)
        if s is not None and stat.S_ISREG(s.st_mode):
            return "file", s, above
        if s is not None and stat.S_ISDIR(s.st_mode):
            key = (s.st_dev, s.st_ino)
            if key in above:
                self.errors.append((path, "the folder contains itself"))
                return "none", s, above
            return "folder", s, above | {key}
        return "none", s, above

    def files(self, start: list[tuple[str, frozenset]]) -> Iterator[tuple[str, os.stat_result]]:
        todo = list(reversed(start))
        while todo:
            path, above = todo.pop()
            what, s, inside = self.step(path, above)
            if what == "file":
                yield path, s
            elif what == "folder":
                todo.extend((p, inside) for p in reversed(self.entries(path)))


def join(folder: str, name: str) -> str:
    return folder + name if folder.endswith("/") else f"{folder}/{name}"


def root_entries(roots: list[str], follow: bool) -> list[tuple[str, frozenset, bool]]:
    """Path, folders above, and whether it is a file to emit as it is.  Roots that don't exist are left out."""
    out = []
    for r in roots:
        if os.path.isdir(r):
            out.append((r, frozenset(), False))
        elif os.path.isfile(r):
            out.append((r, frozenset(), True))
    return out


class TreePartition(InputPartition):
    """``start``: paths with the folders above them, whether they are files to emit as they are, and, of a folder that several tasks
    share, which part of its entries (by hash of the name) and of how many."""

    def __init__(self, number: int, start: list[tuple[str, frozenset, bool, tuple[int, int]]], errors: list[tuple[str, str]] = ()) -> None:
        self.number, self.start, self.errors = number, start, list(errors)


def first_bytes(path: str, magic: frozenset[bytes]) -> bool:
    """Whether a file begins with one of those."""
    with open(path, "rb") as f:
        return f.read(max(map(len, magic))).startswith(tuple(magic))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        on = lambda name: str(options.get(name, "false")).lower() == "true"
        self.roots = json.loads(options["roots"]) if "roots" in options else [options.get("path", ".")]
        self.follow, self.content, self.want_errors = on("follow"), on("content"), on("errors")
        self.magic = frozenset(map(bytes.fromhex, json.loads(options.get("magic", "[]"))))
        self.count = max(1, int(options.get("partitions", "8")))

    def partitions(self) -> list[TreePartition]:
        """Folders are opened from the top until there are some for each partition; the rest is walked by the tasks.  A folder of very
        many entries isn't listed here: all tasks share it."""
        walk, whole = Walk(self.follow), (0, 1)
        todo = [(*r, whole) for r in root_entries(self.roots, self.follow)]
        walk.errors += [(r, "no such file or directory") for r in self.roots if not os.path.exists(r)]
        for _ in range(8):
            if len(todo) >= 4 * self.count or not any(not done and share == whole for _, _, done, share in todo):
                break
            opened = []
            for path, above, done, share in todo:
                what, _, inside = ("done", None, above) if done or share != whole else walk.step(path, above)
                if what == "done":
                    opened.append((path, above, done, share))
                elif what == "file":
                    opened.append((path, above, True, whole))
                elif what == "folder" and self.count > 1 and has_many(path):
                    opened += [(path, above, False, (k, self.count)) for k in range(self.count)]
                elif what == "folder":
                    opened += [(p, inside, False, whole) for p in walk.entries(path)]
            todo = opened
        parts = [todo[k :: self.count] for k in range(self.count)]
        return [TreePartition(k, p, walk.errors if not k else ()) for k, p in enumerate(parts) if p or not k]

    def _found(self, walk: Walk, partition: TreePartition) -> Iterator[tuple[str, os.stat_result]]:
        for path, above, known, (part, parts) in partition.start:
            if known:
                try:
                    yield path, os.stat(path)
                except OSError as e:  # it went away since the plan was made
                    walk.errors.append((path, e.strerror or str(e)))
            elif parts == 1:
                yield from walk.files([(path, above)])
            else:
                what, _, inside = walk.step(path, above)
                own = [p for p in walk.entries(path) if zlib.crc32(os.fsencode(os.path.basename(p))) % parts == part] if what == "folder" else []
                yield from walk.files([(p, inside) for p in own])

    def read(self, partition: TreePartition):
        walk, first = Walk(self.follow), partition.number << _SHIFT
        if self.want_errors:
            for _ in self._found(walk, partition):
                pass
            yield from dict.fromkeys([*partition.errors, *walk.errors])
            return
        for n, (p, s) in enumerate(self._found(walk, partition), first):
            row = (n, p, s.st_size, s.st_dev, s.st_ino)
            if not self.content:
                yield row
                continue
            try:
                if self.magic and not first_bytes(p, self.magic):
                    continue
                if s.st_size > MOST_BYTES:
                    yield (*row, None, "too large")
                    continue
                with open(p, "rb") as f:
                    yield (*row, f.read(), None)
            except OSError as e:
                yield (*row, None, e.strerror or str(e))


def has_many(folder: str) -> bool:
    """Whether a folder has more entries than one task should list; counts no further than that."""
    try:
        with os.scandir(folder) as entries:
            return sum(1 for _ in itertools.islice(entries, MANY_ENTRIES + 1)) > MANY_ENTRIES
    except OSError:
        return False


def file_url(path: str) -> str:
    """``path`` as a file URL, absolute, with what URLs don't allow escaped; the slash at the end of a folder's path stays."""
    from urllib.parse import quote

    whole = os.path.abspath(path)
    return "file://" + quote(os.fsencode(whole + "/" if path.endswith("/") and whole != "/" else whole))


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        on = lambda name: str(self.options.get(name, "false")).lower() == "true"
        return "path string, error string" if on("errors") else _FIELDS + (", content binary, error string" if on("content") else "")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def files(spark: SparkSession, roots: list[str] | str = ".", follow: bool = False, content: bool = False, partitions: int = 8, magic: list[bytes] | None = None) -> DataFrame:
    """The files below ``roots``; with ``content`` their bytes, of those only that begin with one of ``magic`` if it is given."""
    read = _read(spark, roots, follow, partitions).option("content", str(content).lower())
    return read.option("magic", json.dumps([m.hex() for m in magic or []])).load()


def walk_errors(spark: SparkSession, roots: list[str] | str = ".", follow: bool = False, partitions: int = 8) -> DataFrame:
    """``path``, ``error`` of what a walk skips."""
    return _read(spark, roots, follow, partitions).option("errors", "true").load()


def _read(spark: SparkSession, roots: list[str] | str, follow: bool, partitions: int):
    spark.dataSource.register(FileTree)
    listed = [roots] if isinstance(roots, str) else list(roots)
    return spark.read.format("filetree").option("roots", json.dumps(listed)).option("follow", str(follow).lower()).option("partitions", str(partitions))

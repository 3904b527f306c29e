"""Deduplicating new batches against all accepted digests, with an index on disk that grows by appending.

The index is a folder of three tables, each in buckets that are folders of their own, and a manifest with one row a batch, written
last: what isn't in it doesn't count, so a batch that fails halfway leaves no trace, and an index can be opened again from its
folder alone.  A batch is sent to the buckets that it asks; the task of a bucket reads its files row group by row group where they
lie.  So accepted digests are never shuffled, and buckets that aren't asked aren't read.

``digests``: accepted digests by hash.  ``segments``: the segments of accepted ssdeep digests, a fixed number for each length of signature:
six characters at every second place, with place and length.  Whatever scores above 0 has seven characters in a row in
common with a digest, and two segments begin in each such window, one of them at an even place; so a batch asks for its
substrings of six characters, and verifies the bounded edit distance of what it finds.  ``chunks``: accepted tlsh digests by
sixteenths of their length byte; they have one length, so their segments are the chunks at fixed positions, probed with the errors that
the limit allows.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions import ctph, tlsh
from sievekit.llm import hamming
from sievekit.session import file_system, shared_folder

STORED_STEP, ASKED_STEP = 2, 1
NEW, NEAR, EQUAL = "new", "near", "equal"
BUCKETS = 16
PART_ROWS = {"digests": 4_000_000, "segments": 4_000_000, "chunks": hamming.UNIT_ROWS}  # stored rows that one task goes through
ROW_GROUP = 16 << 20
LENGTHS = 16  # buckets of tlsh digests, each a range of the length byte
PAIRS_AT_ONCE = 1 << 20
_JUDGED = "batch int, space int, algo string, plain string, n long, id long, status string"
_TABLES = {
    "digests": "space int, algo string, plain string, id long, bucket int, commit string",
    "segments": "key long, length int, at int, id long, bucket int, commit string",
    "chunks": "sig string, id long, bucket int, commit string",
}
_MANIFEST = "entry string"  # JSON


class Stored:
    """The files of the tables, read in the tasks; ``commits``: those that count."""

    def __init__(self, folder: str, commits: list[str]) -> None:
        self.folder, self.commits = folder, frozenset(commits)

    def read(self, name: str, bucket: int, part: int, parts: int, columns: list[str]) -> Iterator[pa.Table]:
        """The row groups of one of the ``parts`` of a bucket."""
        from pyarrow import fs, parquet

        system, path = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(f"{path}/{name}/bucket={bucket}", allow_not_found=True, recursive=True))
        number = 0
        for f in sorted(x.path for x in found if x.is_file and x.path.endswith(".parquet")):
            if re.search(r"/commit=(\w+)/", f)[1] not in self.commits:
                continue
            with system.open_input_file(f) as file:
                groups = parquet.ParquetFile(file)
                for g in range(groups.num_row_groups):
                    if number % parts == part:
                        yield groups.read_row_group(g, columns)
                    number += 1


def _runs(batches, columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows sorted by ``columns``, those of each value together."""
    held, current = [], None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for low, high in zip(edges, edges[1:]):
            now = tuple(key[low].tolist())
            if held and now != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = now
            held.append(b.slice(low, high - low))
    if held:
        yield current, pa.Table.from_batches(held)


def _matches(asked: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``asked`` (sorted) and in ``stored`` of equal keys, a bounded number of pairs at a time."""
    low, high = np.searchsorted(asked, stored, "left"), np.searchsorted(asked, stored, "right")
    some = np.flatnonzero(high > low)
    n = (high - low)[some]
    ends = np.cumsum(n)
    begin = 0
    while begin < len(some):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + PAIRS_AT_ONCE, "right")))
        part = slice(begin, end)
        yield hamming._expand(low[some[part]], n[part]), np.repeat(some[part], n[part])
        begin = end


def _segments(step: int):
    """For ``mapInArrow`` over ``id``, ``space``, ``plain``: ``key``, ``length``, ``at``, ``id`` of each segment."""

    def run(batches):
        for b in batches:
            s = ctph.segment_keys(b.column("plain").to_pylist(), b.column("space").to_numpy(zero_copy_only=False).astype(np.int64), step)
            ids = b.column("id").to_numpy(zero_copy_only=False)[s["row"]]
            yield pa.RecordBatch.from_arrays([pa.array(s["key"]), pa.array(s["length"]), pa.array(s["at"]), pa.array(ids)], ["key", "length", "at", "id"])

    return run


def _find_segments(stored: Stored, parts: dict[int, int], least: int):
    """Pairs of an asking id and the id of a stored digest that share a segment, and whose lengths allow the score."""
    share = math.ceil(64 * (101 - least) / 100)

    def run(batches):
        for (bucket, part), t in _runs(batches, ["bucket", "part"]):
            t = t.sort_by("key")
            key, m, ids = t["key"].to_numpy(), t["length"].to_numpy(), t["id"].to_numpy()
            for rows in stored.read("segments", bucket, part, parts.get(bucket, 1), ["key", "length", "id"]):
                n, want = rows["length"].to_numpy(), rows["id"].to_numpy()
                for i, j in _matches(key, rows["key"].to_numpy()):
                    # The least edit distance of two lengths is their difference; beyond the bound the score is too low.
                    fits = np.abs(m[i] - n[j]) * 64 < (m[i] + n[j]) * share
                    both = np.unique(np.stack([ids[i[fits]], want[j[fits]]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["id", "want"])

    return run


def _find_digests(stored: Stored, parts: dict[int, int]):
    """The stored texts of the ids that are asked for."""

    def run(batches):
        for (bucket, part), t in _runs(batches, ["bucket", "part"]):
            asked = np.unique(np.stack([t["key"].to_numpy(), t["id"].to_numpy()]), axis=1)
            for rows in stored.read("digests", bucket, part, parts.get(bucket, 1), ["id", "plain"]):
                for i, j in _matches(asked[0], rows["id"].to_numpy()):
                    yield pa.RecordBatch.from_arrays([pa.array(asked[1][i]), rows["plain"].take(pa.array(j)).combine_chunks().cast(pa.string())], ["id", "plain"])

    return run


def _find_chunks(stored: Stored, parts: dict[int, int], limit: int):
    """The asking ids that are near to a stored tlsh digest of the bucket."""

    def gathered(tables: Iterator[pa.Table]) -> Iterator[np.ndarray]:
        """Parsed digests, a bounded number at a time."""
        held, n = [], 0
        for t in tables:
            for b in t.to_batches(max_chunksize=hamming.UNIT_ROWS):
                held.append(tlsh.parse(b.column("sig").to_pylist())[0])
                n += b.num_rows
                if n >= hamming.UNIT_ROWS:
                    yield np.concatenate(held)
                    held, n = [], 0
        if held:
            yield np.concatenate(held)

    def run(batches):
        for (bucket, part), t in _runs(batches, ["bucket", "part"]):
            left, ids = tlsh.parse(t["sig"].to_pylist())[0], t["id"].to_numpy()
            for right in gathered(stored.read("chunks", bucket, part, parts.get(bucket, 1), ["sig"])):
                i, _, _ = hamming.near_in_memory(left, right, limit)
                near = np.unique(i)  # those that equal a stored one too; equal goes before near
                yield pa.RecordBatch.from_arrays([pa.array(ids[near])], ["id"])
                left, ids = np.delete(left, near, axis=0), np.delete(ids, near)

    return run


def _judge(batch: int | None, least: int):
    """For ``mapInArrow`` over rows sorted by ``id`` and ``kind`` (0 the digest, 1 a stored text, 2 near to one): the digest with its status."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        ids, kind, plain = t["id"].to_numpy(), t["kind"].to_numpy(), t["plain"].to_pylist()
        first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1) != 0)
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids))))
        rank = np.where(kind == 2, 1, 0)
        rows = np.flatnonzero(kind == 1)
        x, y = [plain[first[run[k]]] for k in rows], [plain[k] for k in rows]
        rank[rows] = [2 if p == q else 0 for p, q in zip(x, y)]
        other = np.flatnonzero(rank[rows] == 0)
        rank[rows[other]] = ctph.scores([x[k] for k in other], [y[k] for k in other]) >= least
        best = np.zeros(len(first), dtype=np.int64)
        np.maximum.at(best, run, rank)  # equal goes before near, near before new
        out = t.take(pa.array(first)).select(["space", "algo", "plain", "n", "id"])
        status = pa.array([NEW, NEAR, EQUAL], pa.string()).take(pa.array(best))
        return out.add_column(0, "batch", pa.array([batch] * len(first), pa.int32())).append_column("status", status).combine_chunks().to_batches()[0]

    def run(batches):
        held = None  # the last digest, whose rows may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            ids = t["id"].to_numpy()
            last = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if ids[0] != ids[-1] else 0
            if last:
                yield judged(t.slice(0, last))
            held = t.slice(last)
        if held is not None:
            yield judged(held)

    return run


class SegmentIndex:
    """Accepted digests of several spaces (numbers that say what is compared with what), on disk; ``folder`` may hold an index already.

    ``least``: smallest ssdeep score, ``limit``: greatest tlsh distance that count as near; other algorithms: equal only.  ``buckets`` (of
    a new index): with many, a batch reads less and goes to more tasks.  Tasks read the folder by themselves: a path, or a
    URI of a file system that Arrow knows (file, hdfs, s3, gs).
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, least: int = 40, limit: int = 40, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.least, self.limit, self.buckets = spark, folder or shared_folder(spark), least, limit, buckets
        self.commits: list[str] = []
        self.judged_at: list[str] = []
        self.stored: dict[str, dict[int, int]] = {name: {} for name in _TABLES}  # rows of each bucket
        try:
            known = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest").collect()  # one row a batch
        except AnalysisException:
            return  # a new one
        for r in sorted((json.loads(r["entry"]) for r in known), key=lambda r: r["number"]):
            self.buckets = r["buckets"]
            self._count_in(r["commit"], r["path"], r["counts"])

    def _count_in(self, commit: str, path: str, counts: list[tuple[str, int, int]]) -> None:
        self.commits.append(commit)
        self.judged_at.append(path)
        for name, bucket, n in counts:
            self.stored[name][bucket] = self.stored[name].get(bucket, 0) + n

    def _append(self, name: str, rows: DataFrame, commit: str) -> list[tuple[str, int, int]]:
        """Appends to a table; the rows written to each bucket."""
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        rows = rows.withColumn("commit", F.lit(commit)).select(*columns)
        rows.hint("rebalance", "bucket").write.mode("append").option("parquet.block.size", ROW_GROUP).partitionBy("bucket", "commit").parquet(f"{self.folder}/{name}")
        at = f"{self.folder}/{name}"
        try:  # counted from the files' metadata
            new = self.spark.read.schema(_TABLES[name]).option("basePath", at).parquet(f"{at}/bucket=*/commit={commit}")
        except AnalysisException:
            return []  # there was nothing to append
        return [(name, r["bucket"], r["n"]) for r in new.groupBy("bucket").agg(F.count("*").alias("n")).collect()]  # a row a bucket

    def accepted(self) -> DataFrame:
        """All accepted digests: ``space``, ``algo``, ``plain``, ``id``."""
        if not self.stored["digests"]:
            return self.spark.createDataFrame([], _TABLES["digests"]).drop("bucket", "commit")
        rows = self.spark.read.schema(_TABLES["digests"]).parquet(f"{self.folder}/digests")
        return rows.where(F.col("commit").isin(self.commits)).drop("bucket", "commit")

    def judged(self) -> DataFrame:
        """The distinct digests of all batches so far: ``batch``, ``space``, ``algo``, ``plain``, ``n`` rows, ``id``, ``status``."""
        paths = [f"{self.folder}/{p}" for p in self.judged_at]
        return self.spark.read.schema(_JUDGED).parquet(*paths) if paths else self.spark.createDataFrame([], _JUDGED)

    def _bucket(self, of: Column) -> Column:
        return F.pmod(of, F.lit(self.buckets)).cast("int")

    @staticmethod
    def _length_bucket(k: int) -> Column:
        """The bucket of the cell of lengths ``k`` cells on, in the digest's space."""
        cell = F.pmod(F.col("own") + k, F.lit(hamming.CELLS))
        return (F.col("space") * LENGTHS + F.floor(cell / (hamming.CELLS // LENGTHS))).cast("int")

    def add(self, rows: DataFrame, batch: int | None, compare: bool = True) -> DataFrame:
        """Splits a batch (``space`` int, ``algo``, ``plain``) against what was accepted before it, and appends what is new.

        Result: its distinct digests with ``n`` rows and ``status`` new, equal or near, as in ``judged``.  Digests of one batch aren't
        compared with each other.  Null digests and spaces are left out; an empty batch gives no rows and accepts nothing.  Without
        ``compare`` all are accepted.  Digests are told apart by 64-bit hashes.
        """
        commit = f"c{uuid.uuid4().hex}"  # as text, for numbers are compiled into the plans
        path = f"judged-{commit}"
        # One row a digest, counted on the map side first: a digest that fills the batch is one row a map task.
        fresh = rows.where(F.col("plain").isNotNull() & F.col("space").isNotNull()).groupBy("space", "algo", "plain").agg(F.count("*").alias("n"))
        fresh = fresh.withColumn("id", F.xxhash64("space", "plain"))
        if compare and self.commits:
            fresh.write.parquet(f"{self.folder}/fresh-{commit}")
            fresh = self.spark.read.schema("space int, algo string, plain string, n long, id long").parquet(f"{self.folder}/fresh-{commit}")
            own = fresh.select("id", F.lit(0).alias("kind"), "space", "algo", "plain", "n")
            for kind, found in self._found(fresh):
                own = own.unionByName(found.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
            own.repartition("id").sortWithinPartitions("id", "kind").mapInArrow(_judge(batch, self.least), _JUDGED).write.parquet(f"{self.folder}/{path}")
        else:
            fresh.select(F.lit(batch).cast("int").alias("batch"), "space", "algo", "plain", "n", "id", F.lit(NEW).alias("status")).write.parquet(f"{self.folder}/{path}")
        judged = self.spark.read.schema(_JUDGED).parquet(f"{self.folder}/{path}")
        new = judged.where(F.col("status") == NEW)
        parts = {
            "digests": new.withColumn("bucket", self._bucket(F.col("id"))),
            "segments": self._asked(new, STORED_STEP).withColumn("bucket", self._bucket(F.col("key"))),
            "chunks": hamming.tlsh_rows(new.where(F.col("algo") == "tlsh")).withColumn("bucket", self._length_bucket(0)),
        }
        with ThreadPoolExecutor(len(parts)) as pool:
            counts = [c for done in [pool.submit(self._append, name, df, commit) for name, df in parts.items()] for c in done.result()]
        entry = json.dumps({"number": len(self.commits), "commit": commit, "buckets": self.buckets, "counts": counts, "path": path})
        self.spark.range(0, 1, 1, 1).select(F.lit(entry).alias("entry")).write.mode("append").parquet(f"{self.folder}/manifest")
        self._count_in(commit, path, counts)
        return judged

    @staticmethod
    def _asked(df: DataFrame, step: int) -> DataFrame:
        """Segments of the ssdeep digests."""
        return df.where(F.col("algo") == "ssdeep").select("id", "space", "plain").mapInArrow(_segments(step), "key long, length int, at int, id long")

    def _asking(self, name: str, rows: DataFrame, run: Callable, schema: str) -> DataFrame:
        """``rows`` (with ``bucket``) go to the task of their bucket, or to those of all its parts if more is stored there than a task takes."""
        parts = {b: math.ceil(n / PART_ROWS[name]) for b, n in self.stored[name].items() if n > PART_ROWS[name]}
        if parts:
            many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in parts.items() for x in kv)), F.col("bucket")), F.lit(1))
            rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), many - 1)))
        else:
            rows = rows.withColumn("part", F.lit(0))
        key = ["bucket", "part"]
        return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run(Stored(self.folder, self.commits), parts), schema)

    def _found(self, fresh: DataFrame) -> list[tuple[int, DataFrame]]:
        """Kind and rows of what a batch meets: ``id``, ``plain`` of stored digests that may equal or be near to it (1), ``id`` of those near to one (2)."""
        wanted = fresh.select("id", F.col("id").alias("key"), self._bucket(F.col("id")).alias("bucket"))
        if self.stored["segments"]:
            asked = self._asked(fresh, ASKED_STEP).select("key", "length", "id", self._bucket(F.col("key")).alias("bucket"))
            pairs = self._asking("segments", asked, lambda s, parts: _find_segments(s, parts, self.least), "id long, want long")
            wanted = wanted.unionByName(pairs.select("id", F.col("want").alias("key"), self._bucket(F.col("want")).alias("bucket")))
        found = [(1, self._asking("digests", wanted, _find_digests, "id long, plain string"))]
        if self.stored["chunks"]:
            tlsh_rows = hamming.tlsh_rows(fresh.where(F.col("algo") == "tlsh"))
            # Lengths more than three apart rule a pair out, so it is in the cell or in a next one, mostly in the same bucket.
            around = F.explode(F.array_distinct(F.array(*map(self._length_bucket, (-1, 0, 1)))))
            asked = tlsh_rows.select("id", "sig", around.alias("bucket")).where(F.col("bucket").isin(list(self.stored["chunks"])))
            found.append((2, self._asking("chunks", asked, lambda s, parts: _find_chunks(s, parts, self.limit), "id long")))
        return found

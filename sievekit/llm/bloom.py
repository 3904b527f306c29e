"""Has this key been seen before?  Blocked Bloom filters over hash-partitioned keys."""

from __future__ import annotations

import json
import math
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.session import file_system

BLOCK_BITS = 512
KEYS_A_BUCKET = 500_000
GATHERED_ROWS = 100_000
KNOWN, ROW, ABSENT = 0, 1, 2
_SCHEMA = "ord long, h long, kind int, decided boolean"
_OUT = "ord long, kind int, seen boolean"


@lru_cache
def shape(rate: float) -> tuple[int, int]:
    """Bits a key and bits set a key of the smallest blocked filter with at most that rate of false positives."""
    loads = np.arange(0, 400)
    log_fact = np.cumsum(np.log(np.maximum(loads, 1)))
    for bits in range(8, 129, 2):
        mean = BLOCK_BITS / bits
        weight = np.exp(loads * math.log(mean) - mean - log_fact)
        for k in range(3, 15):
            if float((weight * (1 - (1 - 1 / BLOCK_BITS) ** (k * loads)) ** k).sum()) <= rate:
                return bits, k
    raise ValueError(f"rate {rate} is out of reach")


class BlockedBloom:
    """A Bloom filter whose bits of a key all lie in one 512-bit block (one cache line)."""

    def __init__(self, keys: int, rate: float) -> None:
        bits, self.k = shape(rate)
        self.blocks = max(1, math.ceil(keys * bits / BLOCK_BITS))
        self.words = np.zeros(self.blocks * 8, dtype=np.uint64)

    def _places(self, h: np.ndarray):
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)) * np.uint64(8)
        for j in range(self.k):
            if j % 7 == 0:  # seven 9-bit places come out of one mixed word
                x = h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(31)
            at = x >> np.uint64(9 * (j % 7)) & np.uint64(511)
            yield (block + (at >> np.uint64(6))).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def query(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        for word, bit in self._places(h):
            out &= (self.words[word] & bit) != 0
        return out

    def insert(self, h: np.ndarray) -> None:
        for word, bit in self._places(h):
            np.bitwise_or.at(self.words, word, bit)


def _first(h: np.ndarray) -> np.ndarray:
    """Which positions hold the first occurrence of their value."""
    out = np.zeros(len(h), dtype=bool)
    out[np.unique(h, return_index=True)[1]] = True
    return out


def _gathered(batches, rows: int):
    """Batches put together up to a bounded number of rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _repeats(batches):
    """Marks rows whose key stands in an earlier row of the same bounded block of rows: however
    often a key occurs, one row a block is left for the filters."""
    for t in _gathered(batches, GATHERED_ROWS):
        kind, order, h = (t[c].to_numpy() for c in ("kind", "ord", "h"))
        at = np.lexsort((order, kind))
        decided = np.zeros(len(h), dtype=bool)
        decided[at] = ~_first(h[at])
        decided &= kind != ABSENT
        yield from t.append_column("decided", pa.array(decided)).to_batches()


def _filters(keys: int, rate: float):
    def run(batches):
        current, bloom = None, None
        for b in batches:
            bucket, kind, order = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "kind", "ord"))
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            seen = np.ones(b.num_rows, dtype=bool)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for low, high in zip(edges, edges[1:]):
                if low == high or bucket[low] < 0:  # decided already
                    continue
                if bucket[low] != current:
                    current, bloom = bucket[low], BlockedBloom(keys, rate)
                part = slice(low, high)
                stored = kind[part] != ABSENT
                first = _first(h[part]) | ~stored
                answer = ~first
                answer[first] = bloom.query(h[part][first])
                bloom.insert(h[part][first & stored & ~answer])
                seen[part] = answer
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(kind), pa.array(seen)], ["ord", "kind", "seen"])

    return run


def seen_before(df: DataFrame, key: str, order: str, known: DataFrame | None = None, known_key: str | None = None, rate: float = 1e-6, absent: int = 0, keys_a_bucket: int = KEYS_A_BUCKET) -> DataFrame:
    """Whether the key of each row occurred in a row of smaller ``order`` or in ``known``.

    Keys are hashed to buckets; each bucket is read in order through a blocked Bloom filter: query, then insert.  A
    filter has room for ``keys_a_bucket`` keys on average, so memory doesn't grow with the input, only the number of
    buckets.  Rows that repeat a key within a block of rows read together are decided before the shuffle, so a
    hot key doesn't make a hot bucket.  A wrong answer is always a false "seen", at most at ``rate`` for new keys.
    ``absent`` keys that are surely not there are asked at the end, to measure that rate.

    Result: ``ord``, ``kind`` (0 known, 1 row, 2 absent key), ``seen``.  Rows without a key are left out; of rows with
    equal order one counts as the earlier; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull()).select(F.col(order).cast("long").alias("ord"), F.xxhash64(key).alias("h"), F.lit(ROW).alias("kind"))
    if known is not None:
        k = known_key or key
        rows = rows.unionByName(known.where(F.col(k).isNotNull()).select(F.lit(-1).cast("long").alias("ord"), F.xxhash64(k).alias("h"), F.lit(KNOWN).alias("kind")))
    keys = df.count() + (known.count() if known is not None else 0)  # no less than there are distinct ones; of a table it is in the metadata
    if absent:
        rows = rows.unionByName(spark.range(absent).select(F.col("id").alias("ord"), F.xxhash64(F.concat(F.lit("absent key "), F.col("id"))).alias("h"), F.lit(ABSENT).alias("kind")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, math.ceil(keys / keys_a_bucket))
    room = math.ceil(1.1 * keys / buckets + 6 * math.sqrt(keys / buckets + 1))
    bucket = F.when(F.col("decided"), F.lit(-1)).otherwise(F.pmod("h", F.lit(buckets)).cast("int"))
    return (
        rows.mapInArrow(_repeats, _SCHEMA)
        .withColumn("bucket", bucket)
        .repartition(min(buckets, 20 * parts), F.when(F.col("decided"), F.pmod("ord", F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
        .sortWithinPartitions("bucket", "kind", "ord")
        .mapInArrow(_filters(room, rate), _OUT)
    )


class GrowingBloom:
    """Blocked filters of doubling size and falling rate, whose rates add up to at most ``rate`` however many keys come."""

    def __init__(self, keys: int, rate: float) -> None:
        self.keys, self.rate, self.filters, self.left = keys, rate, [], 0

    def query(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=bool)
        for f in self.filters:
            out |= f.query(h)
        return out

    def insert(self, h: np.ndarray) -> None:
        """New keys, each once."""
        while len(h):
            if not self.left:
                k = len(self.filters)
                self.left = self.keys << k
                self.filters.append(BlockedBloom(self.left, self.rate / 2 ** (k + 1)))
            part, h = h[: self.left], h[self.left :]
            self.filters[-1].insert(part)
            self.left -= len(part)

    def dump(self) -> bytes:
        head = np.array([self.keys, self.left, len(self.filters)], dtype=np.int64)
        return b"".join([head.tobytes(), np.float64(self.rate).tobytes(), *(f.words.tobytes() for f in self.filters)])

    @classmethod
    def load(cls, data: bytes) -> "GrowingBloom":
        keys, left, n = np.frombuffer(data, dtype=np.int64, count=3).tolist()
        out = cls(keys, float(np.frombuffer(data, dtype=np.float64, count=1, offset=24)[0]))
        at = 32
        for k in range(n):
            f = BlockedBloom(keys << k, out.rate / 2 ** (k + 1))
            f.words = np.frombuffer(data, dtype=np.uint64, count=len(f.words), offset=at).copy()
            at += f.words.nbytes
            out.filters.append(f)
        out.left = left
        return out


class SeenKeys:
    """Blocked Bloom filters of all keys so far, kept in a folder, so that a later batch needs the filters of its buckets and no
    earlier key.  ``folder`` may hold filters already; then ``buckets``, ``keys_a_bucket`` and ``rate`` are those of the folder.

    A bucket's filter grows by a larger one where it is full.  A batch writes its buckets' filters beside the ones before, and
    last a row in the manifest: a batch that fails halfway leaves no trace, and a task that runs again writes the same.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keys_a_bucket: int = KEYS_A_BUCKET, rate: float = 1e-6) -> None:
        self.spark, self.folder, self.buckets, self.keys_a_bucket, self.rate = spark, folder, buckets, keys_a_bucket, rate
        self.latest: dict[int, str] = {}  # the file of each bucket
        self.batches = 0
        try:
            known = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect()  # a row a batch
        except AnalysisException:
            return  # a new one
        for r in sorted((json.loads(r["entry"]) for r in known), key=lambda r: r["number"]):
            self.buckets, self.keys_a_bucket, self.rate, self.batches = r["buckets"], r["keys"], r["rate"], r["number"] + 1
            self.latest.update(dict.fromkeys(r["written"], r["commit"]))

    def add(self, df: DataFrame, key: str, order: str) -> DataFrame:
        """``ord``, ``seen`` of each row of a batch: did its key occur in an earlier batch or in a row of smaller ``order``?  As in ``seen_before``."""
        rows = df.where(F.col(key).isNotNull()).select(F.col(order).cast("long").alias("ord"), F.xxhash64(key).alias("h"), F.lit(ROW).alias("kind"))
        commit, answers = uuid.uuid4().hex, f"{self.folder}/answers-{self.batches:06d}-{uuid.uuid4().hex}"
        bucket = F.when(F.col("decided"), F.lit(-1)).otherwise(F.pmod("h", F.lit(self.buckets)).cast("int"))
        (
            rows.mapInArrow(_repeats, _SCHEMA)
            .withColumn("bucket", bucket)
            .repartition(self.buckets, F.when(F.col("decided"), F.pmod("ord", F.lit(self.buckets)).cast("int")).otherwise(F.col("bucket")))
            .sortWithinPartitions("bucket", "kind", "ord")
            .mapInArrow(_kept_filters(self.folder, self.latest, commit, self.keys_a_bucket, self.rate), "ord long, bucket int, seen boolean")
            .write.parquet(answers)
        )
        out = self.spark.read.schema("ord long, bucket int, seen boolean").parquet(answers)
        written = sorted(r[0] for r in out.where("bucket >= 0").select("bucket").distinct().collect())  # at most one row a bucket
        entry = json.dumps({"number": self.batches, "commit": commit, "buckets": self.buckets, "keys": self.keys_a_bucket, "rate": self.rate, "written": written})
        self.spark.range(0, 1, 1, 1).select(F.lit(entry).alias("entry")).write.mode("append").parquet(f"{self.folder}/manifest")
        self.batches += 1
        self.latest.update(dict.fromkeys(written, commit))
        return out.select("ord", "seen")


_MANIFEST = "entry string"  # JSON


def _kept_filters(folder: str, latest: dict[int, str], commit: str, keys: int, rate: float):
    def run(batches):
        system, path = file_system(folder)
        name = lambda bucket, of: f"{path}/filters/bucket={bucket}/{of}"
        current, bloom = -1, None

        def keep() -> None:
            if bloom is not None:
                system.create_dir(os.path.dirname(name(current, commit)), recursive=True)
                own = f"{name(current, commit)}.{uuid.uuid4().hex}"  # a second attempt of the task doesn't meet the first
                with system.open_output_stream(own) as f:
                    f.write(bloom.dump())
                system.move(own, name(current, commit))

        for b in batches:
            bucket, order = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "ord"))
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            seen = np.ones(b.num_rows, dtype=bool)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for low, high in zip(edges, edges[1:]):
                if low == high or bucket[low] < 0:  # decided already
                    continue
                if bucket[low] != current:
                    keep()
                    current = int(bucket[low])
                    if current in latest:
                        with system.open_input_file(name(current, latest[current])) as f:
                            bloom = GrowingBloom.load(f.read())
                    else:
                        bloom = GrowingBloom(keys, rate)
                part = h[low:high]
                first = _first(part)
                answer = ~first
                answer[first] = bloom.query(part[first])
                bloom.insert(part[first & ~answer])
                seen[low:high] = answer
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(bucket.astype(np.int32)), pa.array(seen)], ["ord", "bucket", "seen"])
        keep()

    return run


def error_rate(answers: DataFrame) -> DataFrame:
    """Of the answers with absent keys: ``n_rows``, ``n_seen``, ``absent_keys``, ``wrong``, ``wrong_rate``."""
    is_row, is_absent = F.col("kind") == ROW, F.col("kind") == ABSENT
    wrong, asked = F.count_if(is_absent & F.col("seen")), F.count_if(is_absent)
    return answers.agg(
        F.count_if(is_row).alias("n_rows"), F.count_if(is_row & F.col("seen")).alias("n_seen"),
        asked.alias("absent_keys"), wrong.alias("wrong"), F.when(asked > 0, wrong / asked).alias("wrong_rate"),
    )

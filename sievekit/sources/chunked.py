"""Digests of files by path, read in chunks on the executors: contents never travel."""

from __future__ import annotations

import hashlib
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.config import Algorithm
from sievekit.formats import macho
from sievekit.functions.ctph import ssdeep_stream
from sievekit.functions.digests import digest_bytes
from sievekit.functions.tlsh import MIN_BYTES, TlshState

CHUNK = 1 << 20
EXECUTABLE = frozenset((*macho.FAT_MAGICS, *macho.THIN_MAGICS))  # first bytes


def digest_file(path: str, algorithm: str | Algorithm, chunk: int = CHUNK) -> str | None:
    """Digest of a file; OSError if it can't be read.  Memory doesn't grow with the file, but for cdhash with that of executables."""
    algo = Algorithm.parse(algorithm)
    with open(path, "rb") as f:
        size = os.fstat(f.fileno()).st_size
        if algo is Algorithm.CDHASH:
            head = f.read(4)
            return digest_bytes(head + f.read(), algo) if head in EXECUTABLE else None
        if algo is Algorithm.SSDEEP:
            if size <= chunk:
                return digest_bytes(f.read(), algo)

            def chunks():
                f.seek(0)
                while part := f.read(chunk):
                    yield part

            return ssdeep_stream(chunks, size)
        if algo is Algorithm.TLSH:
            if size < MIN_BYTES:
                return None
            state = TlshState()
        else:
            is_git = algo in (Algorithm.GIT, Algorithm.GIT256)
            state = hashlib.new({Algorithm.GIT: "sha1", Algorithm.GIT256: "sha256"}.get(algo, algo.value))
            if is_git:
                state.update(b"blob %d\0" % size)
        while part := f.read(chunk):
            state.update(part)
        return state.digest() if algo is Algorithm.TLSH else state.hexdigest()


def digest_paths(df: DataFrame, algorithm: str | Algorithm, errors: bool = False) -> DataFrame:
    """``seq, slice_idx, path, file_path, arch, digest`` of the files whose ``seq`` and ``path`` ``df`` has.

    Files that can't be read and files without a digest give no row; with ``errors`` ``path``, ``error`` of the former instead.
    Executors must see the files.
    """
    rows = digest_rows(df, algorithm)
    return rows.where(F.col("error").isNotNull()).select("path", "error") if errors else rows.where(F.col("error").isNull()).drop("error")


def digest_rows(df: DataFrame, algorithm: str | Algorithm) -> DataFrame:
    """Both in one pass: files that can't be read have an ``error`` and no digest."""
    algo = Algorithm.parse(algorithm)

    def run(batches):
        for b in batches:
            rows = []
            for seq, path in zip(b.column("seq").to_pylist(), b.column("path").to_pylist()):
                try:
                    value, error = digest_file(path, algo) if path is not None else None, None
                except OSError as e:
                    value, error = None, e.strerror or str(e)
                if value is not None or error is not None:
                    rows.append({"seq": seq, "slice_idx": 0, "path": path, "file_path": path, "arch": None, "digest": value, "error": error})
            yield pa.RecordBatch.from_pylist(rows, _ROWS)

    return df.select("seq", "path").mapInArrow(run, "seq long, slice_idx int, path string, file_path string, arch string, digest string, error string")


_ROWS = pa.schema([("seq", pa.int64()), ("slice_idx", pa.int32()), *((name, pa.string()) for name in ("path", "file_path", "arch", "digest", "error"))])

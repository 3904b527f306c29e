"""Digests of binary columns: native expressions where Spark has them, Arrow batches for the rest."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sievekit.config import Algorithm
from sievekit.formats import macho
from sievekit.functions.ctph import ssdeep_digest
from sievekit.functions.tlsh import MIN_BYTES, tlsh_digest


def as_bytes(column: Column, kind: str = "binary") -> Column:
    """Strings as UTF-8."""
    return F.encode(column, "UTF-8") if kind == "string" else column


def git_blob(content: Column) -> Column:
    """``content`` after the header of a blob with its length in bytes."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8")
    return F.concat(head, F.lit(bytearray(1)), content)


def _batched(f):
    @F.pandas_udf(StringType())
    def udf(values: pd.Series) -> pd.Series:
        return pd.Series([f(v) for v in values], dtype=object)

    return udf.asNondeterministic()  # else a later filter would compute it twice


_ssdeep, _ssdeep_of_part = _batched(ssdeep_digest), _batched(lambda v: ssdeep_digest(v, empty_is_null=True))
_tlsh = _batched(tlsh_digest)
_cdhash = _batched(lambda v: None if v is None else macho.code_directory_hash(bytes(v)))


def digest(content: Column, algorithm: str | Algorithm, part: bool = False) -> Column:
    """Digest of a binary column as text; NULL of NULL.

    ``part``: the bytes are a slice or other part in memory, of which an empty one has no ssdeep digest.  tlsh is NULL below
    50 bytes and with too little variety, cdhash without a code directory.  Unknown algorithms raise ValueError.
    """
    algo = Algorithm.parse(algorithm)
    match algo:
        case Algorithm.MD5:
            return F.md5(content)
        case Algorithm.SHA1:
            return F.sha1(content)
        case Algorithm.SHA256 | Algorithm.SHA384 | Algorithm.SHA512:
            return F.sha2(content, int(algo.value[3:]))
        case Algorithm.GIT:
            return F.sha1(git_blob(content))
        case Algorithm.GIT256:
            return F.sha2(git_blob(content), 256)
        case Algorithm.SSDEEP:
            return (_ssdeep_of_part if part else _ssdeep)(content)
        case Algorithm.TLSH:
            return _tlsh(F.when(F.octet_length(content) >= MIN_BYTES, content))
        case Algorithm.CDHASH:
            return _cdhash(content)


def digest_bytes(data: bytes, algorithm: str | Algorithm, part: bool = False) -> str | None:
    """The same for one value in Python."""
    algo = Algorithm.parse(algorithm)
    if algo is Algorithm.SSDEEP:
        return ssdeep_digest(data, empty_is_null=part)
    if algo is Algorithm.TLSH:
        return tlsh_digest(data)
    if algo is Algorithm.CDHASH:
        return macho.code_directory_hash(data)
    if algo in (Algorithm.GIT, Algorithm.GIT256):
        h = hashlib.sha256() if algo is Algorithm.GIT256 else hashlib.sha1()
        h.update(b"blob %d\0" % len(data))
        h.update(data)
        return h.hexdigest()
    return hashlib.new(algo.value, data).hexdigest()


def hex_text(content: Column) -> Column:
    """Lower-case hex."""
    return F.lower(F.hex(content))


def register(spark: SparkSession, prefix: str = "digest_") -> None:
    """Digests, score and distance as SQL functions: ``digest_ssdeep(binary)``, ``digest_tlsh(binary)``,
    ``digest_cdhash(binary)``, ``ssdeep_score(a, b)``, ``tlsh_distance(a, b)``."""
    from sievekit.operators.matching import ssdeep_score, tlsh_distance

    for name, f in {"ssdeep": _ssdeep, "tlsh": _tlsh, "cdhash": _cdhash}.items():
        spark.udf.register(prefix + name, f)
    spark.udf.register("ssdeep_score", ssdeep_score)
    spark.udf.register("tlsh_distance", tlsh_distance)

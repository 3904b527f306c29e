"""From files to rows: whole files, slices, code directory hashes, symbol hashes, archive tables of contents.

Input: ``seq`` long, ``path`` string, ``content`` binary (other columns are ignored).  Output of all:
``seq, slice_idx, path, file_path, arch, digest``; ``path`` is the display path, with the architecture of a slice;
``slice_idx`` is 0 for the whole file, slices count from 1.  Files that have no digest give no row: null contents, other
formats, broken containers, short texts for tlsh.  Empty tables give no rows; repeated rows each give theirs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

from sievekit.config import Algorithm
from sievekit.formats import macho, xar
from sievekit.functions.digests import digest

COLUMNS = ["seq", "slice_idx", "path", "file_path", "arch", "digest"]
SYMHASH_UNSUPPORTED = (Algorithm.GIT, Algorithm.GIT256, Algorithm.CDHASH)
_MAGICS = [*macho.FAT_MAGICS, *macho.THIN_MAGICS]


def _slices(name: str, kind: DataType) -> ArrayType:
    return ArrayType(StructType([StructField("arch", StringType()), StructField(name, kind)]))


def _result(df: DataFrame, index: Column, arch: Column, value: Column) -> DataFrame:
    shown = F.when(arch.isNotNull(), F.concat(F.col("path"), F.lit(" ("), arch, F.lit(")"))).otherwise(F.col("path"))
    return df.select(
        "seq", index.cast("int").alias("slice_idx"), shown.alias("path"), F.col("path").alias("file_path"), arch.cast("string").alias("arch"), value.alias("digest")
    ).where(F.col("digest").isNotNull())


def whole_files(df: DataFrame, algorithm: str | Algorithm) -> DataFrame:
    return _result(df, F.lit(0), F.lit(None).cast("string"), digest(F.col("content"), algorithm))


def arch_name(cputype: Column, cpusubtype: Column) -> Column:
    """Name of an architecture; capability bits of the subtype don't matter; ``unknown`` for others and nulls."""
    arm64e = (cputype == macho.ARM64) & (cpusubtype.bitwiseAND(F.lit(macho.SUBTYPE_MASK)) == macho.ARM64E_SUBTYPE)
    out = F.when(arm64e, "arm64e")
    for number, name in macho.CPU_NAMES.items():
        out = out.when(cputype == number, name)
    return out.otherwise("unknown")


def _u32(content: Column, at: Column | int) -> Column:
    place = (at if isinstance(at, Column) else F.lit(at)) + 1
    return F.conv(F.hex(F.substr(content, place, F.lit(4))), 16, 10).cast("long")


def _signed(value: Column) -> Column:
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def fat_archs(content: Column) -> Column:
    """Entries of a fat header as an array of structs, natively; NULL if it isn't one.  Entries cut off by the end are left out."""
    count = F.least(_u32(content, 4), F.floor((F.octet_length(content) - 8) / 20))
    is_fat = F.substring(content, 1, 4).isin(*map(bytearray, macho.FAT_MAGICS)) & (F.octet_length(content) >= 28) & _u32(content, 4).between(1, macho.MAX_ARCHS)

    def entry(i: Column) -> Column:
        at = (F.lit(8) + i * 20).cast("int")
        return F.struct(
            _signed(_u32(content, at)).alias("cputype"), _signed(_u32(content, at + 4)).alias("cpusubtype"),
            _u32(content, at + 8).alias("offset"), _u32(content, at + 12).alias("size"), _u32(content, at + 16).alias("align"),
        )

    return F.when(is_fat, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), entry))


def slice_bytes(content: Column, offset: Column, size: Column) -> Column:
    """The slice; empty bytes if it reaches outside the file."""
    inside = (offset < F.octet_length(content)) & (offset + size <= F.octet_length(content))
    return F.when(inside, F.substr(content, (offset + 1).cast("int"), size.cast("int"))).otherwise(F.lit(bytearray()))


def fat_slices(df: DataFrame) -> DataFrame:
    """``seq``, ``path``, ``slice_idx``, ``arch``, ``content`` of each slice of the fat files."""
    return (
        df.select("seq", "path", "content", F.posexplode(fat_archs(F.col("content"))).alias("at", "entry"))
        .select("seq", "path", (F.col("at") + 1).alias("slice_idx"), arch_name(F.col("entry.cputype"), F.col("entry.cpusubtype")).alias("arch"), slice_bytes(F.col("content"), F.col("entry.offset"), F.col("entry.size")).alias("content"))
    )


def with_slices(df: DataFrame, algorithm: str | Algorithm) -> DataFrame:
    """Rows of the whole files, and a row for each slice of fat files."""
    return whole_files(df, algorithm).unionByName(slices_only(df, algorithm))


def slices_only(df: DataFrame, algorithm: str | Algorithm) -> DataFrame:
    """A row for each slice of fat files."""
    return _result(fat_slices(df), F.col("slice_idx"), F.col("arch"), digest(F.col("content"), algorithm, part=True))


@F.pandas_udf(_slices("digest", StringType()))
def _cdhashes(content: pd.Series) -> pd.Series:
    return pd.Series([[{"arch": a, "digest": d} for a, part in macho.slices_of(c) if (d := macho.code_directory_hash(part))] for c in content])


def _symbol_names(strict_layout: bool):
    @F.pandas_udf(_slices("names", ArrayType(StringType())))
    def udf(content: pd.Series) -> pd.Series:
        return pd.Series([[{"arch": a, "names": n} for a, part in macho.slices_of(c) if (n := macho.imported_names(part, strict_layout)) is not None] for c in content])

    return udf.asNondeterministic()


def _executables(df: DataFrame) -> DataFrame:
    """Rows that begin like an executable, so that only those go to Python."""
    return df.where(F.substring("content", 1, 4).isin(*map(bytearray, _MAGICS)))


def cdhashes(df: DataFrame) -> DataFrame:
    """A row for each signed slice; of a thin file one without an architecture."""
    found = _executables(df).select("seq", "path", F.posexplode(_cdhashes.asNondeterministic()(F.col("content"))).alias("at", "r"))
    return _result(found, F.col("at") + 1, F.col("r.arch"), F.col("r.digest"))


def symhashes(df: DataFrame, algorithm: str | Algorithm = Algorithm.MD5, separator: str = ",", sort_symbols: bool = True, strict_layout: bool = False) -> DataFrame:
    """Digest of the joined names of imported symbols, a row for each slice that has a symbol table.

    No rows for git, git256 and cdhash.  A table without such symbols gives the digest of an empty text.
    """
    algo = Algorithm.parse(algorithm)
    found = _executables(df).select("seq", "path", F.posexplode(_symbol_names(strict_layout)(F.col("content"))).alias("at", "r"))
    if algo in SYMHASH_UNSUPPORTED:
        found = found.where(F.lit(False))
        algo = Algorithm.MD5
    names = F.array_sort("r.names") if sort_symbols else F.col("r.names")
    return _result(found, F.col("at") + 1, F.col("r.arch"), digest(F.encode(F.array_join(names, separator), "UTF-8"), algo, part=True))


def xar_tocs(df: DataFrame, algorithm: str | Algorithm = Algorithm.SHA1, decompress: bool = False) -> DataFrame:
    """Digest of the table of contents, stored or inflated, of each archive; no rows for cdhash."""
    algo = Algorithm.parse(algorithm)
    rows = df.where(xar.is_xar(F.col("content")))
    if algo is Algorithm.CDHASH:
        rows, algo = rows.where(F.lit(False)), Algorithm.SHA1
    part = xar.inflated_toc(F.col("content")) if decompress else xar.toc(F.col("content"))
    rows = rows.select("seq", "path", part.alias("content")).where(F.col("content").isNotNull())
    return _result(rows, F.lit(0), F.lit(None).cast("string"), digest(F.col("content"), algo, part=True))

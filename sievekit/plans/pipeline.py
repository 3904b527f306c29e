"""A digest query from rows or files to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.config import DigestSpec, Mode
from sievekit.formats import macho, xar
from sievekit.operators import decode
from sievekit.operators.formatting import result_line
from sievekit.operators.matching import first_of_file, match
from sievekit.session import written
from sievekit.sources.chunked import digest_rows
from sievekit.sources.filetree import files, walk_errors


class DigestQuery:
    """One run with fixed settings: decode, digest, match, sort, format."""

    def __init__(self, spec: DigestSpec) -> None:
        self.spec = spec
        self.algo = spec.algo  # raises ValueError for unknown names before anything is planned

    def decoded(self, df: DataFrame) -> DataFrame:
        """Digests of the rows of ``df`` (``seq``, ``path``, ``content``), by mode."""
        s = self.spec
        match s.mode:
            case Mode.SYMHASH:
                return decode.symhashes(df, self.algo, s.joiner, s.sort_symbols)
            case Mode.XAR_TOC:
                return decode.xar_tocs(df, self.algo, s.decompress)
            case Mode.CDHASH:
                return decode.cdhashes(df)
            case Mode.SLICES:
                return decode.with_slices(df, self.algo)
        return decode.whole_files(df, self.algo)

    def matched(self, results: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """Results that match the targets (all without targets), with ``score``."""
        s = self.spec
        if targets is None and not s.targets:
            return results.withColumn("score", F.lit(None).cast("int"))
        out = match(results, list(s.targets) if targets is None else targets, self.algo, s.threshold_for(True))
        once = s.quiet if s.mode is Mode.CDHASH else s.mode is Mode.SYMHASH and (s.quiet or not s.slices)
        return first_of_file(out) if once else out

    def results(self, df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """``seq, slice_idx, path, file_path, arch, digest, score``."""
        return self._sorted(self.matched(self.decoded(df), targets))

    def _sorted(self, out: DataFrame) -> DataFrame:
        return out.orderBy("file_path", "seq", "slice_idx") if self.spec.sort else out

    def lines(self, df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """One column ``line``, in the order of the results."""
        return self._lines(self.results(df, targets), targets is not None)

    def _lines(self, results: DataFrame, matching: bool = False) -> DataFrame:
        return results.select(result_line(self.algo, matching or bool(self.spec.targets), self.spec.quiet).alias("line"))

    def over_files(self, spark: SparkSession, roots: list[str] | str = ".", targets: DataFrame | None = None) -> DataFrame:
        """Results over file trees.  Whole files are read in chunks where they lie; of containers those only that begin like one are loaded."""
        return self._sorted(self.matched(self._found(spark, roots).drop("error"), targets))

    def errors_over_files(self, spark: SparkSession, roots: list[str] | str = ".") -> DataFrame:
        """``path``, ``error`` of what ``over_files`` leaves out because it can't be read.  Reads the files once more."""
        failed = self._found(spark, roots, errors=True).where(F.col("error").isNotNull()).select("path", "error")
        return failed.unionByName(walk_errors(spark, roots, self.spec.follow, self._parts(spark))).distinct()

    def lines_over_files(self, spark: SparkSession, roots: list[str] | str = ".", targets: DataFrame | None = None, errors: bool = False) -> DataFrame:
        """One column ``line``; with ``errors`` also ``path``, ``error`` of files that couldn't be read, which have no line.  In one pass."""
        if not errors:
            return self._lines(self.over_files(spark, roots, targets), targets is not None)
        found = written(self._found(spark, roots, errors=True))
        good = self._sorted(self.matched(found.where(F.col("error").isNull()).drop("error"), targets))
        none = F.lit(None).cast("string")
        lines = self._lines(good, targets is not None).select("line", none.alias("path"), none.alias("error"))
        failed = found.where(F.col("error").isNotNull()).select("path", "error").unionByName(walk_errors(spark, roots, self.spec.follow, self._parts(spark))).distinct()
        return lines.unionByName(failed.select(none.alias("line"), "path", "error"))

    def _parts(self, spark: SparkSession) -> int:
        return max(self.spec.parallelism(spark.sparkContext.defaultParallelism), 1)

    def _found(self, spark: SparkSession, roots: list[str] | str, errors: bool = False) -> DataFrame:
        """Digests of the files with ``error``; files that can't be read have rows with ``errors`` only."""
        s, parts = self.spec, self._parts(spark)
        tree = lambda magic=None: files(spark, roots, s.follow, magic is not None, parts, magic)
        rows = lambda: digest_rows(tree(), self.algo)
        whole = rows if errors else lambda: rows().where(F.col("error").isNull())
        none = F.lit(None).cast("string")
        if s.mode is Mode.REGULAR:
            return whole()
        held = tree(list(macho.FAT_MAGICS) if s.mode is Mode.SLICES else [bytes(xar.MAGIC)] if s.mode is Mode.XAR_TOC else [*macho.FAT_MAGICS, *macho.THIN_MAGICS])
        out = (decode.slices_only(held, self.algo) if s.mode is Mode.SLICES else self.decoded(held)).withColumn("error", none)
        if s.mode is Mode.SLICES:
            out = out.unionByName(whole(), allowMissingColumns=True)
        if errors:
            out = out.unionByName(held.where(F.col("error").isNotNull()).select("seq", "path", F.col("path").alias("file_path"), "error"), allowMissingColumns=True)
        return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines as text files."""
    lines.write.text(path)

"""Command line: ``python -m sievekit.cli [options] [path ...]``."""

from __future__ import annotations

import argparse
import sys

from sievekit import __version__
from sievekit.config import DEFAULT_SCORE, Algorithm, DigestSpec
from sievekit.plans.pipeline import DigestQuery
from sievekit.session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievekit", description="Digests of files and trees, compared and matched.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("paths", nargs="*", default=["."])
    p.add_argument("-a", "--algo", type=Algorithm.parse, help=", ".join(Algorithm))
    p.add_argument("-j", "--jobs", type=int, default=1, help="parallel tasks; 0 for all CPUs")
    p.add_argument("-L", "--follow", action="store_true", help="follow symbolic links")
    p.add_argument("-q", "--quiet", action="store_true", help="only the digest, or in matches only the path")
    p.add_argument("--slices", action="store_true", help="also each slice of fat executables")
    p.add_argument("--sort", action=argparse.BooleanOptionalAction, default=False, help="sort by path")
    p.add_argument("-m", "--match", action="append", default=[], metavar="DIGEST", help="only what matches; may be repeated")
    p.add_argument("-s", "--score", type=int, default=DEFAULT_SCORE, help="least ssdeep score or greatest tlsh distance")
    p.add_argument("--symhash", action="store_true", help="digest of the imported symbols")
    p.add_argument("--separator", default=",", help=r"between symbols; \n, \0 and \t are expanded")
    p.add_argument("--sort-symbols", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--xar-toc", action="store_true", help="digest of an archive's table of contents")
    p.add_argument("--decompress", action="store_true", help="of the inflated table of contents")
    return p


def spec_of(args: argparse.Namespace) -> DigestSpec:
    return DigestSpec(
        algorithm=args.algo, slices=args.slices, symhash=args.symhash, xar_toc=args.xar_toc, decompress=args.decompress, separator=args.separator,
        sort_symbols=args.sort_symbols, sort=args.sort, quiet=args.quiet, follow=args.follow, jobs=args.jobs, targets=tuple(args.match), score=args.score,
    )


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spec = spec_of(args)
    spark = local_session("*" if spec.jobs == 0 else max(1, spec.jobs))
    spark.sparkContext.setLogLevel("ERROR")
    for row in DigestQuery(spec).lines_over_files(spark, args.paths, errors=True).toLocalIterator():  # a partition at a time
        if row.line is not None:
            print(row.line)
        else:
            print(f"sievekit: {row.path}: {row.error}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

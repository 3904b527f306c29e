"""Algorithms, modes and defaults of a digest query."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import StrEnum


class Algorithm(StrEnum):
    """md5, sha1, sha256, sha384, sha512: standard hashes.  git, git256: blob ids.
    cdhash: code directory hash of executables.  ssdeep, tlsh: fuzzy hashes."""

    MD5 = "md5"
    SHA1 = "sha1"
    SHA256 = "sha256"
    SHA384 = "sha384"
    SHA512 = "sha512"
    GIT = "git"
    GIT256 = "git256"
    CDHASH = "cdhash"
    SSDEEP = "ssdeep"
    TLSH = "tlsh"

    @property
    def is_fuzzy(self) -> bool:
        return self in (Algorithm.SSDEEP, Algorithm.TLSH)

    @classmethod
    def parse(cls, name: str | "Algorithm") -> "Algorithm":
        """By name, in any case; ``sha2`` means sha256.  ValueError if unknown."""
        low = str(name).lower()
        try:
            return cls("sha256" if low == "sha2" else low)
        except ValueError:
            raise ValueError(f"unsupported algorithm: {name}") from None


class Mode(StrEnum):
    """What is digested; the first that applies in this order wins."""

    SYMHASH = "symhash"
    XAR_TOC = "xar-toc"
    CDHASH = "cdhash"
    SLICES = "slices"
    REGULAR = "regular"


DEFAULT_SCORE = 40
_ESCAPES = {r"\n": "\n", r"\0": "\0", r"\t": "\t"}


@dataclass(frozen=True)
class DigestSpec:
    """Settings of one digest query, with the defaults of the command line.

    ``score`` 0 with a fuzzy algorithm and targets counts as not given, so 40;
    the matching functions themselves take 0 as it is.
    """

    algorithm: str | None = None
    slices: bool = False
    symhash: bool = False
    xar_toc: bool = False
    decompress: bool = False
    separator: str = ","
    sort_symbols: bool = True
    sort: bool = False
    quiet: bool = False
    follow: bool = False
    jobs: int = 1
    targets: tuple[str, ...] = field(default_factory=tuple)
    score: int = DEFAULT_SCORE

    @property
    def algo(self) -> Algorithm:
        if self.algorithm is not None:
            return Algorithm.parse(self.algorithm)
        return Algorithm.MD5 if self.symhash else Algorithm.SHA1 if self.xar_toc else Algorithm.SHA256

    @property
    def mode(self) -> Mode:
        if self.symhash:
            return Mode.SYMHASH
        if self.xar_toc:
            return Mode.XAR_TOC
        if self.algo is Algorithm.CDHASH:
            return Mode.CDHASH
        return Mode.SLICES if self.slices else Mode.REGULAR

    @property
    def threshold(self) -> int:
        return self.threshold_for(bool(self.targets))

    def threshold_for(self, has_targets: bool) -> int:
        """The threshold for a list or a table of targets."""
        return DEFAULT_SCORE if self.score == 0 and self.algo.is_fuzzy and has_targets else self.score

    @property
    def joiner(self) -> str:
        """The separator with its escapes expanded."""
        out = self.separator
        for name, char in _ESCAPES.items():
            out = out.replace(name, char)
        return out

    def parallelism(self, cpus: int) -> int:
        """Partitions for ``jobs``: 0 means all CPUs, negatives mean 1."""
        return cpus if self.jobs == 0 else max(1, self.jobs)

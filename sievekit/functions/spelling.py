"""The plain form of digests that were written in other ways.

Accepted spellings: either case, white space around, ``0x``, ``ALGO:``, bytes joined by
colons, groups joined by dashes, ``ALGO (path) = digest``, ``digest  path``,
``digest *path``, ``digest,"path"``; tlsh with or without ``T1``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of each algorithm's digest.
HEX_DIGITS = {"md5": 32, "sha1": 40, "git": 40, "sha256": 64, "git256": 64, "cdhash": 64, "sha384": 96, "sha512": 128}
TLSH_DIGITS = 70
SSDEEP_TEXT = r"^[0-9]{1,10}:[A-Za-z0-9+/]{1,64}:[A-Za-z0-9+/]{1,32}\z"


def plain_digest(algo: Column, digest: Column) -> Column:
    """Plain form of ``digest`` of algorithm ``algo``; NULL if there is none.

    NULL for null, empty, cut, overlong and damaged values and for unknown algorithms.
    Plain: lower-case hex; for tlsh ``T1`` and 70 upper-case digits; for ssdeep
    ``blocksize:sig1:sig2`` with its case kept.  Native expressions only.
    """
    digits = reduce(lambda w, kv: w.when(algo == kv[0], kv[1]), HEX_DIGITS.items(), F.when(F.lit(False), 0))
    is_hex = lambda t: (F.length(t) == digits) & ~t.rlike("[^0-9a-f]")
    is_tlsh = lambda t: (F.length(t) == TLSH_DIGITS + 2) & t.startswith("T1") & ~F.substring(t, 3, TLSH_DIGITS).rlike("[^0-9A-F]")
    token = F.regexp_replace(
        F.regexp_extract(digest, r'^\s*(?:[A-Za-z0-9-]+ \([^\n]*\) = )?([^\s,"]+)', 1), "(?i)^(?:md5|sha-?[0-9]+|git|git256|cdhash|ssdeep|tlsh):(?=.)", ""
    )
    bare = F.lower(F.translate(F.regexp_replace(token, "^0[xX]", ""), ":-", ""))
    marked = F.when(F.length(token) == TLSH_DIGITS, F.concat(F.lit("T1"), F.upper(token))).otherwise(F.upper(token))
    return (
        # Most values are plain already; the conditions come from cheap to dear.
        F.when(algo == "tlsh", F.when(is_tlsh(digest), digest).otherwise(_once(marked, lambda t: F.when(is_tlsh(t), t))))
        .when(algo == "ssdeep", F.when(digest.rlike(SSDEEP_TEXT), digest).otherwise(_once(token, lambda t: F.when(t.rlike(SSDEEP_TEXT), t))))
        .otherwise(F.when(is_hex(digest), digest).otherwise(_once(bare, lambda t: F.when(is_hex(t), t))))
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def plain_name(name: Column) -> Column:
    """Lower case, trimmed, words joined by dashes; NULL if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(F.lower(name), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "-")
    return F.when(out != "", out)

"""Digests against targets: equal, by prefix, by score, by distance.

Targets are a list of texts or a DataFrame with a column ``target``; a list is part of the plan, a DataFrame is joined on
keys, so it may be of any size.  A row that several targets match comes out once.  Result: the rows that match, with ``score``
(NULL for equal and prefix matches).  Null digests and null targets never match; no targets, no rows.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from sievekit.config import Algorithm
from sievekit.functions import ctph, tlsh
from sievekit.session import written

INLINE_TARGETS = 1_000
_MAX_DIGITS = 128


@F.pandas_udf(IntegerType())
def ssdeep_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100; -1 if malformed."""
    return pd.Series(ctph.scores([x or None for x in a], [x or None for x in b]))


@F.pandas_udf(IntegerType())
def tlsh_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 upwards; -1 if malformed."""
    (x, p), (y, q) = tlsh.parse(a.tolist()), tlsh.parse(b.tolist())
    d = tlsh.distances(x, y) if len(x) else pd.Series([], dtype="int32")
    return pd.Series(d).where(pd.Series(p & q), tlsh.INVALID)


def _best_score(targets: list[str], threshold: int):
    @F.pandas_udf(IntegerType())
    def udf(digests: pd.Series) -> pd.Series:
        best = pd.Series([None] * len(digests), dtype="Int64")
        texts = digests.tolist()
        some = [i for i, t in enumerate(texts) if t is not None]
        for target in targets:
            s = ctph.scores([texts[i] for i in some], [target] * len(some))
            for i, v in zip(some, s.tolist()):
                if v >= threshold:
                    best[i] = v if pd.isna(best[i]) else max(int(best[i]), v)
        return best.clip(lower=0)

    return udf.asNondeterministic()


def _best_distance(targets: list[str], threshold: int):
    known, good = tlsh.parse(targets)
    known = known[good]

    @F.pandas_udf(IntegerType())
    def udf(digests: pd.Series) -> pd.Series:
        x, ok = tlsh.parse(digests.tolist())
        out = pd.Series([None] * len(x), dtype="Int64")
        for i in ok.nonzero()[0]:
            d = tlsh.distances(x[i], known)
            d = d[d <= threshold]
            if len(d):
                out[i] = int(d.min())
        return out

    return udf.asNondeterministic()


def match(df: DataFrame, targets: list[str] | tuple[str, ...] | DataFrame, algorithm: str | Algorithm, threshold: int = 40, digest: str = "digest") -> DataFrame:
    """Rows of ``df`` whose ``digest`` matches, in the way of the algorithm, with ``score``.

    ssdeep: a score of at least ``threshold``, the greatest counts, and at least 0.  tlsh: a distance of at most ``threshold``, the
    least counts.  cdhash: equal, or either begins with the other.  Others: equal.  Upper and lower case are the same.
    A column ``score`` that is there already is replaced; columns whose names begin with ``_`` may not be there.
    """
    algo = Algorithm.parse(algorithm)
    df = df.drop("score")
    if not isinstance(targets, DataFrame):
        targets = list(dict.fromkeys(t for t in targets if t is not None))
        if len(targets) > INLINE_TARGETS:
            return match(df, df.sparkSession.createDataFrame([(t,) for t in targets], "target string"), algo, threshold, digest)
    inline = not isinstance(targets, DataFrame)
    if not inline and (algo.is_fuzzy or algo is Algorithm.CDHASH):
        df = written(df)  # read twice below, but what leads to it, such as the digests of a file tree, is computed once
    d = F.col(digest)
    if algo is Algorithm.SSDEEP:
        return _scored(df, _best_score(targets, threshold)(d)) if inline else _join_ssdeep(df, targets, threshold, digest)
    if algo is Algorithm.TLSH:
        return _scored(df, _best_distance(targets, threshold)(d)) if inline else _join_tlsh(df, targets, threshold, digest)
    if algo is Algorithm.CDHASH:
        return (_prefix_inline if inline else _prefix_join)(df, targets, digest).withColumn("score", F.lit(None).cast("int"))
    if inline:
        out = df.where(F.lower(d).isin([t.lower() for t in targets])) if targets else df.where(F.lit(False))
    else:
        out = df.join(targets.select(F.lower("target").alias("_t")), F.lower(d) == F.col("_t"), "left_semi")
    return out.withColumn("score", F.lit(None).cast("int"))


def _scored(df: DataFrame, score: Column) -> DataFrame:
    return df.withColumn("score", score).where(F.col("score").isNotNull())


def _prefix_inline(df: DataFrame, targets: list[str], digest: str) -> DataFrame:
    d = F.lower(digest)
    if not targets:
        return df.where(F.lit(False))
    return df.where(F.exists(F.array(*(F.lit(t.lower()) for t in targets)), lambda t: F.startswith(d, t) | F.startswith(t, d)))


def _prefixes(text: Column, lengths: list[int]) -> Column:
    """Prefixes of ``text`` of those lengths that aren't longer than it."""
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(text))
    return F.transform(fitting, lambda n: F.substr(text, F.lit(1), n))


def _prefix_join(df: DataFrame, targets: DataFrame, digest: str) -> DataFrame:
    """Equi-joins on prefixes: of the digests in the lengths of the targets, and the other way round.

    Lengths beyond those of any digest are cut, so there are at most 129 of either.
    """
    known = targets.where(F.col("target").isNotNull()).select(F.lower("target").alias("_t")).distinct()
    rows = df.where(F.col(digest).isNotNull()).select(F.lower(digest).alias("_d")).distinct()
    size = lambda c: F.least(F.length(c), F.lit(_MAX_DIGITS))
    lengths = [r[0] for r in known.select(size("_t")).distinct().collect()]
    own = [r[0] for r in rows.select(size("_d")).distinct().collect()]
    if not lengths or not own:
        return df.where(F.lit(False))
    longer = known.select(F.explode(_prefixes(F.col("_t"), own)).alias("_p"))
    keys = known.select(F.col("_t").alias("_p")).unionByName(longer).distinct()
    # A digest that begins with a target has one of its prefixes among them; one that a target begins with is among them itself.
    probe = F.array_distinct(F.concat(F.transform(_prefixes(F.col("_d"), lengths), lambda p: F.struct(p.alias("p"), F.lit(0).alias("how"))), F.array(F.struct(F.col("_d").alias("p"), F.lit(1).alias("how")))))
    whole = known.select(F.col("_t").alias("_p"), F.lit(0).alias("_how")).unionByName(keys.select("_p", F.lit(1).alias("_how"))).distinct()
    hits = rows.select("_d", F.explode(probe).alias("_x")).join(whole, (F.col("_x.p") == F.col("_p")) & (F.col("_x.how") == F.col("_how")), "left_semi")
    return df.join(hits.select("_d"), F.lower(digest) == F.col("_d"), "left_semi")


def _window_keys(column: str):
    def run(batches):
        for b in batches:
            texts = b.column(column).to_pylist()
            keys, at = ctph.window_keys(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([texts[i] for i in at], type=pa.string())], ["key", column])

    return run


def _join_ssdeep(df: DataFrame, targets: DataFrame, threshold: int, digest: str) -> DataFrame:
    """A score above 0 needs a window of seven characters in common, so candidates are joined on keys of those."""
    known = targets.where(F.col("target").isNotNull()).select("target").distinct()
    digests = df.where(F.col(digest).isNotNull()).select(F.col(digest).alias("_d")).distinct()
    left = digests.mapInArrow(_window_keys("_d"), "key long, _d string")
    right = known.mapInArrow(_window_keys("target"), "key long, target string")
    pairs = left.join(right, "key").select("_d", "target").distinct().unionByName(digests.join(known, F.col("_d") == F.col("target")))
    best = pairs.select("_d", ssdeep_score.asNondeterministic()("_d", "target").alias("score")).groupBy("_d").agg(F.max("score").alias("score"))
    if threshold > 0:
        best = best.where(F.col("score") >= threshold)
        return df.join(best, F.col(digest) == F.col("_d")).drop("_d")
    # From 0 on everything that is compared at all matches; below, also what can't be.
    form = r"^[0-9]+:[^:]*:[^:,]*"
    fits = F.lit(True) if threshold < 0 else F.col(digest).rlike(form) & F.lit(bool(known.where(F.col("target").rlike(form)).take(1)))
    if not known.take(1):
        return df.where(F.lit(False)).withColumn("score", F.lit(None).cast("int"))
    return df.where(F.col(digest).isNotNull() & fits).join(best, F.col(digest) == F.col("_d"), "left").withColumn("score", F.greatest(F.coalesce("score", F.lit(0)), F.lit(0))).drop("_d")


def bare_tlsh(text: Column) -> Column:
    """Upper-case digits without ``T1``; NULL if malformed."""
    bare = F.regexp_replace(F.upper(text), "^T1", "")
    return F.when(bare.rlike(r"^[0-9A-F]{70}\z"), bare)


def length_code(bare: Column) -> Column:
    """The length byte of bare digits."""
    return F.conv(F.reverse(F.substring(bare, 3, 2)), 16, 10).cast("int")


def _join_tlsh(df: DataFrame, targets: DataFrame, threshold: int, digest: str) -> DataFrame:
    """The length byte costs 12 a step beyond the first, so candidates are joined on its band."""
    if threshold < 0:
        return df.where(F.lit(False)).withColumn("score", F.lit(None).cast("int"))
    band = min(128, max(1, threshold // 12))
    known = targets.select(bare_tlsh(F.col("target")).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    around = F.array_distinct(F.transform(F.sequence(F.lit(-band), F.lit(band)), lambda k: F.pmod(length_code(F.col("_t")) + k, F.lit(256)).cast("int")))
    digests = df.select(F.col(digest).alias("_d"), bare_tlsh(F.col(digest)).alias("_b")).where(F.col("_b").isNotNull()).distinct()
    pairs = digests.withColumn("_l", length_code(F.col("_b"))).join(known.select("_t", F.explode(around).alias("_l")), "_l")
    near = pairs.select("_d", tlsh_distance.asNondeterministic()("_b", "_t").alias("score")).where(F.col("score").between(0, threshold))
    return df.join(near.groupBy("_d").agg(F.min("score").alias("score")), F.col(digest) == F.col("_d")).drop("_d")


def first_of_file(df: DataFrame) -> DataFrame:
    """The first matching slice of each file, under the file's own path."""
    first = F.row_number().over(Window.partitionBy("seq").orderBy("slice_idx"))
    return df.withColumn("_n", first).where("_n = 1").drop("_n").withColumn("path", F.col("file_path"))

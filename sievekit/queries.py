"""Named queries over the test tables, and the SQL that must give the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.config import Algorithm, DigestSpec
from sievekit.formats import build, xar
from sievekit.functions import ctph, tlsh
from sievekit.operators import decode
from sievekit.operators.formatting import result_line
from sievekit.operators.matching import match
from sievekit.operators.skew import numbered, per_key_results
from sievekit.plans.pipeline import DigestQuery
from sievekit.session import spread
from sievekit.sources.tables import table, with_plain

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Plain form of a digest, in DuckDB's SQL.
PLAIN_SQL = r"""
plain AS (
  SELECT *, CASE
      WHEN algo = 'ssdeep' THEN CASE WHEN regexp_full_match(token, '[0-9]{1,10}:[A-Za-z0-9+/]{1,64}:[A-Za-z0-9+/]{1,32}') THEN token END
      WHEN algo = 'tlsh' THEN 'T1' || nullif(regexp_extract(upper(token), '^(?:T1)?([0-9A-F]{70})$', 1), '')
      WHEN NOT regexp_full_match(bare, '[0-9a-f]+') THEN NULL
      WHEN length(bare) = CASE algo WHEN 'md5' THEN 32 WHEN 'sha1' THEN 40 WHEN 'git' THEN 40 WHEN 'sha256' THEN 64
        WHEN 'git256' THEN 64 WHEN 'cdhash' THEN 64 WHEN 'sha384' THEN 96 WHEN 'sha512' THEN 128 END THEN bare END AS plain
  FROM (SELECT *, lower(replace(replace(regexp_replace(token, '^0[xX]', ''), ':', ''), '-', '')) AS bare
    FROM (SELECT *, regexp_replace(regexp_extract(digest, '^\s*(?:[A-Za-z0-9-]+ \([^\n]*\) = )?([^\s,"]+)', 1),
        '^(?i)(?:md5|sha-?[0-9]+|git|git256|cdhash|ssdeep|tlsh):', '') AS token FROM {table})))
"""


def plain_sql(name: str) -> str:
    return PLAIN_SQL.replace("{table}", name)


def digest_groups(spark: SparkSession, d: str) -> DataFrame:
    return per_key_results(with_plain(table(spark, d, "digest_result")).select("plain", "file_path", "scanned_at"), "plain", "file_path", "scanned_at")


@query("WITH " + plain_sql("digest_result") + """
SELECT plain AS digest, count(*) AS n_rows, count(DISTINCT file_path) AS n_files, min(scanned_at) AS first_scan, max(scanned_at) AS last_scan
FROM plain WHERE plain IS NOT NULL GROUP BY plain""")
def p1_digest_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows, files, first and last scan of every digest."""
    return digest_groups(spark, d).select(
        F.col("key").alias("digest"), "n_rows", F.col("n_members").alias("n_files"), F.col("first_at").alias("first_scan"), F.col("last_at").alias("last_scan")
    )


@query("WITH " + plain_sql("digest_result") + """
SELECT plain AS digest FROM plain WHERE plain IS NOT NULL GROUP BY plain HAVING count(*) >= 0.02 * (SELECT count(*) FROM digest_result)""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Digests held by at least 2 % of all rows."""
    total = table(spark, d, "digest_result").count()
    return digest_groups(spark, d).where(F.col("n_rows") * 50 >= total).select(F.col("key").alias("digest"))


# ---- digests of whole texts


def documents(spark: SparkSession, d: str) -> DataFrame:
    """``seq``, ``path``, ``content`` of every document."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.encode("text", "UTF-8").alias("content"))


def _tlsh_sql() -> str:
    """TLSH of every document, in DuckDB's SQL: bytes with the four before them, buckets of six mappings, quartiles, codes."""
    one = lambda x: f"pe[1 + {x}]"
    step = lambda salt, *parts: reduce(lambda h, part: one(f"xor({h}, {part})"), parts, one(str(salt)))
    buckets = ", ".join(step(salt, "c0", f"c{i}", f"c{j}") for salt, i, j in tlsh.TRIPLETS)
    swap = lambda x: f"(({x}) % 16 * 16 + ({x}) // 16)"
    length = "CASE WHEN n <= 656 THEN floor(ln(n) / ln(1.5)) WHEN n <= 3199 THEN floor(ln(n) / ln(1.3) - 8.72777) ELSE floor(ln(n) / ln(1.1) - 62.5472) END"
    code = "CASE WHEN k[i] > q3 THEN 3 WHEN k[i] > q2 THEN 2 WHEN k[i] > q1 THEN 1 ELSE 0 END"
    return f"""WITH {DOCUMENTS_SQL}, t AS (SELECT {tlsh.PEARSON.tolist()} AS pe),
b AS (SELECT seq, i, CAST('0x' || substr(hex(content), 2 * i - 1, 2) AS INTEGER) AS c0 FROM documents_, unnest(range(1, octet_length(content) + 1)) u(i) WHERE octet_length(content) >= {tlsh.MIN_BYTES}),
w AS (SELECT *, lag(c0, 1) OVER o AS c1, lag(c0, 2) OVER o AS c2, lag(c0, 3) OVER o AS c3, lag(c0, 4) OVER o AS c4 FROM b WINDOW o AS (PARTITION BY seq ORDER BY i)),
h AS (SELECT seq, unnest([{buckets}]) AS bucket FROM w, t WHERE c4 IS NOT NULL),
n AS (SELECT seq, bucket, count(*) AS n FROM h WHERE bucket < 128 GROUP BY ALL),
f AS (SELECT seq, list(coalesce(n, 0) ORDER BY bucket) AS k FROM (SELECT DISTINCT seq FROM b) CROSS JOIN (SELECT unnest(range(128)) AS bucket) LEFT JOIN n USING (seq, bucket) GROUP BY seq),
q AS (SELECT seq, k, list_sort(k)[32] AS q1, list_sort(k)[64] AS q2, list_sort(k)[96] AS q3 FROM f WHERE list_sort(k)[96] > 0 AND len(list_filter(k, lambda x: x > 0)) > 64),
c AS (SELECT seq, list_reduce(list_prepend(0, list(ahead ORDER BY i)), lambda c, x: [{', '.join(map(str, tlsh.PEARSON.tolist()))}][1 + xor(x, c)]) AS checksum
  FROM (SELECT seq, i, {step(0, 'c0', 'c1')} AS ahead FROM w, t WHERE c4 IS NOT NULL) GROUP BY seq),
d AS (SELECT seq, count(*) AS n FROM b GROUP BY seq)
SELECT seq, 'T1' || printf('%02X%02X%02X', {swap('checksum')}, {swap(f'CAST({length} AS INTEGER) % 256')}, CAST(floor(q1 * 100 / q3) AS INTEGER) % 16 * 16 + CAST(floor(q2 * 100 / q3) AS INTEGER) % 16)
  || array_to_string(list_transform(range(31, -1, -1), lambda r: printf('%02X', CAST(list_sum(list_transform(range(4 * r + 1, 4 * r + 5), lambda i: ({code}) * [1, 4, 16, 64][1 + (i - 1) % 4])) AS INTEGER))), '') AS digest
FROM q JOIN c USING (seq) JOIN d USING (seq)"""


def ssdeep_sql(rows: str) -> str:
    """ssdeep digests of ``rows`` (a table or CTE with ``seq``, ``content``), in DuckDB's SQL: the rolling hash from each byte and the six
    before it, ends of pieces by block size, a hash over each piece of the two signatures that are used."""
    before = ", ".join(f"coalesce(lag(c, {k}) OVER o, 0) AS b{k}" for k in range(1, 7))
    rolled = " + ".join(["8 * c", *(f"{8 - k} * b{k}" for k in range(1, 7))])
    shifted = reduce(lambda x, k: f"xor({x}, b{k} << {5 * k})", range(1, 7), "c")
    digit = lambda h: f"substr('{ctph.DIGITS}', 1 + {h}, 1)"
    hashed = lambda listed: f"list_reduce(list_prepend({ctph.PIECE_START}, {listed}), lambda h, x: xor(h * {ctph.PIECE_FACTOR} % 64, x % 64))"
    levels = range(32)
    return f"""b AS (SELECT seq, i, CAST('0x' || substr(hex(content), 2 * i - 1, 2) AS BIGINT) AS c FROM {rows}, unnest(range(1, octet_length(content) + 1)) u(i)),
r AS MATERIALIZED (SELECT seq, i, c, ({rolled} + ({shifted}) % 4294967296) % 4294967296 AS roll FROM (SELECT *, {before} FROM b WINDOW o AS (PARTITION BY seq ORDER BY i))),
n AS (SELECT seq, max(i) AS n, arg_max(roll, i) AS last, [{', '.join(f'count(*) FILTER ((roll + 1) % {3 << k} = 0)' for k in levels)}] AS ends FROM r GROUP BY seq),
l AS (SELECT *, list_max(list_filter(range(0, 32), lambda k: (k = 0 OR 3 * (1 << greatest(k - 1, 0)) * 64 < n) AND (k = 0 OR ends[k + 1] >= 32))) AS level FROM n),
s AS (SELECT seq, n, last, 3 * (1 << (level + k)) AS block, k, CASE k WHEN 0 THEN {ctph.MAX_FIRST} ELSE {ctph.MAX_SECOND} END AS most FROM l, unnest([0, 1]) u(k)),
e AS (SELECT s.*, r.i, r.c, (roll + 1) % block = 0 AS is_end FROM s JOIN r USING (seq)),
f AS (SELECT *, sum(is_end::INTEGER) OVER (PARTITION BY seq, k ORDER BY i) AS rank FROM e),
g AS (SELECT *, least(rank - is_end::INTEGER, most - 1) AS piece, max(CASE WHEN is_end THEN i END) OVER (PARTITION BY seq, k) AS last_end FROM f),
h AS (SELECT seq, k, piece, any_value(most) AS most, bool_or(is_end) AND piece < any_value(most) - 1 AS is_whole, any_value(last) AS last, max(rank) AS rank,
  {hashed('list(c ORDER BY i)')} AS hash, {hashed('coalesce(list(c ORDER BY i) FILTER (i <= last_end), [])')} AS capped FROM g GROUP BY seq, k, piece),
d AS (SELECT seq, k, coalesce(string_agg({digit('hash')}, '' ORDER BY piece) FILTER (is_whole), '') AS digits, any_value(last) AS last, max(rank) >= any_value(most) AS is_capped,
  coalesce(any_value(hash) FILTER (NOT is_whole), {ctph.PIECE_START}) AS rest, any_value(capped) FILTER (NOT is_whole) AS capped FROM h GROUP BY seq, k),
sigs AS (SELECT seq, k, digits || CASE WHEN last <> 0 THEN {digit('rest')} WHEN is_capped THEN {digit('capped')} ELSE '' END AS sig FROM d),
fuzzy AS (SELECT seq, coalesce((SELECT max(block) FROM s WHERE s.seq = x.seq AND k = 0), 3) || ':' || coalesce((SELECT max(sig) FROM sigs WHERE sigs.seq = x.seq AND k = 0), '')
  || ':' || coalesce((SELECT max(sig) FROM sigs WHERE sigs.seq = x.seq AND k = 1), '') AS digest FROM {rows} x WHERE content IS NOT NULL)"""


DOCUMENTS_SQL = "documents_ AS (SELECT doc_id AS seq, 'doc/' || doc_id AS path, encode(text) AS content FROM documents)"
_SQL_DIGESTS = {
    "md5": "md5(content)", "sha1": "sha1(content)", "sha256": "sha256(content)",
    "git": "sha1(encode('blob ' || octet_length(content)) || unhex('00') || content)", "git256": "sha256(encode('blob ' || octet_length(content)) || unhex('00') || content)",
    "sha384": None, "sha512": None, "ssdeep": None, "tlsh": None,
}


def _digest_query(algo: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = documents(spark, d)
        return DigestQuery(DigestSpec(algorithm=algo)).results(spread(rows) if Algorithm(algo).is_fuzzy else rows).select("seq", "digest")

    run.__name__, run.__doc__ = f"digest_{algo}", f"{algo} of every document's text."
    expression = _SQL_DIGESTS[algo]
    sql = _tlsh_sql() if algo == "tlsh" else f"WITH {DOCUMENTS_SQL}, {ssdeep_sql('documents_')} SELECT * FROM fuzzy" if algo == "ssdeep" else f"WITH {DOCUMENTS_SQL} SELECT seq, {expression} AS digest FROM documents_ WHERE content IS NOT NULL" if expression else None
    return query(sql)(run)


for _algo in _SQL_DIGESTS:
    _digest_query(_algo)


@query("WITH " + plain_sql("digest_result") + " SELECT row_id, plain FROM plain")
def plain_digests(spark: SparkSession, d: str) -> DataFrame:
    """The plain form of every digest; NULL where a row has none."""
    return with_plain(table(spark, d, "digest_result")).select("row_id", "plain")


# ---- containers made from the texts


def _containers(spark: SparkSession, d: str, make) -> DataFrame:
    return spread(documents(spark, d)).withColumn("content", make(F.col("content")))


@query(f"""WITH {DOCUMENTS_SQL}, fat AS (SELECT *, unhex('cafebabe00000002010000070000000300000030' || printf('%08x', octet_length(content)) || '00000000'
    || '0100000c00000002' || printf('%08x', 48 + octet_length(content)) || printf('%08x', octet_length(content)) || '00000000') || content || back AS file
  FROM (SELECT *, unhex(array_to_string(list_reverse(regexp_extract_all(hex(content), '..')), '')) AS back FROM documents_ WHERE content IS NOT NULL))
SELECT seq, 0 AS slice_idx, path, CAST(NULL AS VARCHAR) AS arch, sha256(file) AS digest FROM fat
UNION ALL SELECT seq, 1, path || ' (x86_64)', 'x86_64', sha256(content) FROM fat
UNION ALL SELECT seq, 2, path || ' (arm64e)', 'arm64e', sha256(back) FROM fat""")
def macho_slices(spark: SparkSession, d: str) -> DataFrame:
    """Whole file and slices of fat files with two slices."""
    return DigestQuery(DigestSpec(slices=True)).results(_containers(spark, d, build.fat_of)).select("seq", "slice_idx", "path", "arch", "digest")


_NAMES_SQL = "list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> '')"


def _imports(spark: SparkSession, d: str) -> DataFrame:
    """Executables that import the Latin words of the texts."""
    names = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    return spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), build.symbols_of(names).alias("content"))


@query(f"SELECT doc_id AS seq, md5(array_to_string(list_sort({_NAMES_SQL}), ',')) AS digest FROM documents WHERE text IS NOT NULL")
def symhash_md5(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the sorted imported symbols."""
    return DigestQuery(DigestSpec(symhash=True)).results(_imports(spark, d)).select("seq", "digest")


@query(f"""WITH names AS MATERIALIZED (SELECT doc_id AS seq, encode(array_to_string(list_sort({_NAMES_SQL}), ',')) AS content FROM documents WHERE text IS NOT NULL),
{ssdeep_sql('names')} SELECT seq, fuzzy.digest FROM fuzzy JOIN names USING (seq) WHERE octet_length(content) > 0""")
def symhash_ssdeep(spark: SparkSession, d: str) -> DataFrame:
    """Fuzzy digest of the sorted imported symbols; without symbols there is none."""
    return DigestQuery(DigestSpec(algorithm="ssdeep", symhash=True)).results(_imports(spark, d)).select("seq", "digest")


@query(f"""SELECT doc_id AS seq, 'doc/' || doc_id || ' (' || arch || ')' AS path, arch, md5(array_to_string(names, ',')) AS digest FROM (
  SELECT doc_id, 'x86_64' AS arch, list_sort({_NAMES_SQL}) AS names FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'arm64e', ({_NAMES_SQL})[1:1] FROM documents WHERE text IS NOT NULL)""")
def symhash_slices(spark: SparkSession, d: str) -> DataFrame:
    """Symbol hashes of fat files: a row for each slice that has a symbol table."""
    names = F.filter(F.split("text", "[^A-Za-z]+"), lambda x: x != "")
    files = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), build.fat_symbols_of(names).alias("content"))
    return DigestQuery(DigestSpec(symhash=True, slices=True)).results(files).select("seq", "path", "arch", "digest")


@query(f"SELECT doc_id AS seq, sha256(array_to_string({_NAMES_SQL}, chr(10))) AS digest FROM documents WHERE text IS NOT NULL")
def symhash_sha256_unsorted(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the imported symbols in table order, a line each."""
    spec = DigestSpec(algorithm="sha256", symhash=True, separator=r"\n", sort_symbols=False)
    return DigestQuery(spec).results(_imports(spark, d)).select("seq", "digest")


def _directory_sql(kind: str) -> str:
    return f"unhex('fade0c02' || printf('%08x', 44 + octet_length(content)) || repeat('00', 29) || '{kind}' || repeat('00', 6)) || content"


@query(f"""WITH {DOCUMENTS_SQL} SELECT seq, path || ' (x86_64)' AS path, sha256({_directory_sql('02')}) AS digest, 64 AS digits FROM documents_ WHERE content IS NOT NULL
UNION ALL SELECT seq, path || ' (arm64)', NULL, 96 FROM documents_ WHERE content IS NOT NULL""")
def cdhash_sha256(spark: SparkSession, d: str) -> DataFrame:
    """Code directory hashes of all slices; the stronger of two directories counts.  SHA-384 ones by their length, as SQL has no such function."""
    rows = DigestQuery(DigestSpec(algorithm="cdhash")).results(_containers(spark, d, build.signed_of))
    digits = F.length("digest")
    return rows.select("seq", "path", F.when(digits != 96, F.col("digest")).alias("digest"), digits.alias("digits"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT seq, slice_idx, path || ' (' || arch || ')' AS path, digest FROM (
  SELECT seq, path, 1 AS slice_idx, 'x86_64' AS arch, sha1({_directory_sql('01')}) AS digest FROM documents_ WHERE content IS NOT NULL
  UNION ALL SELECT seq, path, 2, 'arm64', sha256({_directory_sql('02')}) FROM documents_ WHERE content IS NOT NULL)""")
def cdhash_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Code directory hashes by SHA-1 and SHA-256; a third slice has a hash type without a digest, so no row."""
    return DigestQuery(DigestSpec(algorithm="cdhash")).results(_containers(spark, d, build.signed_kinds_of)).select("seq", "slice_idx", "path", "digest")


@query(f"WITH {DOCUMENTS_SQL} SELECT path AS line FROM documents_ WHERE content IS NOT NULL AND octet_length(content) > 0")
def first_matching_slice(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the signed files that match, one for each file although both slices match."""
    found = DigestQuery(DigestSpec(algorithm="cdhash")).results(_containers(spark, d, build.signed_of).where(F.octet_length("content") > 0))
    targets = found.select(F.upper("digest").alias("target"))
    files = documents(spark, d).where(F.octet_length("content") > 0)
    spec = DigestSpec(algorithm="cdhash", quiet=True)
    return DigestQuery(spec).lines(files.withColumn("content", build.signed_of(F.col("content"))), targets)


@query(f"WITH {DOCUMENTS_SQL} SELECT seq, sha1(content) AS digest FROM documents_ WHERE content IS NOT NULL")
def xar_toc_sha1(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the stored table of contents."""
    return DigestQuery(DigestSpec(xar_toc=True)).results(_containers(spark, d, build.xar_stored_of)).select("seq", "digest")


@query(f"WITH {DOCUMENTS_SQL} SELECT seq, sha1(content) AS digest FROM documents_ WHERE octet_length(content) > 0")
def xar_toc_decompressed(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the inflated table of contents; an empty one has none."""
    return DigestQuery(DigestSpec(xar_toc=True, decompress=True)).results(_containers(spark, d, build.xar_of)).select("seq", "digest")


@query(f"WITH {DOCUMENTS_SQL} SELECT seq, 28 AS header_size, 1 AS version, CAST(octet_length(content) AS BIGINT) AS toc_len, CAST(1 AS BIGINT) AS cksum_alg FROM documents_ WHERE content IS NOT NULL")
def xar_headers(spark: SparkSession, d: str) -> DataFrame:
    """Header fields of archives."""
    rows = _containers(spark, d, build.xar_stored_of).select("seq", xar.header(F.col("content")).alias("h")).where("h IS NOT NULL")
    return rows.select("seq", "h.header_size", "h.version", F.col("h.toc_len").cast("long").alias("toc_len"), "h.cksum_alg")


@query("""SELECT seq, slice_idx, CASE WHEN cputype = 16777228 AND (cpusubtype & 16777215) = 2 THEN 'arm64e' WHEN cputype = 16777228 THEN 'arm64'
  WHEN cputype = 16777223 THEN 'x86_64' WHEN cputype = 7 THEN 'i386' WHEN cputype = 12 THEN 'arm' WHEN cputype = 18 THEN 'ppc' WHEN cputype = 16777234 THEN 'ppc64'
  ELSE 'unknown' END AS arch FROM fat_arch""")
def arch_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the architectures of all entries."""
    return table(spark, d, "fat_arch").select("seq", "slice_idx", decode.arch_name(F.col("cputype"), F.col("cpusubtype")).alias("arch"))


# ---- matching


def _plain_results(spark: SparkSession, d: str, *algos: str) -> DataFrame:
    rows = with_plain(table(spark, d, "digest_result"), "digest")
    return (rows.where(F.col("algo").isin(*algos)) if algos else rows).select("row_id", "digest").where(F.col("digest").isNotNull())


def _known(spark: SparkSession, d: str, *algos: str) -> DataFrame:
    rows = with_plain(table(spark, d, "known_digest"), "target")
    return (rows.where(F.col("algo").isin(*algos)) if algos else rows).select("target")


_TWO_PLAIN_SQL = "WITH r AS (WITH " + plain_sql("digest_result") + " SELECT * FROM plain WHERE plain IS NOT NULL), k AS (WITH " + plain_sql("known_digest") + " SELECT * FROM plain) "


@query(_TWO_PLAIN_SQL + "SELECT row_id, plain AS digest FROM r WHERE lower(plain) IN (SELECT lower(plain) FROM k)")
def match_exact(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose digest is known, in any case."""
    return match(_plain_results(spark, d), _known(spark, d).select(F.upper("target").alias("target")), "sha256").drop("score")


@query(_TWO_PLAIN_SQL + "SELECT row_id, plain AS digest FROM r WHERE EXISTS (SELECT 1 FROM k WHERE starts_with(lower(r.plain), substr(lower(k.plain), 1, 12)) OR starts_with(substr(lower(k.plain), 1, 12), lower(r.plain)))")
def match_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose digest begins with the first twelve digits of a known one."""
    return match(_plain_results(spark, d), _known(spark, d).select(F.substring("target", 1, 12).alias("target")), "cdhash").drop("score")


def ssdeep_scores_sql(left: str, right: str) -> str:
    """CTEs that end in ``scored`` (``x``, ``y``, ``score``), in DuckDB's SQL: scores above 0 of the plain ssdeep digests ``p`` of two
    queries.  Signatures of one block size that share a window of seven characters; their edits by the longest common subsequence."""
    shorten = lambda t: f"array_to_string(list_transform(list_filter(range(1, length({t}) + 1), lambda i: NOT (i > 3 AND substr({t}, i, 1) = substr({t}, i - 1, 1) AND substr({t}, i, 1) = substr({t}, i - 2, 1) AND substr({t}, i, 1) = substr({t}, i - 3, 1))), lambda i: substr({t}, i, 1)), '')"
    side = lambda k, q: f"""h{k} AS MATERIALIZED (SELECT p, CAST(split_part(p, ':', 1) AS BIGINT) AS b, {shorten("split_part(p, ':', 2)")} AS s1, {shorten("split_part(p, ':', 3)")} AS s2 FROM (SELECT DISTINCT p FROM ({q}))),
w{k} AS MATERIALIZED (SELECT DISTINCT p, b, s, substr(s, i, 7) AS w FROM (SELECT p, b, s1 AS s FROM h{k} UNION ALL SELECT p, 2 * b, s2 FROM h{k}), unnest(range(1, length(s) - 5)) u(i))"""  # noqa: E731
    # A row of lengths, one for each end in t, goes on with each character of s: the greatest so far of the length above and, where the characters are equal, the one before and 1.
    equal = "list_transform(range(1, length(s) + 1), lambda i: list_transform(range(1, length(t) + 1), lambda j: CASE WHEN substr(t, j, 1) = substr(s, i, 1) THEN 1 ELSE 0 END))"
    row = "list_transform([list_transform(range(1, len(e) + 1), lambda j: greatest(r[j], CASE WHEN j > 1 THEN r[j - 1] ELSE 0 END + e[j]))], lambda c: list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])))[1]"
    common = f"list_reduce(list_prepend(list_transform(range(1, length(t) + 1), lambda j: 0), {equal}), lambda r, e: {row})[-1]"
    return f"""{side(1, left)}, {side(2, right)},
pairs AS MATERIALIZED (SELECT DISTINCT x.b, x.s, y.s AS t FROM w1 x JOIN w2 y USING (b, w)),
edits AS MATERIALIZED (SELECT *, 100 - 100 * ((length(s) + length(t) - 2 * {common}) * 64 // (length(s) + length(t))) // 64 AS score FROM pairs),
scored AS MATERIALIZED (SELECT x, y, CAST(max(score) AS INTEGER) AS score FROM (
  SELECT x.p AS x, y.p AS y, CASE WHEN b < 45 THEN least(score, b // 3 * least(length(s), length(t))) ELSE score END AS score
  FROM (SELECT DISTINCT p, b, s FROM w1) x JOIN edits USING (b, s) JOIN (SELECT DISTINCT p, b, s AS t FROM w2) y USING (b, t)
  UNION ALL SELECT x.p, y.p, 100 FROM h1 x JOIN h2 y USING (b, s1, s2)) GROUP BY ALL)"""


_NEAR_KNOWN_SQL = _TWO_PLAIN_SQL + ", " + ssdeep_scores_sql("SELECT plain AS p FROM r WHERE algo = 'ssdeep'", "SELECT plain AS p FROM k WHERE algo = 'ssdeep' AND plain IS NOT NULL") + ", best AS (SELECT x AS digest, max(score) AS score FROM scored WHERE score >= 40 GROUP BY ALL) "


@query(_NEAR_KNOWN_SQL + "SELECT row_id, best.digest, score FROM r JOIN best ON plain = best.digest")
def match_ssdeep(spark: SparkSession, d: str) -> DataFrame:
    """ssdeep rows near a known digest, with the best score."""
    return match(_plain_results(spark, d, "ssdeep"), _known(spark, d, "ssdeep"), "ssdeep", 40)


def _hex_sql(text: str, at: str) -> str:
    return f"(strpos('0123456789ABCDEF', substr({text}, {at}, 1)) - 1)"


def _around_sql(x: str, y: str, size: int) -> str:
    return f"least(abs({x} - {y}), {size} - abs({x} - {y}))"


def tlsh_distance_sql(x: str, y: str) -> str:
    """Distance of two plain tlsh digests, in DuckDB's SQL."""
    length = _around_sql(*(f"({_hex_sql(t, '6')} * 16 + {_hex_sql(t, '5')})" for t in (x, y)), 256)
    ratios = [_around_sql(_hex_sql(x, at), _hex_sql(y, at), 16) for at in ("7", "8")]
    part = lambda f: "[0, 1, 2, 6][1 + abs(" + " - ".join(f.format(_hex_sql(t, "i")) for t in (x, y)) + ")]"
    body = f"list_sum(list_transform(range(9, 73), lambda i: {part('({} // 4)')} + {part('({} % 4)')}))"
    return (
        f"CAST((CASE WHEN {length} <= 1 THEN {length} ELSE 12 * {length} END)"
        + "".join(f" + (CASE WHEN {q} <= 1 THEN {q} ELSE ({q} - 1) * 12 END)" for q in ratios)
        + f" + (CASE WHEN substr({x}, 3, 2) = substr({y}, 3, 2) THEN 0 ELSE 1 END) + {body} AS INTEGER)"
    )


@query(_TWO_PLAIN_SQL + f"""SELECT row_id, digest, min(d) AS score FROM (SELECT r.row_id, r.plain AS digest, {tlsh_distance_sql("r.plain", "k.plain")} AS d
  FROM r, k WHERE r.algo = 'tlsh' AND k.algo = 'tlsh') WHERE d <= 40 GROUP BY ALL""")
def match_tlsh(spark: SparkSession, d: str) -> DataFrame:
    """tlsh rows near a known digest, with the least distance."""
    return match(_plain_results(spark, d, "tlsh"), _known(spark, d, "tlsh"), "tlsh", 40)


# ---- lines


@query(f"WITH {DOCUMENTS_SQL} SELECT sha256(content) || '  ' || path AS line FROM documents_ WHERE content IS NOT NULL")
def format_lines(spark: SparkSession, d: str) -> DataFrame:
    """Digest and path."""
    return DigestQuery(DigestSpec()).lines(documents(spark, d))


@query(f"WITH {DOCUMENTS_SQL} SELECT md5(content) AS line FROM documents_ WHERE content IS NOT NULL")
def format_quiet(spark: SparkSession, d: str) -> DataFrame:
    """Digests only."""
    return DigestQuery(DigestSpec(algorithm="md5", quiet=True)).lines(documents(spark, d))


@query(_NEAR_KNOWN_SQL + "SELECT plain || repeat(' ', greatest(0, 107 - length(plain))) || printf(' %3d', score) || '  ' || path AS line FROM r JOIN best ON plain = best.digest WHERE path IS NOT NULL")
def format_match_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the ssdeep rows near a known digest: padded digest, score, path."""
    rows = with_plain(table(spark, d, "digest_result"), "digest").where("digest IS NOT NULL AND algo = 'ssdeep' AND path IS NOT NULL").select("digest", "path", "file_path")
    found = match(rows, _known(spark, d, "ssdeep"), "ssdeep", 40)
    return found.select(result_line(Algorithm.SSDEEP, True, False).alias("line"))


@query("SELECT row_number() OVER (ORDER BY encode(path), seq) AS place, path FROM work_item WHERE path IS NOT NULL")
def sorted_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths in binary order with their places, numbered without putting them all in one task."""
    rows = table(spark, d, "work_item").where(F.col("path").isNotNull()).select("path", "seq")
    return numbered(rows, ["path", "seq"]).select((F.col("number") + 1).alias("place"), "path")


@query()
def file_tree(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of the files of the table folder."""
    return DigestQuery(DigestSpec(jobs=0, sort=True)).over_files(spark, [d]).select("path", "digest")

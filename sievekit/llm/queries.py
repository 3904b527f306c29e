"""Queries of the problems tagged llm, and the SQL that must give the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.spelling import plain_name
from sievekit.llm import bloom, hamming, mixing, packing, segments, topk, toxicity
from sievekit.llm.groups import linked_groups
from sievekit.llm.tokens import with_token_counts
from sievekit.queries import plain_sql, ssdeep_scores_sql, tlsh_distance_sql
from sievekit.session import spread, written
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


# ---- 2: has this key been seen before?


def _answers(spark: SparkSession, d: str, absent: int = 0) -> DataFrame:
    rows = with_plain(table(spark, d, "digest_result")).select("row_id", "plain")
    known = with_plain(table(spark, d, "known_digest")).select("plain")
    return bloom.seen_before(rows, "plain", "row_id", known, absent=absent)


SEEN_SQL = "WITH " + plain_sql("digest_result") + ", known AS (WITH " + plain_sql("known_digest") + """ SELECT DISTINCT plain FROM plain)
SELECT row_id{more} FROM (SELECT row_id, plain, row_number() OVER (PARTITION BY plain ORDER BY row_id) > 1 OR plain IN (SELECT plain FROM known) AS seen
  FROM plain WHERE plain IS NOT NULL) {where}"""


@query(SEEN_SQL.replace("{more}", "").replace("{where}", "WHERE seen"))
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose digest is known or in an earlier row."""
    return _answers(spark, d).where((F.col("kind") == bloom.ROW) & F.col("seen")).select(F.col("ord").alias("row_id"))


@query(SEEN_SQL.replace("{more}", ", seen").replace("{where}", ""))
def p2_seen(spark: SparkSession, d: str) -> DataFrame:
    """Every row that has a digest, in order of arrival: is its digest known or in an earlier row?"""
    return _answers(spark, d).where(F.col("kind") == bloom.ROW).select(F.col("ord").alias("row_id"), "seen")


@query()
def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Rate of wrong answers, measured with a million keys that are surely absent."""
    return bloom.error_rate(_answers(spark, d, absent=1_000_000))


# ---- 3: new batches against all history

_SPACES = {"digest_result": "regular", "symhash_result": "symhash"}
HOT_DIGESTS = 1_000


def _batches(spark: SparkSession, d: str) -> DataFrame:
    """``space``, ``table_name``, ``row_id``, ``batch_no``, ``algo``, ``plain`` of the rows of both tables that have a digest."""
    parts = [
        with_plain(table(spark, d, name)).where(F.col("plain").isNotNull()).select(F.lit(k).alias("space"), F.lit(name).alias("table_name"), "row_id", "batch_no", "algo", "plain")
        for k, name in enumerate(_SPACES)
    ]
    return parts[0].unionByName(parts[1])


def _split(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all batches with their ``status``, batch after batch through the index; rows without a number are the last batch."""
    index = segments.SegmentIndex(spark)
    known = with_plain(table(spark, d, "known_digest"))
    space = F.when(F.col("scan_mode") == "regular", 0).when(F.col("scan_mode") == "symhash", 1)
    index.add(known.select(space.alias("space"), "algo", "plain"), -1, compare=False)
    rows = written(_batches(spark, d), by="batch_no")
    numbers = [r[0] for r in rows.select("batch_no").distinct().collect()]  # a row a batch
    for b in sorted(numbers, key=lambda b: (b is None, b)):
        index.add(rows.where(F.col("batch_no").isNull() if b is None else F.col("batch_no") == b), b)
    judged = index.judged().select(F.col("space").alias("s"), "batch", F.col("plain").alias("p"), "status", "n")
    # Digests with a thousandth of the rows or more, so at most a thousand, are joined where their rows lie.
    hot = F.col("n") * HOT_DIGESTS >= rows.count()
    same = (F.col("space") == F.col("s")) & F.col("batch_no").eqNullSafe(F.col("batch")) & (F.col("plain") == F.col("p"))
    at_once = rows.join(F.broadcast(judged.where(hot)), same, "left")
    rest = at_once.where("status IS NULL").select(*rows.columns).join(judged.where(~hot), same)
    return at_once.where("status IS NOT NULL").unionByName(rest).drop("s", "batch", "p", "n")


def _judged_sql(batches: int = 12) -> str:
    """CTEs that end in ``judged`` (``space``, ``batch``, ``plain``, ``status``): batch after batch, each against what was accepted before it."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS table_name, row_id, batch_no, algo, plain FROM (WITH " + plain_sql(name) + " SELECT * FROM plain) WHERE plain IS NOT NULL" for name in _SPACES)
    spaces = " ".join(f"WHEN '{mode}' THEN '{name}'" for name, mode in _SPACES.items())
    out = f"""WITH rows AS MATERIALIZED ({rows}),
known AS MATERIALIZED (SELECT CASE scan_mode {spaces} END AS table_name, algo, plain FROM (WITH {plain_sql('known_digest')} SELECT * FROM plain) WHERE plain IS NOT NULL),
every AS MATERIALIZED (SELECT DISTINCT table_name, algo, plain FROM (SELECT table_name, algo, plain FROM rows UNION ALL SELECT table_name, algo, plain FROM known)),
numbers AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY batch_no NULLS LAST) AS k FROM (SELECT DISTINCT table_name, batch_no, algo, plain FROM rows)),
{ssdeep_scores_sql("SELECT plain AS p FROM every WHERE algo = 'ssdeep'", "SELECT plain AS p FROM every WHERE algo = 'ssdeep'")},
near AS MATERIALIZED (SELECT x, y FROM scored WHERE score >= 40 UNION ALL
  SELECT a.plain, b.plain FROM every a JOIN every b USING (table_name) WHERE a.algo = 'tlsh' AND b.algo = 'tlsh' AND {tlsh_distance_sql('a.plain', 'b.plain')} <= 40),
accepted0 AS (SELECT DISTINCT table_name, plain FROM known)"""
    for k in range(1, batches + 1):
        old = f"accepted{k - 1}"
        out += f""",
judged{k} AS MATERIALIZED (SELECT n.table_name, n.batch_no, n.plain, CASE WHEN EXISTS (SELECT 1 FROM {old} o WHERE o.table_name = n.table_name AND o.plain = n.plain) THEN 'equal'
  WHEN EXISTS (SELECT 1 FROM near JOIN {old} o ON near.y = o.plain WHERE near.x = n.plain AND o.table_name = n.table_name) THEN 'near' ELSE 'new' END AS status FROM numbers n WHERE k = {k}),
accepted{k} AS MATERIALIZED (SELECT * FROM {old} UNION SELECT table_name, plain FROM judged{k} WHERE status = 'new')"""
    return out + ", judged AS (" + " UNION ALL ".join(f"SELECT * FROM judged{k}" for k in range(1, batches + 1)) + ") "


_JUDGED_ROWS_SQL = _judged_sql() + " SELECT {what} FROM rows r JOIN judged j ON r.table_name = j.table_name AND r.batch_no IS NOT DISTINCT FROM j.batch_no AND r.plain = j.plain {rest}"


@query(_JUDGED_ROWS_SQL.replace("{what}", "r.table_name, r.row_id").replace("{rest}", "WHERE status <> 'new'"))
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose digest equals or is near to an accepted one.  Rows with a null batch_no are judged as one batch after all others."""
    return _split(spark, d).where(F.col("status") != segments.NEW).select("table_name", "row_id")


@query(_JUDGED_ROWS_SQL.replace("{what}", "r.table_name, r.batch_no, status, count(*) AS n_rows").replace("{rest}", "GROUP BY ALL"))
def p3_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table and batch by what became of them; rows with a null batch_no are the last batch, whose number stays null."""
    return _split(spark, d).groupBy("table_name", "batch_no", "status").agg(F.count("*").alias("n_rows"))


# ---- 4: most frequent digests


@query("WITH " + plain_sql("digest_result") + """
SELECT plain AS digest FROM plain WHERE plain IS NOT NULL GROUP BY plain ORDER BY count(*) DESC, plain LIMIT 20""")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The 20 digests with the most rows."""
    return _top(spark, d).select("digest")


@query("WITH " + plain_sql("digest_result") + """
SELECT plain AS digest, count(*) AS n_rows FROM plain WHERE plain IS NOT NULL GROUP BY plain ORDER BY count(*) DESC, plain LIMIT 20""")
def p4_top_digests(spark: SparkSession, d: str) -> DataFrame:
    """The 20 digests with the most rows, and their row counts."""
    return _top(spark, d)


def _top(spark: SparkSession, d: str) -> DataFrame:
    rows = with_plain(table(spark, d, "digest_result")).select("plain")
    return topk.most_frequent(rows, "plain", 20).withColumnRenamed("value", "digest")


# ---- 5: near-duplicate digests and paths


def _fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "digest_result").where(F.col("algo").isin("ssdeep", "tlsh"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """``text``, ``id`` of the different paths."""
    return written(_fuzzy(spark, d).where(F.col("file_path").isNotNull()).groupBy(F.col("file_path").alias("text")).agg(F.min("row_id").alias("id")))


def _near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """``field_name``, ``id_1``, ``id_2``; a value's id is the smallest row_id that holds it."""
    rows = with_plain(_fuzzy(spark, d)).where(F.col("plain").isNotNull())
    digests = written(rows.groupBy("algo", "plain").agg(F.min("row_id").alias("id")), by="algo")  # spelled once, each half read alone
    of = lambda algo: digests.where(F.col("algo") == algo)
    found = [("digest", hamming.tlsh_pairs(of("tlsh"))), ("digest", hamming.ssdeep_pairs(of("ssdeep"))), ("file_path", hamming.text_pairs(_paths(spark, d)))]
    parts = [p.select(F.lit(name).alias("field_name"), "id_1", "id_2") for name, p in found]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PATHS_SQL = """v AS (SELECT file_path AS t, min(row_id) AS id FROM digest_result WHERE algo IN ('ssdeep', 'tlsh') AND file_path IS NOT NULL GROUP BY 1),
g AS (SELECT id, unnest(list_distinct(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4)))) AS gram FROM v),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.id AS i, b.id AS j, count(*) AS b FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY 1, 2),
alike AS MATERIALIZED (SELECT i AS row_id_1, j AS row_id_2 FROM c JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE 10 * b >= 7 * (x.n + y.n - b))"""
_OF_ALGO_SQL = lambda algo: "SELECT plain AS p, min(row_id) AS id FROM (WITH " + plain_sql("digest_result") + f" SELECT * FROM plain WHERE algo = '{algo}' AND plain IS NOT NULL) GROUP BY plain"
_NEAR_SQL = f"""t AS ({_OF_ALGO_SQL('tlsh')}), s AS MATERIALIZED ({_OF_ALGO_SQL('ssdeep')}), {ssdeep_scores_sql('SELECT p FROM s', 'SELECT p FROM s')}, {_PATHS_SQL},
found AS MATERIALIZED (SELECT 'digest' AS field_name, a.id AS row_id_1, b.id AS row_id_2 FROM t a JOIN t b ON a.id < b.id WHERE {tlsh_distance_sql('a.p', 'b.p')} <= 40
  UNION ALL SELECT 'digest', a.id, b.id FROM scored JOIN s a ON a.p = x JOIN s b ON b.p = y WHERE a.id < b.id AND score >= 40 UNION ALL SELECT 'file_path', * FROM alike)"""


@query(f"WITH {_NEAR_SQL} SELECT * FROM found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near digests and of alike paths among the ssdeep and tlsh rows."""
    return _near_pairs(spark, d).select("field_name", F.col("id_1").alias("row_id_1"), F.col("id_2").alias("row_id_2"))


@query(f"WITH {_PATHS_SQL} SELECT * FROM alike")
def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of alike paths."""
    return hamming.text_pairs(_paths(spark, d)).select(F.col("id_1").alias("row_id_1"), F.col("id_2").alias("row_id_2"))


@query("WITH t AS (SELECT plain, min(row_id) AS id FROM (WITH " + plain_sql("digest_result") + " SELECT * FROM plain WHERE algo = 'tlsh' AND plain IS NOT NULL) GROUP BY plain)"
    + f" SELECT * FROM (SELECT a.id AS row_id_1, b.id AS row_id_2, {tlsh_distance_sql('a.plain', 'b.plain')} AS distance FROM t a JOIN t b ON a.id < b.id) WHERE distance <= 40")
def p5_tlsh(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near tlsh digests with their distances."""
    rows = with_plain(table(spark, d, "digest_result").where("algo = 'tlsh'")).where(F.col("plain").isNotNull())
    digests = rows.groupBy("plain").agg(F.min("row_id").alias("id"))
    return hamming.tlsh_pairs(digests).select(F.col("id_1").alias("row_id_1"), F.col("id_2").alias("row_id_2"), "distance")


@query(f"""WITH RECURSIVE {_NEAR_SQL}, links AS (SELECT field_name, row_id_1 AS a, row_id_2 AS b FROM found UNION ALL SELECT field_name, row_id_2, row_id_1 FROM found),
reached AS (SELECT DISTINCT field_name, a, a AS b FROM links UNION SELECT r.field_name, r.a, l.b FROM reached r JOIN links l ON r.field_name = l.field_name AND r.b = l.a),
heads AS (SELECT field_name, a, min(b) AS head FROM reached GROUP BY ALL)
SELECT field_name, a AS row_id, head AS group_id, n_links FROM heads JOIN (SELECT field_name, a, count(*) AS n_links FROM links GROUP BY ALL) USING (field_name, a)""")
def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row for each digest and path that is near to another: its group, named by the smallest row_id, and its links."""
    pairs = written(_near_pairs(spark, d))
    of = lambda field: linked_groups(pairs.where(F.col("field_name") == field)).withColumn("field_name", F.lit(field))
    both = of("digest").unionByName(of("file_path"))
    return both.select("field_name", F.col("id").alias("row_id"), F.col("group_id"), "n_links")


# ---- 6: filling containers


def _sizes(spark: SparkSession, d: str, *columns) -> DataFrame:
    return with_token_counts(spread(table(spark, d, "documents").select("doc_id", *columns, "text")))


@query()
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its container of 2,048 tokens."""
    return packing.pack(_sizes(spark, d), "doc_id", "n_tokens").withColumnRenamed("id", "doc_id")


# Sizes leave room, so that bytes tell the same as tokens of any tokenizer: 3.5 of them for each.
@query(f"SELECT doc_id FROM documents WHERE octet_length(encode(text)) > 3.5 * {packing.CAPACITY}")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut because their text alone exceeds a container."""
    return p6_containers(spark, d).where("piece = 1").select("doc_id").distinct()


@query()
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them, and the share of their room that is used."""
    full = F.countDistinct("container") * packing.CAPACITY
    return p6_containers(spark, d).agg(
        F.countDistinct("container").alias("n_containers"), F.sum("size").alias("n_tokens"), (F.sum("size") / F.when(full > 0, full)).alias("fill")
    )


# ---- 7: mixing sources


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    docs = _sizes(spark, d, plain_name(F.col("source")).alias("source")).select(F.col("doc_id").alias("id"), "source", F.col("n_tokens").alias("n"))
    return mixing.Mixture(docs, table(spark, d, "mix_target"))


# Sizes leave room, so that shares of bytes tell the same as shares of tokens.
@query("""WITH sizes AS (SELECT nullif(regexp_replace(regexp_replace(lower(source), '^[\\s_-]+|[\\s_-]+$', '', 'g'), '[\\s_-]+', '-', 'g'), '') AS source, octet_length(encode(text)) AS n FROM documents),
sums AS (SELECT source, sum(n) AS s FROM sizes WHERE source IS NOT NULL GROUP BY source), total AS (SELECT sum(s) AS t FROM sums)
SELECT m.source, CASE WHEN target_share * t <= coalesce(s, 0) THEN 'once' WHEN target_share * t <= max_repeats * coalesce(s, 0) THEN 'repeated' ELSE 'short' END AS standing
FROM mix_target m LEFT JOIN sums USING (source), total""")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source's share is reached once over, with repeats, or not."""
    return _mixture(spark, d).report().select("source", "standing")


@query()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares, tokens and rounds of each source."""
    return _mixture(spark, d).report()


@query()
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix by slot."""
    return _mixture(spark, d).mix().withColumnRenamed("id", "doc_id")


# ---- 8: abusive, hateful or sexual content


@query()
def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document, and whether it counts as toxic."""
    documents = table(spark, d, "documents")
    return toxicity.score(spread(documents.select("doc_id", "source", "text")), toxicity.train(spark, documents, table(spark, d, "doc_label")))


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with at least one toxic passage."""
    return p8_scores(spark, d).where("is_toxic").select("doc_id").distinct()


@query()
def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, toxic documents, their rate and the mean score of each source."""
    return (
        p8_scores(spark, d)
        .groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.count_if("is_toxic").alias("n_toxic"), F.avg(F.col("is_toxic").cast("double")).alias("toxic_rate"), F.avg("score").alias("mean_score"))
    )

import os

import duckdb
import pytest

from sievekit.llm import queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "p2_found": ["row_id"], "p3_found": ["row_id", "table_name"], "p4_found": ["digest"], "p5_found": ["field_name", "row_id_1", "row_id_2"],
    "p6_found": ["doc_id"], "p7_found": ["source", "standing"], "p8_found": ["doc_id"],
}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    rows = queries.QUERIES[name](spark, DATA)
    cols = sorted(rows.columns)
    out = [tuple(r[c] for c in cols) for r in rows.collect()]
    if name in COLUMNS:
        assert cols == COLUMNS[name] and len(out) == len(set(out))
    if name in queries.SQL:
        con = duckdb.connect()
        for f in os.listdir(DATA):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
        got = con.execute(queries.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols and sorted(map(str, out)) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in got.fetchall())
    else:
        assert out


def test_rows_without_batch_are_judged_last(spark, tmp_path):
    md5 = lambda k: f"{k:032x}"
    rows = [(1, None, "md5", md5(1)), (2, 0, "md5", md5(1)), (3, 1, "md5", md5(2)), (4, None, "md5", md5(2)), (5, None, "md5", md5(3)), (6, 1, "md5", md5(9)), (7, None, "md5", None)]
    spark.createDataFrame(rows, "row_id long, batch_no int, algo string, digest string").write.parquet(f"{tmp_path}/digest_result.parquet")
    spark.createDataFrame([(1, None, "md5", md5(3))], "row_id long, batch_no int, algo string, digest string").write.parquet(f"{tmp_path}/symhash_result.parquet")
    spark.createDataFrame([("regular", "md5", md5(9))], "scan_mode string, algo string, digest string").write.parquet(f"{tmp_path}/known_digest.parquet")
    found = {tuple(r) for r in queries.p3_found(spark, str(tmp_path)).select("table_name", "row_id").collect()}
    assert found == {("digest_result", k) for k in (1, 4, 6)}
    got = {(r.table_name, r.batch_no, r.status): r.n_rows for r in queries.p3_batches(spark, str(tmp_path)).collect()}
    of = lambda b, status: ("digest_result", b, status)
    assert got == {of(0, "new"): 1, of(1, "new"): 1, of(1, "equal"): 1, of(None, "equal"): 2, of(None, "new"): 1, ("symhash_result", None, "new"): 1}

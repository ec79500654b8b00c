"""Some registered queries against their SQL; the driver holds all of them."""

import glob
import os

import duckdb
import pytest

from bitloom.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["runs_rowwise", "len_bits_bigram", "kt_order1_bits", "roc_auc", "weighted_bbp", "name_parse", "cdf_quantised"])
def test_query_matches_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_every_query_has_sql_or_needs_python():
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE_SQL) == {"ppm_bits", "codec_sizes", "residual_codec", "codec_tile_sizes", "arith_roundtrip"}


@pytest.mark.parametrize(("name", "key", "whole"), [("row_locate_all", "row_idx", "SELECT count(*) FROM embeddings"), ("lm_cv_merge_all", "pair_id", "SELECT count(*) FROM orders")])
def test_every_row_and_order_is_in_the_result(spark, name, key, whole):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    test_query_matches_sql(spark, name)
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert QUERIES[name](spark, DATA).select(key).distinct().count() == con.execute(whole).fetchone()[0]


@pytest.mark.parametrize("name", ["row_cache", "rle_stream_bytes", "packed_bits", "bos_rows", "tile_heat_grid", "split_sizes", "topk_index", "length_nll", "rectangle_sums", "metrics_summary"])
def test_further_query_matches_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    from bitloom.plans import extended

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(extended.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = extended.QUERIES[name](spark, DATA)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, rows.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_frames_of_more_than_six_digits_are_whole(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT unnest([0, 7, 999999, 1000000, 1234567, 2147483647]) AS p_partkey")
    con.execute(f"COPY part TO '{tmp_path}/part.parquet'")
    want = con.execute(ORACLE_SQL["name_parse"])
    columns = [c[0] for c in want.description]
    got = QUERIES["name_parse"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("nulls", [False, True])
def test_heat_of_a_repeated_place_is_the_first_rows(spark, tmp_path, nulls):
    from bitloom.plans import extended

    con = duckdb.connect()
    con.execute("SET threads = 1")
    os.mkdir(tmp_path / "lineitem.parquet")
    # places repeat within files and between them; the largest file is last, and Spark reads it first
    for n, (file, size) in enumerate({"a": 6000, "b": 9000, "c": 60000}.items()):
        heat = f"CASE WHEN {nulls} AND i % 1000 = 21 THEN NULL ELSE {n} * 100000 + i END"
        passed = "UNION ALL SELECT 100, 0, 0, 1, NULL UNION ALL SELECT NULL, 1, 1, 1, 5.0" if nulls else ""
        con.execute(f"COPY (SELECT i % 40 AS l_orderkey, i // 40 % 6 AS l_partkey, i // 240 % 5 AS l_suppkey, 1 AS l_linenumber, CAST({heat} AS DOUBLE) AS l_quantity FROM range({size}) r(i) {passed}) TO '{tmp_path}/lineitem.parquet/{file}.parquet'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(extended.ORACLE_SQL["tile_heat_grid"])
    columns = [c[0] for c in want.description]
    rows = sorted(map(tuple, extended.QUERIES["tile_heat_grid"](spark, str(tmp_path)).select(*columns).collect()))
    assert rows == sorted(want.fetchall())
    assert max(heat for *_, heat in rows) < 6000

"""Every registered query of the log against its SQL."""

import pytest

from ledgerloom.queries import QUERIES, SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, QUERIES[name], SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["seal_boundaries", "blob_roundtrip", "wire_roundtrip", "stream_depth_late_data"])
def test_whole_table_queries_have_every_height(spark, name):
    """sf0.01 ends with a complete range, so all of its 15 ranges are packed too."""
    sf_dir = "/root/testdata/sf0.01"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count() == 15_000


def test_balance_counts_more_addresses_than_a_request_may_list(spark, tmp_path):
    ids = spark.range(1, 31_001)
    ids.selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    ids.where("id > 30000").selectExpr("id AS o_orderkey", "id AS o_custkey", "IF(id % 2 = 0, 'F', 'O') AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    assert_same(spark, str(tmp_path), QUERIES["address_balance_distinct"], SQL["address_balance_distinct"])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def _blocks_move_once(df):
    """Line items and orders go through one exchange, and nothing is hashed below it."""
    lines = _plan(df)
    moved = [k for k, x in enumerate(lines) if "REPARTITION_BY_COL" in x]
    assert len(moved) == 1 and not any("sha2(" in x for x in lines[moved[0] :])
    return lines


@pytest.mark.parametrize("name", ["additions", "block_nullifiers", "drop_empty_tx", "encoded_size_bound", "mempool_compact", "pool_projection_ironwood", "pool_projection_orchard", "pool_projection_sapling"])
def test_nested_blocks_move_once_and_without_hashes(spark, sf_dir, name):
    lines = _blocks_move_once(QUERIES[name](spark, sf_dir))
    assert sum("Exchange" in x for x in lines) == 1


@pytest.mark.parametrize("name", ["blob_roundtrip", "wire_roundtrip"])
def test_round_trips_move_blocks_once_and_without_hashes(spark, sf_dir, name):
    _blocks_move_once(QUERIES[name](spark, sf_dir))


def test_blocks_of_odd_tables(spark, tmp_path):
    """Line items without an order or a line number, orders without items or a date, and an order that stands twice."""
    from ledgerloom.plans import derive

    orders = [(0, None), (1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")]
    spark.createDataFrame(orders, "o_orderkey bigint, o_orderdate string").selectExpr("o_orderkey", "CAST(o_orderdate AS TIMESTAMP) AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    shape = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    line = lambda height, tx, flag: (height, 1, 1, tx, 1.0, 1.0, 0.0, 0.0, flag, "O", None)
    spark.createDataFrame([line(1, 1, "A"), line(1, 1, "N"), line(1, None, "R"), line(7, 1, "A")], shape).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = sorted((r.height, r.time is None, [(t["index"], len(t.outputs), len(t.actions), len(t.ironwood_actions)) for t in r.vtx]) for r in derive.nested_blocks(spark, str(tmp_path)).collect())
    full = [(None, 0, 0, 1), (1, 1, 1, 0)]
    assert found == [(0, True, []), (1, False, full), (1, False, full), (2, False, [])]

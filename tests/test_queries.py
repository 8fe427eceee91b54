"""Every registered query of the library against its SQL on the smallest tables."""

import pytest

from kairoflow.plans import ORACLES, QUERIES
from tests.conftest import rows_of


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    mine = QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(ORACLES[name]).fetchdf()
    assert rows_of(mine) == rows_of(theirs)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Tables whose user ids and customers overlap in part."""
    from pyspark.sql import functions as F

    top = str(tmp_path_factory.mktemp("wide"))
    events = spark.createDataFrame([(k, f"2024-01-{1 + k % 9:02d} 00:00:00", 35 + k % 10, "abc"[k % 7 % 3], float(k % 5)) for k in range(60)], "event_id long, ts string, user_id long, event_type string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{top}/events.parquet")
    orders = spark.createDataFrame([(k, 35 + k % 12, "2024-01-02", "OF"[k % 2], 1.0, "1-URGENT") for k in range(48)], "o_orderkey long, o_custkey long, o_orderdate string, o_orderstatus string, o_totalprice double, o_orderpriority string")
    orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).write.parquet(f"{top}/orders.parquet")
    spark.createDataFrame([(k, "BUILDING", 0.5 * k, k % 3) for k in range(35, 47)], "c_custkey long, c_mktsegment string, c_acctbal double, c_nationkey long").write.parquet(f"{top}/customer.parquet")
    return top


@pytest.mark.parametrize("name", ["dist_edit", "dist_linear", "dist_l2", "dist_combined", "dist_lcp", "dist_chi2", "dist_lcs", "dist_dtw", "dist_softdtw"])
def test_pairs_of_all_ids(spark, wide, name):
    got = {(r.id_a, r.id_b) for r in QUERIES[name](spark, wide).collect()}
    assert got == {(a, b) for a in range(35, 45) for b in range(a + 1, 45)}


@pytest.mark.parametrize("name", ["dist_static", "dist_aggregation"])
def test_pairs_of_all_customers(spark, wide, name):
    got = {(r.id_a, r.id_b) for r in QUERIES[name](spark, wide).collect()}
    assert got == {(a, b) for a in range(35, 47) for b in range(a + 1, 47)}


@pytest.mark.parametrize("name", ["cluster_pam", "cluster_hierarchical", "cluster_clara"])
def test_labels_of_all_ids(spark, wide, name):
    assert {r.id for r in QUERIES[name](spark, wide).collect()} == set(range(35, 45))


def test_extend_with_all_ids(spark, wide):
    rows = QUERIES["extend_skip"](spark, wide).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in rows} == {k: 6 for k in range(35, 45)} | {45: 4, 46: 4}


def test_rounding_is_that_of_decimals(spark):
    """Distances are rounded as ``round`` does, halves, zeros and what is not a number included."""
    import math
    import random

    from pyspark.sql import functions as F

    from kairoflow.plans.queries import _rounded

    draw = random.Random(4)
    values = [0.0, 0.0078125, 0.1234565, 0.0000005, 2.5e-7, 1 / 3, 1e12 / 7, 8123.4567895, math.nan, math.inf, None] + [draw.random() * 10 ** draw.randint(-8, 9) for _ in range(3000)] + [k / 2_000_000 for k in range(999)]
    frame = spark.createDataFrame([(v,) for v in values], "distance double")
    for digits in (6, 9):
        assert frame.where(~_rounded("distance", digits).eqNullSafe(F.round("distance", digits))).count() == 0

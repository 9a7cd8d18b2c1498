"""Worlds packed into rows say what their listed cells say, with one exchange; top lists break ties as they are shown."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import belief, dense, verify
from plumbline.plans import worlds as w
from plumbline.plans.catalog import QUERIES, r

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def near(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-12) for k in a)


def test_packed_covariances_are_the_listed_ones(spark):
    l = w.lines(spark, SF).filter("world < 100")
    cov = w.prior(l)[1]
    p = belief.once(w.packed(l), "world", rows=w.packed_net_rows(), cov=w.packed_prior())
    got = belief.packed_pushforward(p).select("world", F.explode("cov").alias("s")).select("world", "s.*").collect()
    assert near({(x.world, x.i, x.k): x.v for x in got}, {(x.world, x.r, x.r2): x.v for x in belief.pushforward(w.net_rows(l), cov).collect()})
    t = belief.once(w.packed(l), "world", rows=w.packed_total_rows(), cov=w.packed_prior())
    mine = {x.world: x.v for x in t.select("world", belief.packed_variances()[0]["v"].alias("v")).collect()}
    assert near(mine, {x.world: x.v for x in belief.pushforward(w.total_rows(l), cov, variances_only=True).collect()})


def test_packed_forms_take_correlated_variables(spark):
    cell = "array(named_struct('i', 'a', 'k', 'a', 'v', 1D), named_struct('i', 'a', 'k', 'b', 'v', 0.5D), named_struct('i', 'b', 'k', 'a', 'v', 0.5D), named_struct('i', 'b', 'k', 'b', 'v', 4D))"
    worlds = spark.sql(f"SELECT 1L AS world, array(named_struct('r', 'x', 'g', map('a', 2D, 'b', 3D)), named_struct('r', 'y', 'g', map('b', 1D))) AS rows, {cell} AS cov")
    got = belief.packed_pushforward(worlds).first().cov
    assert [(x.i, x.k, x.v) for x in got] == [("x", "x", 46.0), ("x", "y", 13.0), ("y", "x", 13.0), ("y", "y", 4.0)]


def test_sums_carry_what_is_rounded_off(spark):
    assert spark.range(1).select(belief.total(F.array(*(F.lit(x) for x in (1e16, 1.0, 1.0, -1e16)))).alias("s")).first().s == 2.0


@pytest.mark.parametrize("name", ["pushforward_total", "incremental_pushforward", "incremental_changed", "gauss01", "gauss01_faults", "stability", "observability"])
def test_packed_queries_sort_and_deal_no_cells(spark, no_broadcast, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and sum("Exchange hashpartitioning" in x and "l_orderkey" in x for x in plan.split("\n")) == 1


def test_asymmetries_of_packed_worlds(spark):
    cells = [(1, "a", "b", 1.0), (1, "b", "a", 1.5), (1, "b", "c", 2.0), (1, "d", "c", 3.0), (1, "a", "a", 1.0), (2, "a", "b", 1.0), (2, "b", "a", 1.0)]
    cov = spark.createDataFrame(cells, "world long, i string, k string, v double")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    packed = cov.groupBy("world").agg(F.collect_list(F.struct("i", "k", "v")).alias("cov"))
    assert rows(verify.packed_gauss_01(packed)) == rows(verify.gauss_01(cov))


def test_small_cells_are_spread_over_tasks(spark):
    cov = spark.range(64).select(F.col("id").alias("world"), F.lit("a").alias("i"), F.lit("a").alias("k"), F.lit(1.0).alias("v"))
    assert dense.psd(cov).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_draws_of_one_variable_do_not_meet_in_one_task(spark, no_broadcast):
    plan = QUERIES["sample_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ties_of_shown_correlations_follow_by_world(spark):
    cells = [(world, i, k, v) for world, v in ((1, 0.5), (2, 0.5 + 1e-12)) for i, k, v in (("a", "a", 1.0), ("b", "b", 1.0), ("a", "b", v), ("b", "a", v))]
    cov = spark.createDataFrame(cells, "world long, i string, k string, v double")
    assert [x.world for x in belief.top_correlations(cov, 1, 0.2, lambda c: r(c, 6)).collect()] == [1]
    assert [x.world for x in belief.top_correlations(cov, 1, 0.2).collect()] == [2]

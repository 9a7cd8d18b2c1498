"""Pairs of boxes are dealt over all tasks, and their primitives are neither listed nor sorted."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import clash, geometry
from plumbline.plans import worlds as w
from plumbline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_clashes_list_no_primitives(spark):
    plan = QUERIES["clash_full"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" in plan


def test_small_tables_of_boxes_are_spread(spark):
    assert geometry.near_pairs(w.boxes(spark, SF), 0.2, 1.0).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_primitives_without_an_inverse_count_for_nothing(spark):
    tile = lambda x, v: (x, 0.0, 0.0, 1.0, v, 0.0, 0.0, 1.0, 0.0, 1.0)
    kind = "array<struct<px:double,py:double,pz:double,w:double,cxx:double,cxy:double,cxz:double,cyy:double,cyz:double,czz:double>>"
    cases = [(0, [tile(0.0, 0.0), tile(9.0, 1.0)], [tile(1.0, 0.0)]), (1, [tile(0.0, 0.0)], [tile(1.0, 0.0)]), (2, None, [tile(1.0, 1.0)]), (3, [tile(0.0, 1.0), tile(2.0, 1.0)], [tile(1.0, 1.0)])]
    df = spark.createDataFrame(cases, f"id long, a {kind}, b {kind}").select("id", F.arrow_udf(clash._touch, clash.TOUCH)("a", "b").alias("t")).select("id", "t.*")
    got = {x.id: x for x in df.collect()}
    mass = lambda m2, det: np.exp(-0.5 * (3 * np.log(2 * np.pi) + np.log(det) + m2))
    assert np.isclose(got[0].overlap, mass(64.0, 4.0)) and got[0].m2 == 64.0 and got[0].wx == 5.0
    assert all(got[k][n] is None for k in (1, 2) for n in ("overlap", "m2", "wx"))
    assert np.isclose(got[3].overlap, 2 * mass(0.5, 8.0)) and got[3].m2 == 0.5 and got[3].wx == 0.5  # of two as near, the first


def test_pairs_too_far_apart_to_be_likely_are_left_out_where_they_meet(spark):
    plan = QUERIES["clash_likely"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.split("\n") if "SortMergeJoin" in x)
    assert "reach_a" in join and "_touch" not in plan
    all_pairs = {(x.a, x.b): x.p for x in QUERIES["clash_full"](spark, SF).collect()}
    assert {(x.a, x.b): x.p for x in QUERIES["clash_likely"](spark, SF).collect()} == {k: p for k, p in all_pairs.items() if p >= 0.5}

"""Reach of plans over packed worlds equals that over tables, and reads the lines once."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from plumbline.operators import evidence
from plumbline.plans import presentable

VARIABLE = "world int, i string, needed boolean, prior double, gain double, noise double"


def packed(df):
    return df.groupBy("world").agg(F.collect_list(F.struct("needed", "prior", "gain", "noise")).alias("variables"))


def test_packed_coverage_is_that_of_tables(spark):
    pick = random.Random(4)
    cells = [(w, f"v{k}", pick.random() < 0.8, pick.choice((4.0, 1e-3)), pick.choice((None, None, 2.0, 1e9, 1e-12)), pick.choice((None, 0.5, 1e11, 1e-12))) for w in range(40) for k in range(pick.randint(1, 6))]
    v = spark.createDataFrame(cells, VARIABLE)
    jac = v.select("world", F.lit("t").alias("r"), F.col("i").alias("c"), F.col("needed").cast("double").alias("v"))
    known = evidence.informed(v.select("world", "i", F.col("prior").alias("v")), v.filter("gain IS NOT NULL").select("world", "i", F.col("i").alias("k"), F.col("gain").alias("v")))
    gains = evidence.rank_gain(v.filter("gain IS NOT NULL").select("world", F.col("gain").alias("v")), v.filter("noise IS NOT NULL").select("world", "i", "noise"))
    told = evidence.coverage(jac, known, jac.select("world", "r").distinct(), gains)
    got = evidence.packed_coverage(packed(v))
    assert rows(got) == rows(told) and got.schema.simpleString() == told.schema.simpleString()
    assert any(r.reached for r in got.collect()) and any(r.uncovered for r in got.collect())


def test_a_variance_must_be_positive(spark):
    with pytest.raises(Exception, match="positive"):
        evidence.packed_coverage(packed(spark.createDataFrame([(1, "a", True, 4.0, None, 0.0)], VARIABLE))).collect()


def test_lines_are_read_once(spark):
    plan = presentable.plan_reach(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2

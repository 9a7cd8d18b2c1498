"""Process steps and correlations of packed worlds say what the listed ones say, with one exchange of the lines."""

import math

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import belief
from plumbline.plans.catalog import QUERIES

SF, NAMES = "/root/testdata/sf0.001", "abcd"


@pytest.fixture(scope="module")
def case(spark):
    rng, mean, cov = np.random.default_rng(4), [], []
    for world in range(6):
        a = rng.normal(size=(4, 4))
        s = a @ a.T
        mean += [(world, n, float(rng.normal())) for n in NAMES]
        cov += [(world, NAMES[i], NAMES[k], float(s[i, k])) for i in range(4) for k in range(4)]
    return spark.createDataFrame(mean, "world long, i string, mu double"), spark.createDataFrame(cov, "world long, i string, k string, v double")


def near(a, b):
    return a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9, abs_tol=1e-12) for k in a)


def test_steps_of_packed_worlds_are_the_listed_ones(spark, case):
    mean, cov = case
    t = [(w, i, j, f) for w in range(5) for i, j, f in (("a", "a", 0.5), ("a", "b", 2.0), ("c", "a", -1.0))]  # the last world has none
    transition = spark.createDataFrame(t, "world long, i string, j string, f double")
    offset = spark.createDataFrame([(w, i, 0.25) for w in range(6) for i in "ad"], "world long, i string, b double")
    noise = spark.createDataFrame([(w, i, k, 0.1) for w in range(5) for i, k in ("aa", "ac", "ca", "dd")], "world long, i string, k string, q double")
    m, c = belief.evolve(mean, cov, transition, offset, noise)
    want = {(x.world, x.i): x.mu for x in m.collect()}, {(x.world, x.i, x.k): x.v for x in c.collect()}
    put = lambda df, name: df.groupBy("world").agg(F.collect_list(F.struct(*df.columns[1:])).alias(name))
    p = put(mean, "mean").join(put(cov, "cov"), "world")
    for df, name in ((transition, "transition"), (offset, "offset"), (noise, "noise")):
        p = p.join(put(df, name), "world", "left").withColumn(name, F.coalesce(name, F.array().cast(put(df, name).schema[name].dataType)))
    got = belief.packed_evolve(p).collect()
    assert near({(x.world, y.i): y.mu for x in got for y in x.mean}, want[0])
    assert sum(len(x["cov"]) for x in got) == len(want[1]) and near({(x.world, y.i, y.k): y.v for x in got for y in x["cov"]}, want[1])


def test_correlations_of_packed_worlds_are_the_listed_ones(spark, case):
    cov = case[1].unionByName(spark.createDataFrame([(9, i, k, 0.0) for i in "ab" for k in "ab"], case[1].schema))
    packed = cov.groupBy("world").agg(F.collect_list(F.struct("i", "k", "v")).alias("cov"))
    for floor in (0.0, 0.3):
        of = lambda df: {(x.world, x.i, x.k): x["corr"] for x in df.collect()}
        assert near(of(belief.packed_correlations(packed, floor)), of(belief.correlations(cov, floor)))


def test_a_forecast_is_its_steps_in_turn(spark, case):
    mean, cov = case
    targets = spark.createDataFrame([(w, i, 0.5 + w, 1.0, 0.01, 60.0) for w in range(5) for i in "ac"], "world long, i string, factor double, offset double, noise double, seconds double")
    want = {}
    for n in (1, 2, 3):
        mean, cov = (df.localCheckpoint() for df in session._evolve(mean, cov, targets.drop("seconds")))
        v = {(x.world, x.i): x.v for x in cov.filter("i = k").collect()}
        want |= {(x.world, x.i, n): (x.mu, math.sqrt(v[x.world, x.i])) for x in mean.filter("world < 5 AND i IN ('a', 'c')").collect()}
    got = session.forecast(*case, targets, 3).collect()
    assert len(got) == 30 and all(np.allclose((x.mu, x.sd), want[x.world, x.i, x.step]) and x.elapsed == 60 * x.step for x in got)
    with pytest.raises(Exception, match="must not be negative"):
        session.forecast(*case, targets.withColumn("noise", F.lit(-1.0)), 1).collect()


@pytest.mark.parametrize("name", ["forecast_process", "evolve_linear", "cov_pairs_topk"])
def test_lines_are_dealt_once_and_joined_with_nothing(spark, name):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = QUERIES[name](spark, SF)
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set(key, before)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert rows(df.limit(1))

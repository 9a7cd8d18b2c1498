"""Tables dealt by world stay where they lie, and dense kernels take many worlds at once."""

import numpy as np
import pytest

from plumbline.operators import belief, dense
from plumbline.plans import worlds as w
from plumbline.plans.catalog import QUERIES


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_variances_share_the_one_exchange_of_the_lines(spark, no_broadcast, monkeypatch):
    plans = []

    def kept(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return df

    monkeypatch.setattr(belief, "stored", kept)
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true")
    QUERIES["pushforward_variance"](spark, "/root/testdata/sf0.001")
    made = [x for x in plans[0].split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert len(made) == 1 and "l_orderkey" in made[0]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true") == before


def test_kernels_take_worlds_of_several_sizes(spark):
    rng = np.random.default_rng(1)
    cells, right, want, tops = [], [], {}, {}
    for world in range(30):
        n = 1 + world % 3
        a = rng.standard_normal((n, n))
        m, y = a @ a.T + np.eye(n), rng.standard_normal(n)
        cells += [(world, f"v{i}", f"v{k}", float(m[i, k])) for i in range(n) for k in range(n)]
        right += [(world, f"v{i}", float(y[i])) for i in range(n)] + [(world, "unknown", 1.0)]
        want |= {(world, f"v{i}"): x for i, x in enumerate(np.linalg.solve(m, y))}
        tops[world] = np.linalg.svd(m, compute_uv=False)[0]
    cov = spark.createDataFrame(cells, "world long, i string, k string, v double")
    got = {(r.world, r.i): r.x for r in dense.solve(cov, spark.createDataFrame(right, "world long, i string, y double")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(abs(r.largest - tops[r.world]) < 1e-9 for r in dense.stability(cov).collect())
    assert {(r.world, r.n, r.psd) for r in dense.psd(cov).collect()} == {(x, 1 + x % 3, True) for x in range(30)}


def test_observability_of_a_measurement_is_that_of_its_posterior(spark):
    l = w.lines(spark, "/root/testdata/sf0.001").filter("world < 200")
    mean, cov = w.prior(l)
    row = w.total_rows(l).selectExpr("world", "c AS i", "v AS h")
    seen = w.totals(l).selectExpr("world", "total + 1 AS y", "total AS predicted", "1e4D AS noise")
    listed = dense.observability(cov, belief.condition(mean, cov, row, seen)[1])
    assert sorted(map(tuple, listed.collect())) == sorted(map(tuple, dense.observability_of(cov, row, seen.select("world", "noise")).collect()))


def test_clashes_shuffle_boxes_not_pairs(spark, no_broadcast):
    plans = [QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for q in ("clash_score", "clash_full")]
    assert all(p.count("Exchange hashpartitioning") <= 2 and "rangepartitioning" not in p for p in plans)

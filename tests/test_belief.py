import numpy as np
import pytest
from helpers import rows

from plumbline.functions.expr import Expr, const, mean, scaled_sum, var
from plumbline.functions.numeric import chi2_sf_3_sql, erf_sql, normal_cdf
from plumbline.operators import belief, dense
from pyspark.sql import functions as F


def tables(spark, mu, sigma):
    n = len(mu)
    m = spark.createDataFrame([(1, str(i), float(mu[i])) for i in range(n)], "world long, i string, mu double")
    c = spark.createDataFrame([(1, str(i), str(k), float(sigma[i, k])) for i in range(n) for k in range(n)], "world long, i string, k string, v double")
    return m, c


def arrays(m, c, n):
    mu, s = np.zeros(n), np.zeros((n, n))
    for r in m.collect():
        mu[int(r.i)] = r.mu
    for r in c.collect():
        s[int(r.i), int(r.k)] += r.v
    return mu, s


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(4, 4))
    return rng.normal(size=4), a @ a.T + np.eye(4)


def test_batch_update_equals_scalar_updates(spark, world):
    mu, sigma = world
    h = np.random.default_rng(1).normal(size=(2, 4))
    y, p0, noise = np.array([1.0, -2.0]), np.array([0.3, 0.1]), np.array([0.5, 0.2])
    m, c = tables(spark, mu, sigma)
    row = lambda k: spark.createDataFrame([(1, str(i), float(h[k, i])) for i in range(4)], "world long, i string, h double")
    seen = lambda k: spark.createDataFrame([(1, float(y[k]), float(p0[k]), float(noise[k]))], "world long, y double, predicted double, noise double")
    got = arrays(*belief.condition_all(m, c, [row(0), row(1)], [seen(0), seen(1)]), 4)
    s = h @ sigma @ h.T + np.diag(noise)
    k = sigma @ h.T @ np.linalg.inv(s)
    assert np.allclose(got[0], mu + k @ (y - p0)) and np.allclose(got[1], sigma - k @ h @ sigma)


def test_a_redundant_exact_observation_is_an_error(spark):
    m, c = tables(spark, np.zeros(1), np.zeros((1, 1)))
    row = spark.createDataFrame([(1, "0", 1.0)], "world long, i string, h double")
    seen = spark.createDataFrame([(1, 1.0, 0.0, 0.0)], "world long, y double, predicted double, noise double")
    with pytest.raises(Exception, match="redundant"):
        belief.condition(m, c, row, seen)[0].collect()


def test_interventions(spark, world):
    mu, sigma = world
    m, c = tables(spark, mu, sigma)
    t = lambda **v: spark.createDataFrame([(1, "2", *v.values())], "world long, i string, " + ", ".join(f"{k} double" for k in v))
    f = np.diag([1, 1, 3.0, 1])
    got = arrays(*belief.scale_parameter(m, c, t(factor=3.0)), 4)
    assert np.allclose(got[0], f @ mu) and np.allclose(got[1], f @ sigma @ f)
    got = arrays(*belief.set_parameter(m, c, t(value=9.0, sigma=0.5)), 4)
    want = sigma.copy()
    want[2], want[:, 2] = 0, 0
    want[2, 2] = 0.25
    assert got[0][2] == 9.0 and np.allclose(got[1], want)
    got = arrays(*belief.shift_parameter(m, c, t(delta=-1.0)), 4)
    assert np.isclose(got[0][2], mu[2] - 1) and np.allclose(got[1], sigma)


def test_pushforward_and_attribution(spark, world):
    mu, sigma = world
    _, c = tables(spark, mu, sigma)
    j = np.random.default_rng(2).normal(size=(3, 4))
    jac = spark.createDataFrame([(1, f"r{r}", str(i), float(j[r, i])) for r in range(3) for i in range(4)], "world long, r string, c string, v double")
    full = j @ sigma @ j.T
    got = {(r.r, r.r2): r.v for r in belief.pushforward(jac, c).collect()}
    assert all(np.isclose(got[f"r{a}", f"r{b}"], full[a, b]) for a in range(3) for b in range(3))
    share = belief.variance_attribution(jac, c).groupBy("r").agg(F.sum("share").alias("s")).collect()
    assert all(np.isclose(r.s, 1) for r in share)


def test_evolve(spark, world):
    mu, sigma = world
    m, c = tables(spark, mu, sigma)
    tr = spark.createDataFrame([(1, "0", "0", 0.5), (1, "0", "1", 0.25)], "world long, i string, j string, f double")
    off = spark.createDataFrame([(1, "0", 2.0)], "world long, i string, b double")
    q = spark.createDataFrame([(1, "0", "0", 0.1)], "world long, i string, k string, q double")
    f = np.eye(4)
    f[0, :2] = 0.5, 0.25
    got = arrays(*belief.evolve(m, c, tr, off, q), 4)
    noise = np.zeros((4, 4))
    noise[0, 0] = 0.1
    assert np.allclose(got[0], f @ mu + [2, 0, 0, 0]) and np.allclose(got[1], f @ sigma @ f.T + noise)


def test_binding_orders_raw_first_and_rejects_tiny_spreads(spark):
    schema = "world long, ifc_class string, global_id string, quantity string, role string, prior_mu double, prior_sigma double"
    s = spark.createDataFrame([(1, "B", "1", "Area", "DERIVED", None, None), (1, "B", "1", "W", "RAW", 1.0, 0.1), (1, "A", "9", "W", "RAW", 2.0, 0.1)], schema)
    index, mean_, cov = belief.bind(s)
    assert [(r.ifc_class, r.role, r.i) for r in index.orderBy("i").collect()] == [("A", "RAW", 0), ("B", "RAW", 1), ("B", "DERIVED", 2)]
    assert rows(mean_.select("i", "mu")) == [(0, 2.0), (1, 1.0)]
    bad = s.withColumn("prior_sigma", F.lit(1e-9))
    with pytest.raises(Exception, match="too small"):
        belief.bind(bad)[1].crossJoin(belief.bind(bad)[2]).collect()


def test_total_jacobian_follows_the_chain(spark):
    raw = spark.createDataFrame([(1, "a"), (1, "b")], "world long, i string")
    p = spark.createDataFrame([(1, "x", "a", 2.0, 1), (1, "x", "b", 3.0, 1), (1, "y", "x", 5.0, 2), (1, "y", "a", 1.0, 2)], "world long, child string, parent string, v double, level int")
    got = {(r.r, r.c): r.v for r in belief.total_jacobian(raw, p, 2).collect()}
    assert got["y", "a"] == 11.0 and got["y", "b"] == 15.0


def test_expressions_differentiate_and_round_trip():
    e = scaled_sum([(2.0, var("a") * var("b")), (-1.0, mean(var("a"), const(3.0)))], 1.0) - -var("b")
    assert Expr.from_json(e.to_json()) == e and e.variables() == ["a", "b"]
    at = lambda x, a, b: eval(x.sql(), {}, {"a": a, "b": b})  # noqa: S307, E731
    h = 1e-6
    assert np.isclose(at(e.partial("a"), 2.0, 5.0), (at(e, 2 + h, 5.0) - at(e, 2 - h, 5.0)) / (2 * h))
    assert at(scaled_sum([], 4.0), 0, 0) == 4.0
    with pytest.raises(ValueError):
        Expr("mean")
    with pytest.raises(ValueError, match="unknown fields"):
        Expr.from_json('{"op":"var","value":"a","x":1}')


def test_normal_cdf(spark):
    import math

    xs = [x / 8 for x in range(-80, 81)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p"), F.expr(erf_sql("x")).alias("e"), F.expr(chi2_sf_3_sql("x")).alias("c"))
    for r in df.collect():
        assert abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-15 and abs(r.e - math.erf(r.x)) < 1e-14
    assert abs(df.filter("x = 2").first().c - 0.5724067044708798) < 1e-12


def test_psd_and_stability(spark):
    good = np.array([[2.0, 1.0], [1.0, 2.0]])
    bad = np.array([[1.0, 3.0], [3.0, 1.0]])
    df = spark.createDataFrame([(w, str(i), str(k), float(m[i, k])) for w, m in ((1, good), (2, bad)) for i in range(2) for k in range(2)], "world long, i string, k string, v double")
    assert {r.world: r.psd for r in dense.psd(df).collect()} == {1: True, 2: False}
    assert {r.world: r.kind for r in dense.stability(df).collect()} == {1: "amplifying", 2: "amplifying"}


def test_registration_finds_the_shift(spark):
    rng = np.random.default_rng(3)
    q = rng.uniform(-1, 1, (30, 3))
    yaw = 0.3
    rot = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
    x = (q - [0.4, -0.2, 0.1]) @ rot
    model = spark.createDataFrame([(*map(float, p), 1.0) for p in q], "px double, py double, pz double, w double")
    points = spark.createDataFrame([(1, *map(float, p)) for p in x], "scan long, x double, y double, z double")
    r = dense.register(points, model).first()
    assert abs(r.yaw - yaw) < 1e-3 and abs(r.dx - 0.4) < 1e-2 and abs(r.dy + 0.2) < 1e-2


def test_factor_and_its_shifts():
    """Definite, singular and slightly indefinite matrices take the least shift that their eigenvalues ask for."""
    from plumbline.operators import dense

    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 5))
    turn = np.linalg.qr(a)[0]
    low, shift = dense.factor(a @ a.T)
    assert shift == 0 and np.allclose(low @ low.T, a @ a.T) and np.allclose(low, np.tril(low))
    for least, want in ((0.0, 1e-12), (-5e-13, 1e-12), (-5e-11, 1e-10)):
        m = turn @ np.diag([1.0, 1.0, 1.0, 1.0, least]) @ turn.T
        low, shift = dense.factor(m)
        assert shift == want and np.allclose(low @ low.T, m, atol=1e-8)
    with pytest.raises(np.linalg.LinAlgError):
        dense.factor(turn @ np.diag([1.0, 1.0, 1.0, 1.0, -1e-3]) @ turn.T)
    with pytest.raises(ValueError, match="finite"):
        dense.factor(np.array([[np.nan]]))

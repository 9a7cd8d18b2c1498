"""Registration against a dense NumPy mixture, and poses that are known."""

import math

import numpy as np
import pytest

from plumbline.operators import registration as reg

RNG = np.random.default_rng(8)


def scene(n=60):
    """An L of two walls with a pillar, as primitives of three elements."""
    out = []
    for k in range(n):
        e = k % 3
        x, y = (k / n * 4, 0.0) if e == 0 else (0.0, k / n * 2) if e == 1 else (2.5 + 0.3 * (k % 2), 1.2)
        out.append((1, k, f"e{e}", x, y, float(RNG.uniform(0, 2)), 0.02, 0.001, 0.0, 0.015, 0.0, 0.03, 1.0 + k % 4))
    return out


def cols():
    return "scene int, k int, element string, px double, py double, pz double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double, w double"


def turned(points, theta, t):
    c, s = math.cos(theta), math.sin(theta)
    return points @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T + t


@pytest.fixture(scope="module")
def case(spark):
    prims = scene()
    means = np.array([p[3:6] for p in prims])
    true = (0.7, np.array([0.4, -0.3, 0.2]))
    seen = means[RNG.integers(0, len(means), 240)] + RNG.normal(0, 0.05, (240, 3))
    local = turned(seen - true[1], -true[0], 0)
    pts = [(5, 1, i, *map(float, x)) for i, x in enumerate(local)] + [(5, 1, 1_000, 50.0, 50.0, 1.0)]  # one far outlier
    return prims, np.array([p[3:] for p in pts]), true, spark.createDataFrame(pts, "scan int, scene int, p int, x double, y double, z double"), spark.createDataFrame(prims, cols())


def dense(prims, points, theta, t, sigma):
    """Responsibilities, Mahalanobis squares and the mean negative log-likelihood, all pairs at once."""
    mu, w = np.array([p[3:6] for p in prims]), np.array([p[12] for p in prims])
    cov = np.array([[[p[6], p[7], p[8]], [p[7], p[9], p[10]], [p[8], p[10], p[11]]] for p in prims]) + sigma**2 * np.eye(3)
    inv = np.linalg.inv(cov)
    d = turned(points, theta, t)[:, None] - mu[None]
    m2 = np.einsum("mki,kij,mkj->mk", d, inv, d)
    dens = 0.95 * w / w.sum() / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov)) * np.exp(-m2 / 2)
    total = dens.sum(1) + 0.05 / np.prod(np.ptp(mu, axis=0) + 2)
    return dens / total[:, None], m2, -np.log(total).mean(), inv, mu


def test_one_round_equals_the_dense_mixture(spark, case):
    prims, local, _, points, model = case
    theta, t = 0.65, np.array([0.35, -0.25, 0.15])
    poses = spark.createDataFrame([(5, 0, theta, *map(float, t))], "scan int, start int, theta double, tx double, ty double, tz double")
    got = reg.expect(points, poses, reg.mixture(model, 0.08), 0.7).first()
    g, _, nll, inv, mu = dense(prims, local, theta, t, 0.08)
    assert np.isclose(got.nll, nll, rtol=1e-9) and got.n == len(local)
    a, b = np.einsum("mk,kij->mij", g, inv), np.einsum("mk,kij,kj->mi", g, inv, mu)
    assert np.allclose([got[f"a{u}"] for u in reg.UPPER], a.sum(0)[np.triu_indices(3)])
    u, v = np.c_[local[:, :2], 0 * local[:, 0]], np.c_[-local[:, 1], local[:, 0], 0 * local[:, 0]]
    assert np.isclose(got.uav, np.einsum("mi,mij,mj->", u, a, v)) and np.isclose(got.vb, (v * b).sum())
    # the step: shift in closed form and a Newton step of the turn for fixed responsibilities
    c, s = math.cos(theta), math.sin(theta)
    rot = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    solve = lambda r: np.linalg.solve(a.sum(0), (b - np.einsum("mij,mj->mi", a, local @ r.T)).sum(0))
    rx, dx = local @ rot.T + solve(rot), local @ np.array([[-s, -c, 0], [c, -s, 0], [0, 0, 0]]).T
    step = -(dx * (np.einsum("mij,mj->mi", a, rx) - b)).sum() / np.einsum("mi,mij,mj->", dx, a, dx)
    from pyspark.sql import functions as F

    made = reg.propose(poses.join(reg.expect(points, poses, reg.mixture(model, 0.08), 0.7), ["scan", "start"]).withColumn("alpha", F.lit(1.0))).first()
    assert np.isclose(made.next, theta + step, atol=1e-9)
    c, s = math.cos(theta + step), math.sin(theta + step)
    assert np.allclose([made.nx, made.ny, made.nz], solve(np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])), atol=1e-8)


def test_pose_is_found_and_elements_are_told(spark, case):
    prims, local, (theta, t), points, model = case
    found = reg.register(points, model, starts=8, rounds=(4, 10, 10)).cache()
    r = found.first()
    assert r.accepted and abs((r.theta - theta + math.pi) % (2 * math.pi) - math.pi) < 0.03 and np.allclose([r.tx, r.ty, r.tz], t, atol=0.05)
    at = np.array([r.tx, r.ty, r.tz])
    g, m2, nll, inv, _ = dense(prims, local, r.theta, at, 0.03)
    assert np.isclose(r.nll, nll, rtol=1e-8) and nll <= dense(prims, local, theta, t, 0.03)[2] + 1e-6
    assert np.allclose(np.array(r.info).reshape(4, 4)[1:, 1:], np.einsum("mk,kij->ij", g, inv))
    assert np.allclose(np.array(r.info).reshape(4, 4), np.array(r.info).reshape(4, 4).T)
    element = np.array([p[2] for p in prims])
    by = {x.element: x for x in reg.evidence(points, found, model).collect()}
    inlier = g.sum(1)
    for e, x in by.items():
        ge = g[:, element == e]
        n = ge.sum()
        assert x.primitives == (element == e).sum() and np.isclose(x.effective_points, n) and np.isclose(x.fraction, n / inlier.sum())
        assert np.isclose(x.mean_m2, (ge * m2[:, element == e]).sum() / n) and np.isclose(x.diversity, n**2 / (x.primitives * (ge.sum(0) ** 2).sum()))
        share = np.divide(ge.sum(1), inlier, out=np.zeros_like(inlier), where=inlier > 0)
        assert np.isclose(x.confidence, (ge.sum(1) * share).sum() / n)


def test_gates(spark, case):
    _, _, _, points, model = case
    with pytest.raises(ValueError, match="too few"):
        reg.register(points.limit(5), model)
    bad = spark.createDataFrame([(5, 0.0, 0.0, 0.0, 0.0, False)], "scan int, theta double, tx double, ty double, tz double, accepted boolean")
    with pytest.raises(Exception, match="fit gate"):
        reg.evidence(points, bad, model).collect()

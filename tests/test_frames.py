"""Frame trees against NumPy: composition, units, correlated errors by finite differences, faults."""

import numpy as np
import pytest

from plumbline.operators import belief, frames

SCHEMA = "world string, frame string, parent string, r array<double>, t array<double>, unit string"


def rotation(v):
    a = np.linalg.norm(v)
    if a == 0:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + np.sin(a) * k + (1 - np.cos(a)) * k @ k


@pytest.fixture(scope="module")
def tree():
    rng = np.random.default_rng(2)
    parents = {"a": None, "b": "a", "c": "b", "d": "b", "e": "d", "f": "e", "g": "a"}
    return {k: (p, np.eye(3) if p is None else rotation(rng.normal(size=3)), np.zeros(3) if p is None else rng.normal(size=3), ["m", "mm", "cm", "ft"][i % 4]) for i, (k, p) in enumerate(parents.items())}


def table(spark, tree, world="w"):
    return spark.createDataFrame([(world, k, p, r.ravel().tolist(), t.tolist(), u) for k, (p, r, t, u) in tree.items()], SCHEMA)


def root(tree, k, moved=None):
    """Pose of a frame in the root; moved: link errors."""
    r, t = np.eye(3), np.zeros(3)
    while k is not None:
        p, rk, tk, _ = tree[k]
        d = (moved or {}).get(k, np.zeros(6))
        rk, tk = rk @ rotation(d[3:]), tk + rk @ d[:3]
        r, t, k = rk @ r, rk @ t + tk, p
    return r, t


def test_points_between_frames(spark, tree):
    poses = frames.to_root(table(spark, tree))
    pts = [("w", f"p{i}", a, [1.0 * i, 2.0, -3.0], b) for i, (a, b) in enumerate([("f", "a"), ("f", "c"), ("a", "g"), ("c", "c")])]
    for x in frames.to_frame(spark.createDataFrame(pts, "world string, id string, frame string, p array<double>, target string"), poses).collect():
        (ra, ta), (rb, tb) = root(tree, x.frame), root(tree, x.target)
        want = rb.T @ (ra @ (np.array(x.p) * frames.UNITS[tree[x.frame][3]]) + ta - tb) / frames.UNITS[tree[x.target][3]]
        assert np.allclose(x.q, want)


def test_joint_errors_equal_finite_differences(spark, tree):
    points = {"p": ("f", np.array([100.0, 200.0, -50.0])), "q": ("c", np.array([0.5, 0.1, 0.2])), "s": ("g", np.array([1.0, 2.0, 3.0]))}
    df = spark.createDataFrame([("w", k, f, v.tolist()) for k, (f, v) in points.items()], "world string, id string, frame string, p array<double>")
    t = table(spark, tree)
    jac = frames.gradients(df, t, frames.to_root(t))
    got = {(x.r, x.c): x.v for x in jac.collect()}
    def at(k, moved=None, own=0):
        f, v = points[k]
        r, s = root(tree, f, moved)
        return r @ (v * frames.UNITS[tree[f][3]] + own) + s
    for k in points:
        for link in tree:
            for c, name in enumerate(frames.TANGENT):
                e = np.zeros(6)
                e[c] = 1e-6
                slope = (at(k, {link: e}) - at(k, {link: -e})) / 2e-6 if tree[link][0] else np.zeros(3)
                for i in range(3):
                    assert np.isclose(got.get((f"{k}.{'xyz'[i]}", f"{link}.{name}"), 0.0), slope[i], atol=1e-6)
        for c in range(3):
            slope = at(k, own=np.eye(3)[c]) - at(k)
            assert np.allclose([got.get((f"{k}.{a}", f"{k}.p{'xyz'[c]}"), 0.0) for a in "xyz"], slope)
    # points that share the link of b are correlated, those that don't are not
    cov = spark.createDataFrame([("w", f"b.{n}", f"b.{n}", 0.01) for n in frames.TANGENT], "world string, i string, k string, v double")
    joint = {(x.r[0], x.r2[0]) for x in belief.pushforward(jac, cov).collect()}
    assert ("p", "q") in joint and not [x for x in joint if "s" in x]


def test_faults(spark, tree):
    def told(**other):
        bad = dict(tree) | other
        with pytest.raises(frames.FrameError) as e:
            frames.to_root(table(spark, bad))
        return str(e.value)
    p, r, t, u = tree["c"]
    assert told(c=("x", r, t, u)) == "unknown parent: c of w" and "not one root" in told(c=(None, r, t, u)) and "unknown unit: c" in told(c=(p, r, t, "yd"))
    assert "improper rotation: c" in told(c=(p, -r, t, u)) and "improper" in told(c=(p, 1.001 * r, t, u)) and "circle" in told(d=("f", r, t, u))
    twice = table(spark, tree).unionByName(table(spark, {"c": tree["c"]}))
    with pytest.raises(frames.FrameError, match="duplicate"):
        frames.to_root(twice)

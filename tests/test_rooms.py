"""Scans through several rooms: each point meets its own room's primitives alone, and a scan has one row an element and one pose."""

import math

import numpy as np

from plumbline.operators import registration as reg
from plumbline.plans import scans

PRIMS = "scene string, k long, element string, px double, py double, pz double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double, w double"
POINTS = "scan int, scene string, p long, x double, y double, z double"


def places(n, seed):
    return np.random.default_rng(seed).uniform(-3, 3, (n, 3))


def prims(spark, rooms):
    return spark.createDataFrame([(s, k, f"e{k % 2}", *map(float, x), 0.01, 0.0, 0.0, 0.01, 0.0, 0.01, 1.0) for s, at in rooms.items() for k, x in enumerate(at)], PRIMS)


def test_evidence_of_rooms_adds_up(spark):
    rooms = {"a": places(30, 1), "b": places(20, 2)}
    points = spark.createDataFrame([(1, s, 100 * (s == "b") + k, *map(float, x)) for s, at in rooms.items() for k, x in enumerate(at)], POINTS)
    pose = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, True)], "scan int, theta double, tx double, ty double, tz double, accepted boolean")
    both = {r.element: r for r in reg.evidence(points, pose, prims(spark, rooms)).collect()}
    alone = {s: {r.element: r for r in reg.evidence(points.filter(f"scene = '{s}'"), pose, prims(spark, {s: rooms[s]})).collect()} for s in rooms}
    assert reg.evidence(points, pose, prims(spark, rooms)).count() == 2
    for e, r in both.items():
        assert r.primitives == sum(x[e].primitives for x in alone.values())
        assert math.isclose(r.effective_points, sum(x[e].effective_points for x in alone.values()))
        assert math.isclose(r.confidence, sum(x[e].confidence * x[e].effective_points for x in alone.values()) / r.effective_points)
        g2 = sum(x[e].effective_points ** 2 / (x[e].primitives * x[e].diversity) for x in alone.values())
        assert math.isclose(r.diversity, r.effective_points**2 / (r.primitives * g2))


def test_a_scan_has_one_pose_for_all_rooms(spark):
    rooms = {"a": places(40, 3), "b": places(25, 4) + 1}
    theta, t = 0.05, np.array([0.1, -0.1, 0.05])
    c, s = math.cos(theta), math.sin(theta)
    back = np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]]).T
    points = spark.createDataFrame([(1, r, 100 * (r == "b") + k, *map(float, (x - t) @ back)) for r, at in rooms.items() for k, x in enumerate(at)], POINTS)
    found = reg.register(points, prims(spark, rooms), starts=2, rounds=(2, 4, 6)).collect()
    assert len(found) == 1 and found[0].accepted
    assert abs(found[0].theta - theta) < 0.01 and np.allclose([found[0].tx, found[0].ty, found[0].tz], t, atol=0.02)


def test_a_larger_table_has_more_rooms_not_denser_ones(spark, tmp_path):
    """Every place is taken again by a vector of another element, 5,001 ids on."""
    at = places(150, 5) / 20
    rows = [(k + again, [float(v) for v in x] + [0.0] * 61, 7) for again in (0, 5001) for k, x in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = scans.scan_evidence(spark, str(tmp_path)).collect()
    assert sorted((r.scan, r.element, r.primitives, r.supported) for r in got) == [(7, e, 60, True) for e in range(5)]

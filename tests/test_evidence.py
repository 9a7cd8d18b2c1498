"""Spaces, binds, effort and reach of plans by single cases, and ranks against NumPy."""

import numpy as np
import pytest
from helpers import rows

from plumbline.operators import evidence
from pyspark.sql import functions as F

BIND = "space string, schema string, claim_scope string, point_id string, global_id string, ifc_class string, frame_id string, epoch string, sigma double, sigma_unit string, sigma_reason string"
GOOD = ("s", evidence.BIND_SCHEMA, evidence.CLAIM_SCOPE, "P", "2O2Fr$t4X7Zf8NOew3FNr2", "IfcWall", "site", "e", 0.01, "m", "declared")


def bind(space, **other):
    names = [c.split()[0] for c in BIND.split(", ")]
    return tuple((dict(zip(names, GOOD, strict=True)) | {"space": space} | other)[n] for n in names)


def index(spark, spaces, receipts, binds, extra=()):
    return evidence.inspectability(
        spark.createDataFrame(spaces, "space string, ifc_class string, global_id string"), spark.createDataFrame(receipts, "space string, disposition string, evidence_digest string"),
        spark.createDataFrame(binds, BIND), spark.createDataFrame(list(extra), "space string, code string, asks_for string"), ("IfcWall", "IfcDoor"),
    )


def test_every_state_of_a_space(spark):
    digest = "a" * 64
    spaces = [(s, "IfcSpace", s.upper()) for s in ("ok", "bad", "short", "wrong", "none", "more", "idle")] + [("zone", "IfcZone", "Z"), ("twice", "IfcSpace", None), ("twice", "IfcSpace", "T")]
    receipts = [("ok", "ACCEPT", digest), ("bad", "ACCEPT", digest), ("bad", "VIOLATED", None), ("short", None, "a" * 15), ("wrong", "ACCEPT", digest), ("more", "ACCEPT", digest), ("zone", "ACCEPT", digest), ("twice", "ACCEPT", digest)]
    binds = [bind("ok"), bind("bad"), bind("short"), bind("wrong", sigma=0.0), bind("wrong", ifc_class="IfcSlab"), bind("more"), bind("zone"), bind("twice"), bind("twice", epoch=" "), bind("idle")]
    got = {r.space: r for r in index(spark, spaces, receipts, binds, [("more", "frame.level_loop", "a loop")]).collect()}
    state = {k: (r.inspectability, [x.code for x in r.requests]) for k, r in got.items()}
    assert state == {
        "ok": ("ACCEPT", []), "twice": ("ACCEPT", []), "bad": ("REJECT", []), "short": ("REQUEST_EVIDENCE", ["evidence.as_built"]), "wrong": ("REQUEST_EVIDENCE", ["bind.point_to_guid"]),
        "none": ("REQUEST_EVIDENCE", ["bind.point_to_guid", "evidence.as_built"]), "more": ("REQUEST_EVIDENCE", ["frame.level_loop"]), "zone": ("REQUEST_EVIDENCE", ["identity.space"]), "idle": ("REQUEST_EVIDENCE", ["evidence.as_built"]),
    }
    assert got["wrong"].requests[0].refused == "ifc_class is not bindable; sigma" and got["none"].requests[0].refused is None
    work = rows(evidence.tickets(index(spark, spaces, receipts, binds, [("more", "frame.level_loop", "a loop"), ("ok", "own.code", "x")])).select("space", "code", "instrument"))
    assert ("more", "frame.level_loop", "digital-level") in work and ("ok", "own.code", "unspecified") in work and not [w for w in work if w[0] == "bad"]


def test_reasons_of_effort(spark):
    table = spark.createDataFrame([("a", "mine", True, 0.5), ("b", "other", True, 0.5), ("c", "mine", True, None), ("d", "mine", False, 0.5), ("e", "mine", True, -1.0)], "name string, authority string, allowed boolean, cost_nats double")
    ask = [(1, "a", "h", 0.6), (2, "a", "h", 0.5), (3, "a", "", 9.0), (4, "a", "h", None), (5, "b", "h", 9.0), (6, "c", "h", 9.0), (7, "d", "h", 9.0), (8, "e", "h", 9.0), (9, "x", "h", 9.0), (10, None, "h", 9.0)]
    df = spark.createDataFrame([(*r, "mine") for r in ask], "id int, name string, hole string, gain double, authority string")
    assert dict(rows(evidence.effort(df, table).select("id", "disposition"))) == dict.fromkeys(range(5, 11), "REFUSE") | {1: "INVOKE", 2: "DEFER", 3: "DEFER", 4: "DEFER"}


def test_gain_in_rank_equals_that_of_the_matrix(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(2, 5))
    info = np.zeros((5, 5))
    info[:3, :3] = a[:, :3].T @ a[:, :3]  # rank 2; 3 and 4 aren't reached
    def rank(m):
        v = np.abs(np.linalg.eigvalsh(m))
        return int((v > v.max() * 1e-10).sum()) if v.max() > 0 else 0
    eigen = spark.createDataFrame([("w", float(v)) for v in np.linalg.eigvalsh(info)], "world string, v double")
    plans = [("w", "3", 0.5), ("w", "4", 1e11), ("w", "3", 1e-12), ("empty", "0", 1.0)]
    got = {(r.world, r.noise): r.gain for r in evidence.rank_gain(eigen, spark.createDataFrame(plans, "world string, i string, noise double")).collect()}
    for w, i, noise in plans:
        m = info if w == "w" else np.zeros((1, 1))
        bump = np.zeros_like(m)
        bump[int(i), int(i)] = 1 / noise
        assert got[w, noise] == rank(m + bump) - rank(m), (w, i, noise)
    with pytest.raises(Exception, match="positive"):
        evidence.rank_gain(eigen, spark.createDataFrame([("w", "3", 0.0)], "world string, i string, noise double")).collect()


def test_tickets_and_coverage(spark):
    jac = spark.createDataFrame([("w", "cost", "a", 2.0), ("w", "cost", "b", 0.0), ("w", "cost", "c", 1.0), ("w", "area", "a", 1.0)], "world string, r string, c string, v double")
    prior = spark.createDataFrame([("w", i, 0.01) for i in "abc"], "world string, i string, v double")
    known = evidence.informed(prior, spark.createDataFrame([("w", "a", "a", 3.0), ("w", "a", "c", 9.0), ("w", "c", "c", 1e-12)], "world string, i string, k string, v double"))
    assert dict(rows(known.select("i", "informed"))) == {"a": True, "b": False, "c": False}
    subjects = jac.select("world", "r").distinct()
    assert rows(evidence.ticket(jac, known, subjects).select("r", "depends_on", "uninformed", "can_close")) == [("area", 1, 0, True), ("cost", 2, 1, False)]
    gains = spark.createDataFrame([("w", "b", 1), ("w", "a", 1)], "world string, i string, gain int")
    assert rows(evidence.coverage(jac, known, subjects, gains)) == [("w", 1, 0, 1, False)]
    assert rows(evidence.coverage(jac, known, subjects, gains.unionByName(gains.limit(1).withColumn("i", F.lit("c"))))) == [("w", 1, 1, 0, True)]

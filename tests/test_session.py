import json
import uuid

import numpy as np
import pytest
from helpers import rows

from plumbline import session
from plumbline.operators import verify
from plumbline.sources import ply, sinks, step
from pyspark.sql import functions as F


@pytest.fixture
def world(spark):
    mean = spark.createDataFrame([(w, i, m) for w in (1, 2) for i, m in (("a", 1.0), ("b", 2.0))], "world long, i string, mu double")
    cov = spark.createDataFrame([(w, i, k, 1.0 if i == k else 0.5) for w in (1, 2) for i in "ab" for k in "ab"], "world long, i string, k string, v double")
    return session.World(mean, cov)


def test_execute_replay_and_refuse(world):
    steps = [session.encode("shift_parameter", "a", delta=2.0), session.encode("scale_parameter", "b", factor=3.0)]
    after = session.execute(world, steps)
    assert rows(after.mean) == [(1, "a", 3.0), (1, "b", 6.0), (2, "a", 3.0), (2, "b", 6.0)]
    again = session.replay(world, after.ledger)
    assert rows(again.digests()) == rows(after.digests()) != rows(world.digests())
    low = lambda mean, cov: verify.cons_01(mean.withColumn("sd", F.lit(0.0)))
    with pytest.raises(session.StepError, match="CONS-01"):
        session.execute(world, [session.encode("shift_parameter", "a", delta=-9.0)], [low])
    assert not world.ledger and session.preview(world, steps)[1].count() == 0
    with pytest.raises(ValueError):
        session.encode("shift_parameter", "a", value=1.0)
    with pytest.raises(ValueError):
        session.decode('{"kind":"shift_parameter","i":"a","delta":1.0,"more":2}')


def test_observations_and_process_steps(world):
    """One variance of 1 and a covariance of 0.5: seen with noise 1, then moved on, then replayed with a refusal."""
    low = lambda mean, cov: verify.cons_01(mean.withColumn("sd", F.lit(0.0)))
    after = session.execute(world, [session.encode("observe_quantity", "a", y=3.0, noise=1.0)], [low])
    assert rows(after.mean)[:2] == [(1, "a", 2.0), (1, "b", 2.5)]
    assert {(r.i, r.k): round(r.v, 9) for r in after.cov.filter("world = 1").collect()} == {("a", "a"): 0.5, ("a", "b"): 0.25, ("b", "a"): 0.25, ("b", "b"): 0.875}
    after = session.execute(after, [session.encode("evolve_linear_gaussian", "b", factor=2.0, offset=-1.0, noise=0.5)], [low])
    assert rows(after.mean)[:2] == [(1, "a", 2.0), (1, "b", 4.0)]
    assert {(r.i, r.k): round(r.v, 9) for r in after.cov.filter("world = 2").collect()} == {("a", "a"): 0.5, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 4.0}
    after = session.attempt(after, [session.encode("shift_parameter", "a", delta=-9.0)], [low])
    assert [e["kind"] for e in after.ledger] == ["transition", "transition", "rejection"] and "CONS-01" in after.ledger[2]["error"]
    again = session.replay(world, after.ledger, [low])
    assert again.ledger == after.ledger and again.mark() == after.mark() != world.mark()
    bent = [dict(after.ledger[0], result="0" * 64), *after.ledger[1:]]
    with pytest.raises(session.StepError, match="hashed"):
        session.check_ledger(bent)
    with pytest.raises(session.StepError, match="recorded"):
        session.replay(session.World(world.mean.withColumn("mu", F.col("mu") + 1), world.cov), after.ledger, [low])


def test_forecast(spark, world):
    targets = world.mean.filter("i = 'a'").select("world", "i", F.lit(0.5).alias("factor"), F.lit(1.0).alias("offset"), F.lit(0.25).alias("noise"), F.lit(60.0).alias("seconds"))
    got = rows(session.forecast(world.mean, world.cov, targets, 2).filter("world = 1").select("step", "elapsed", "mu", F.round(F.col("sd") ** 2, 9).alias("v")))
    assert got == [(1, 60.0, 1.5, 0.5), (2, 120.0, 1.75, 0.375)]


def test_snapshots_and_exports(spark, world, tmp_path):
    sinks.write_snapshot(world.mean, world.cov, str(tmp_path))
    mean, cov = sinks.read_snapshot(spark, str(tmp_path))
    assert rows(mean) == rows(world.mean)
    world.mean.withColumn("mu", F.col("mu") + 1).write.mode("overwrite").parquet(f"{tmp_path}/mean")
    with pytest.raises(ValueError, match="snapshot"):
        sinks.read_snapshot(spark, str(tmp_path))
    assert '"corr":0.5' in sinks.state_json(world.mean, world.cov).first().state
    assert np.allclose(ply.points(sinks.splat([(1.0, 2.0, 3.0, 0.1, 0.1, 0.1, 0.5)])), [[1, 2, 3]])
    r = spark.createDataFrame([("c", "k", "t")], "case string, check string, title string")
    assert rows(sinks.topics(r, "case", "check", "title")) == [(str(uuid.uuid5(uuid.NAMESPACE_URL, "c/k")), "t", "Open")]


def test_state_ranks_correlations_by_world(spark):
    names = "abcd"
    strong = lambda w, i, k: 1.0 if i == k else 0.9 if w == 1 else 0.3
    mean = spark.createDataFrame([(w, i, 1.0) for w in (1, 2) for i in names], "world long, i string, mu double")
    cov = spark.createDataFrame([(w, i, k, strong(w, i, k)) for w in (1, 2) for i in names for k in names], "world long, i string, k string, v double")
    found = {r.world: json.loads(r.state) for r in sinks.state_json(mean, cov, 3).collect()}
    assert [len(found[w]["correlations"]) for w in (1, 2)] == [3, 3]


def test_a_folder_of_step_files(spark, tmp_path):
    text = step.write([("FILE_SCHEMA", [["IFC4"]])], [(1, "IFCWALL", ["g", None, "w"])])
    for name in ("a.ifc", "b.ifc"):
        (tmp_path / name).write_text(text)
    spark.dataSource.register(step.StepSource)
    assert spark.read.format("step").load(str(tmp_path)).count() == 2
    assert spark.read.format("step").load(str(tmp_path / "a.ifc")).count() == 1

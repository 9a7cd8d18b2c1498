"""Lifecycles: every step of both machines, and a stream over growing input against the batch."""

import random

from helpers import rows

from plumbline.streaming import lifecycles as life
from pyspark.sql import functions as F

D = "0" * 64


def told(df):
    return rows(df.select("kind", "id", "seq", "state", "before", "refused"))


def test_every_step(spark):
    data, want = [], []
    for kind, table in life.STEPS.items():
        paths = {life.NEW: []}
        grown = True
        while grown:  # a way to each state
            grown = False
            for a, bs in table.items():
                for b in bs:
                    if a in paths and b not in paths:
                        paths[b], grown = [*paths[a], b], True
        states = [s for s in table if s != life.NEW]
        for a, way in paths.items():
            for b in states:
                i = f"{a}-{b}"
                data += [(kind, i, n, s, "auth", D, None) for n, s in enumerate([*way, b])]
                want.append((kind, i, len(way), b, a, None if b in table[a] else f"forbidden {a} > {b}"))
    got = set(told(life.batch(spark.createDataFrame(data, life.RECORD).repartition(4))))
    assert set(want) <= got and len(got) == len(data)


def test_faults_of_records(spark):
    bad = [
        ("note", "a", 1, "X", None, D, None), ("approval", "", 1, "APPROVED", None, D, None), ("approval", "a", None, "APPROVED", None, D, None), ("approval", "a", 1, "", None, D, None), ("approval", "a", 2, "PROPOSED", None, D, None),
        ("approval", "a", 3, "APPROVED", None, "0" * 63, None), ("policy", "p", 1, "ACCEPT", None, D, "x"), ("external_action", "a", 1, "AUTHORIZED", None, D, None), ("assessment", "q", 1, "SATISFIED", None, D, D), (None, None, None, None, None, None, None),
    ]
    got = life.batch(spark.createDataFrame(bad, life.RECORD)).select(F.coalesce("refused", F.lit("")).alias("r"))
    assert sorted(r.r for r in got.collect()) == sorted(["unknown kind", "no id", "no sequence number", "no state", "unknown state", "world digest", "evidence digest", "no authorization", "", "unknown kind"])
    assert life.batch(spark.createDataFrame([], life.RECORD)).count() == 0


def test_a_stream_over_growing_input_equals_the_batch(spark, tmp_path):
    r = random.Random(4)
    data = []
    for n in range(240):
        kind = r.choice(["approval", "external_action", "policy"])
        state = r.choice([s for s in life.STEPS.get(kind, {"ACCEPT": 0}) if s != life.NEW])
        data.append((kind, f"i{r.randrange(12)}", n, state, r.choice(["auth", None]), D, None))
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (data[:100], data[100:230]):
        spark.createDataFrame(part, life.RECORD).coalesce(1).write.mode("append").parquet(source)
        life.run(spark.readStream.schema(life.RECORD).parquet(source), out, mark)
    assert told(life.told(spark, out)) == told(life.batch(spark.createDataFrame(data[:230], life.RECORD)))
    life.run(spark.readStream.schema(life.RECORD).parquet(source), out, mark)  # nothing new
    assert life.told(spark, out).count() == 230
    # a record that is not after the last one of its machine is late, whatever it says
    kind, name, *_ = next(x for x in data if x[0] == "approval")
    spark.createDataFrame([(kind, name, 0, "DEFERRED", None, D, None)], life.RECORD).write.mode("append").parquet(source)
    life.run(spark.readStream.schema(life.RECORD).parquet(source), out, mark)
    assert life.told(spark, out).filter((F.col("id") == name) & (F.col("kind") == kind) & (F.col("seq") == 0)).filter("refused = 'late'").count() == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before

"""Causal records and their lifecycles, as a batch and as a stream: a keyed state machine that refuses forbidden and late steps.

Records are (kind, id, seq, state, authorization, world_digest, evidence_digest). Assessments and policies stand by
themselves; approvals and external actions go through states, one machine an id. A refused record leaves its machine where it
was, with the reason told. A stream keeps one state and one sequence number an id (in Spark's state store); a record
that is not after the last one that its machine took is late. In order of their numbers, a stream and a batch tell the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

NEW = "NEW"
#: The steps that lifecycles allow, and the states of an action that need an authorization.
STEPS = {
    "approval": {NEW: ("APPROVED", "REJECTED", "DEFERRED"), "DEFERRED": ("APPROVED", "REJECTED", "DEFERRED"), "APPROVED": ("REVOKED",), "REJECTED": (), "REVOKED": ()},
    "external_action": {
        NEW: ("PROPOSED",), "PROPOSED": ("AUTHORIZED", "CANCELLED"), "AUTHORIZED": ("STARTED", "CANCELLED"), "STARTED": ("COMPLETED", "FAILED", "CANCELLED"), "COMPLETED": (), "FAILED": (), "CANCELLED": (),
    },
}
AUTHORIZED = ("AUTHORIZED", "STARTED", "COMPLETED", "FAILED")
KINDS = ("assessment", "policy", *STEPS)
DIGEST = r"^[0-9a-f]{64}$"
RECORD = "kind string, id string, seq long, state string, authorization string, world_digest string, evidence_digest string"
RESULT = "kind string, id string, seq long, state string, before string, refused string"


def fault(c=F.col) -> Column:
    """What is wrong with a record by itself; null if nothing is."""
    empty = lambda x: x.isNull() | (x == "")
    states = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, t in STEPS.items() for x in (k, sorted({s for s in t if s != NEW}))))
    out = F.when(empty(c("kind")) | ~c("kind").isin(*KINDS), "unknown kind").when(empty(c("id")), "no id").when(c("seq").isNull(), "no sequence number").when(empty(c("state")), "no state")
    out = out.when(~F.coalesce(F.array_contains(F.try_element_at(states, c("kind")), c("state")), F.lit(True)), "unknown state")
    out = out.when(~F.coalesce(c("world_digest").rlike(DIGEST), F.lit(False)), "world digest").when(c("evidence_digest").isNotNull() & ~c("evidence_digest").rlike(DIGEST), "evidence digest")
    need = (c("kind") == "external_action") & c("state").isin(*AUTHORIZED)
    return out.when(need & empty(c("authorization")), "no authorization")


def step(kind: str, before: str, state: str) -> str | None:
    """Why the step is refused; None if it is allowed."""
    return None if state in STEPS[kind][before] else f"forbidden {before} > {state}"


def batch(records: DataFrame) -> DataFrame:
    """(kind, id, seq, state, before, refused) of all records: each id's records in order of seq, folded by one expression."""
    judged = records.withColumn("fault", fault())
    alone = judged.filter(F.col("fault").isNotNull() | F.coalesce(~F.col("kind").isin(*STEPS), F.lit(True)))
    alone = alone.select("kind", "id", "seq", "state", F.lit(None).cast("string").alias("before"), F.col("fault").alias("refused"))
    moves = F.array(*(F.lit(f"{k}:{a}>{b}") for k, t in STEPS.items() for a, bs in t.items() for b in bs))
    per = judged.filter(F.col("fault").isNull() & F.col("kind").isin(*STEPS)).groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("seq", "state"))).alias("steps"))
    out = "array<struct<seq:bigint,state:string,before:string,refused:string>>"
    start = F.struct(F.lit(NEW).alias("at"), F.lit(None).cast("long").alias("last"), F.array().cast(out).alias("told"))

    def go(a: Column, x: Column) -> Column:
        late = F.coalesce(x["seq"] <= a["last"], F.lit(False))
        ok = F.array_contains(moves, F.concat(F.col("kind"), F.lit(":"), a["at"], F.lit(">"), x["state"]))
        why = F.when(late, "late").when(~ok, F.concat(F.lit("forbidden "), a["at"], F.lit(" > "), x["state"]))
        told = F.struct(x["seq"].alias("seq"), x["state"].alias("state"), a["at"].alias("before"), why.alias("refused"))
        return F.struct(F.when(why.isNull(), x["state"]).otherwise(a["at"]).alias("at"), F.when(late, a["last"]).otherwise(x["seq"]).alias("last"), F.concat(a["told"], F.array(told)).alias("told"))

    folded = per.withColumn("done", F.aggregate("steps", start, go)).select("kind", "id", F.explode("done.told").alias("t")).select("kind", "id", "t.*")
    return folded.unionByName(alone)


class _Machine(StatefulProcessor):
    """One id's state and the number of the last record that it saw in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("lifecycle", "at string, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, name = key
        at, last = self.held.get() if self.held.exists() else (NEW, None)
        told = []
        records = sorted((seq, state) for df in rows for seq, state in zip(df["seq"].tolist(), df["state"].tolist(), strict=True))
        for seq, state in records:
            if last is not None and seq <= last:
                told.append((kind, name, seq, state, at, "late"))
                continue
            why = step(kind, at, state)
            told.append((kind, name, seq, state, at, why))
            at, last = (at if why else state), seq
        self.held.update((at, last))
        yield pd.DataFrame(told, columns=[c.split()[0] for c in RESULT.split(", ")])

    def close(self) -> None:
        pass


def run(records: DataFrame, output: str, checkpoint: str) -> None:
    """Take all new records of a stream: ``output``/steps and ``output``/alone get what :func:`batch` would tell of them.

    Two sinks with a checkpoint each. Needs the RocksDB state store, which is set for the run and put back.
    """
    spark, key = records.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        judged = records.withColumn("fault", fault())
        sound = judged.filter(F.col("fault").isNull() & F.col("kind").isin(*STEPS))
        steps = sound.select("kind", "id", "seq", "state").groupBy("kind", "id").transformWithStateInPandas(_Machine(), RESULT, "Append", "None")
        alone = judged.filter(F.col("fault").isNotNull() | F.coalesce(~F.col("kind").isin(*STEPS), F.lit(True)))
        alone = alone.select("kind", "id", "seq", "state", F.lit(None).cast("string").alias("before"), F.col("fault").alias("refused"))
        for name, df in (("steps", steps), ("alone", alone)):
            q = df.writeStream.format("parquet").option("path", f"{output}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append").trigger(availableNow=True).start()
            try:
                q.awaitTermination()
            finally:
                q.stop()
    finally:
        spark.conf.set(key, before)


def told(spark, output: str) -> DataFrame:
    """What a stream has told so far."""
    return spark.read.schema(RESULT).parquet(f"{output}/steps").unionByName(spark.read.schema(RESULT).parquet(f"{output}/alone"))



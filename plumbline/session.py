"""Worlds as tables, transformations as values, and their verified execution.

A transformation is a JSON object {"kind": ..., ...} with a table of targets; a registry maps kinds to functions
(mean, cov, targets) -> (mean, cov). ``execute`` applies one to many worlds at once, checks that no other mean moved (an
observation may move all that depend on its target) and that the given invariants hold, and appends the step to a ledger;
``preview`` does the same without appending. Each event covers the one before it by hash and holds marks of the state
before and after; refused steps are recorded by :func:`attempt` with their error. ``replay`` runs a ledger again and
compares every mark and refusal. Extensions register further kinds and pass further invariants.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import belief, verify

Transform = Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _observe(mean: DataFrame, cov: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets (world, i, y, noise): a raw quantity is seen with positive noise (a variance)."""
    noise = F.when(F.col("noise") > 0, F.col("noise")).otherwise(F.raise_error(F.lit("the noise of an observation must be positive")))
    t = targets.join(mean, ["world", "i"]).select("world", "i", "y", F.col("mu").alias("predicted"), noise.alias("noise"))
    return belief.condition(mean, cov, t.select("world", "i", F.lit(1.0).alias("h")), t.drop("i"))


def _evolve(mean: DataFrame, cov: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """targets (world, i, factor, offset, noise): one process step of a raw quantity; noise is a variance and not negative."""
    q = F.when(F.col("noise") >= 0, F.col("noise")).otherwise(F.raise_error(F.lit("the noise of a process must not be negative")))
    k = F.col("i")
    return belief.evolve(mean, cov, targets.select("world", "i", k.alias("j"), F.col("factor").alias("f")), targets.select("world", "i", F.col("offset").alias("b")), targets.select("world", "i", k.alias("k"), q.alias("q")))


REGISTRY: dict[str, tuple[Transform, tuple[str, ...]]] = {
    "set_parameter": (belief.set_parameter, ("value", "sigma")),
    "shift_parameter": (belief.shift_parameter, ("delta",)),
    "scale_parameter": (belief.scale_parameter, ("factor",)),
    "observe_quantity": (_observe, ("y", "noise")),
    "evolve_linear_gaussian": (_evolve, ("factor", "offset", "noise")),
}
#: Kinds that may move means beside their target.
SPREADING = {"observe_quantity"}
GENESIS = "0" * 64


class StepError(Exception):
    """A step that is refused; nothing was recorded."""


@dataclass(frozen=True)
class World:
    """The belief of many worlds at one point of their history."""

    mean: DataFrame
    cov: DataFrame
    ledger: list[dict] = field(default_factory=list)

    def digests(self) -> DataFrame:
        return belief.belief_digest(self.mean, self.cov)

    def mark(self) -> str:
        """One mark of all worlds' digests, whatever their order: a sum and an exclusive or, not a list of them."""
        h = F.xxhash64("world", "digest")
        row = self.digests().agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
        return hashlib.sha256("|".join(map(str, row)).encode()).hexdigest()


def encode(kind: str, i: str, **values: float) -> str:
    """A transformation as canonical JSON; unknown kinds and fields are an error."""
    if kind not in REGISTRY or set(values) != set(REGISTRY[kind][1]):
        raise ValueError(f"{kind} with fields {sorted(values)}")
    return json.dumps({"kind": kind, "i": i, **{k: float(v) for k, v in values.items()}}, sort_keys=True, separators=(",", ":"))


def decode(text: str) -> dict:
    step = json.loads(text)
    kind = step.get("kind")
    if kind not in REGISTRY or set(step) != {"kind", "i", *REGISTRY[kind][1]}:
        raise ValueError(f"not a transformation: {text}")
    return step


def _applied(world: World, steps: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    mean, cov, allowed = world.mean, world.cov, None
    worlds = world.mean.select("world").distinct()
    for text in steps:
        step = decode(text)
        f, names = REGISTRY[step["kind"]]
        targets = worlds.select("world", F.lit(step["i"]).alias("i"), *(F.lit(step[n]).alias(n) for n in names))
        mean, cov = f(mean, cov, targets)
        moved = world.mean.select("world", "i") if step["kind"] in SPREADING else targets.select("world", "i")
        allowed = moved if allowed is None else allowed.unionByName(moved)
    return mean, cov, allowed


def preview(world: World, steps: list[str], invariants: list[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> tuple[World, DataFrame]:
    """The world after ``steps`` (verified once, at the end), and the rows of the invariants."""
    mean, cov, allowed = _applied(world, steps)
    found = verify.gauss_02_diagonal(cov)
    moved = belief.selectivity_violations(world.mean, mean, allowed)
    found = found.unionByName(moved.select(F.lit("SELECTIVITY").alias("rule"), F.concat_ws("/", "world", "i").alias("subject"), F.lit("FAIL").alias("status"), F.col("mu_after").cast("string").alias("detail")))
    for rule in invariants:
        found = found.unionByName(rule(mean, cov))
    return World(mean, cov, world.ledger), found.filter("status <> 'PASS'")


def execute(world: World, steps: list[str], invariants: list[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> World:
    """Commit ``steps`` as one atomic change, or raise and leave everything as it was."""
    after, found = preview(world, steps, invariants)
    bad = found.filter("status = 'FAIL'").orderBy("rule", "subject", "detail").limit(1).collect()  # the same row whenever it is replayed
    if bad:
        raise StepError(f"{bad[0].rule}: {bad[0].subject} {bad[0].detail}")
    return World(after.mean, after.cov, [*world.ledger, _event(world, "transition", steps, after.mark(), None)])


def _event(world: World, kind: str, steps: list[str], result: str, error: str | None) -> dict:
    last = world.ledger[-1] if world.ledger else None
    prior = last["result"] if last else world.mark()
    body = {"seq": len(world.ledger), "kind": kind, "steps": list(steps), "prior": prior, "result": result, "error": error, "previous_hash": last["event_hash"] if last else GENESIS}
    return body | {"event_hash": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


def attempt(world: World, steps: list[str], invariants: list[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> World:
    """Like :func:`execute`, but a refusal is recorded with its error and leaves the state as it was."""
    try:
        return execute(world, steps, invariants)
    except StepError as e:
        prior = world.ledger[-1]["result"] if world.ledger else world.mark()
        return World(world.mean, world.cov, [*world.ledger, _event(world, "rejection", steps, prior, str(e))])


def check_ledger(ledger: list[dict]) -> None:
    """An error where a ledger's numbers, links, hashes or states don't follow."""
    last = None
    for n, event in enumerate(ledger):
        body = {k: v for k, v in event.items() if k != "event_hash"}
        if event["seq"] != n or event["previous_hash"] != (last["event_hash"] if last else GENESIS):
            raise StepError(f"event {n} does not follow the one before it")
        if event["event_hash"] != hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest():
            raise StepError(f"event {n} is not what was hashed")
        if last and event["prior"] != last["result"] or event["kind"] == "rejection" and event["prior"] != event["result"]:
            raise StepError(f"event {n} does not start from the state before it")
        last = event


def replay(start: World, ledger: list[dict], invariants: list[Callable[[DataFrame, DataFrame], DataFrame]] = ()) -> World:
    """Run a ledger's steps again from the first state; every state and refusal must come out as recorded."""
    check_ledger(ledger)
    for event in ledger:
        start = attempt(start, event["steps"], invariants)
        if start.ledger[-1] != event:
            raise StepError(f"event {event['seq']} does not come out as recorded")
    return start


def forecast(mean: DataFrame, cov: DataFrame, targets: DataFrame, steps: int) -> DataFrame:
    """(world, i, step, elapsed, mu, sd) of the targets (world, i, factor, offset, noise, seconds) after each process step; nothing is recorded.

    A step moves a target by itself, so that its mean and variance are all that its later ones stand on: targets are joined once.
    """
    now = targets.join(mean, ["world", "i"]).join(cov.filter("i = k").select("world", "i", "v"), ["world", "i"])
    return forecast_of(now, steps)


def forecast_of(targets: DataFrame, steps: int) -> DataFrame:
    """:func:`forecast` of targets that bring their mean and variance (mu, v) along; they are joined with nothing."""
    mu, v = F.col("mu"), F.col("v")
    q = F.when(F.col("noise") >= 0, F.col("noise")).otherwise(F.raise_error(F.lit("the noise of a process must not be negative")))
    after = []
    for n in range(1, steps + 1):
        mu, v = F.col("factor") * mu + F.col("offset"), F.col("factor") * v * F.col("factor") + F.col("q")
        after.append(F.struct(F.lit(n).alias("step"), (F.col("seconds") * n).alias("elapsed"), mu.alias("mu"), F.sqrt(v).alias("sd")))
    return targets.withColumn("q", q).select("world", "i", F.explode(F.array(*after)).alias("s")).select("world", "i", "s.*")

"""An append-only, hash-chained record of steps: chains, lifecycles, forks, Merkle roots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.graph import _cut

GENESIS = "0" * 64


def event_digest(columns: list[str]):
    """The digest of one event's own content."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def chain(events: DataFrame, by: str, order: list[str], content: str = "digest") -> DataFrame:
    """events with seq, previous_hash and event_hash: each hash covers the one before it within its stream.

    A chain is inherently sequential, so each stream is one grouped-map call; streams run side by side.
    """
    import hashlib

    schema = T.StructType(list(events.schema.fields)).add("seq", "long").add("previous_hash", "string").add("event_hash", "string")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        previous, hashes = GENESIS, []
        for d in pdf[content]:
            hashes.append(hashlib.sha256(f"{hashes[-1] if hashes else previous}|{d}".encode()).hexdigest())
        return pdf.assign(seq=range(len(pdf)), previous_hash=[previous, *hashes[:-1]], event_hash=hashes)

    return events.groupBy(by).applyInPandas(link, schema)


def validate(ledger: DataFrame, by: str, content: str = "digest") -> DataFrame:
    """Rows that break their chain: a gap in seq, a wrong link, or a hash that does not follow. All checks are windows."""
    w = Window.partitionBy(by).orderBy("seq")
    seen = ledger.withColumns({"_seq": F.coalesce(F.lag("seq").over(w) + 1, F.lit(0)), "_prev": F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS))})
    bad = F.when(F.col("seq") != F.col("_seq"), "sequence").when(F.col("previous_hash") != F.col("_prev"), "link").when(F.col("event_hash") != F.sha2(F.concat_ws("|", "previous_hash", content), 256), "hash")
    return seen.withColumn("fault", bad).filter("fault IS NOT NULL").drop("_seq", "_prev")


def continuity(steps: DataFrame, by: str) -> DataFrame:
    """steps (seq, prior, result): those whose prior state is not the result of the step before."""
    return steps.withColumn("before", F.lag("result").over(Window.partitionBy(by).orderBy("seq"))).filter("before IS NOT NULL AND prior <> before")


def forks(steps: DataFrame) -> DataFrame:
    """Prior states with more than one result."""
    return steps.groupBy("prior").agg(F.countDistinct("result").alias("results")).filter("results > 1")


def lifecycle(events: DataFrame, by: str, order: list[str], allowed: list[tuple[str, str]], first: list[str]) -> DataFrame:
    """events (state): steps that the finite-state machine does not allow."""
    e = events.withColumn("before", F.lag("state").over(Window.partitionBy(by).orderBy(*order)))
    ok = F.when(F.col("before").isNull(), F.col("state").isin(first)).otherwise(F.concat_ws(">", "before", "state").isin([f"{a}>{b}" for a, b in allowed]))
    return e.filter(~ok)


def timeline(ledger: DataFrame, by: str, head: int = 5, tail: int = 45) -> DataFrame:
    """All events of a short stream, the first and last of a long one."""
    n, k = F.count("*").over(Window.partitionBy(by)), F.row_number().over(Window.partitionBy(by).orderBy("seq"))
    return ledger.withColumns({"_n": n, "_k": k}).filter((F.col("_n") <= head + tail) | (F.col("_k") <= head) | (F.col("_k") > F.col("_n") - tail)).drop("_n", "_k")


def merkle_levels(leaves: DataFrame, by: str) -> DataFrame:
    """(by, level, pos, hash): sorted distinct leaves (digest) and the layers above them; an odd last node pairs with itself."""
    w = Window.partitionBy(by).orderBy("hash")
    layer = _cut(leaves.select(by, F.col("digest").alias("hash")).distinct().withColumn("pos", F.row_number().over(w) - 1).withColumn("level", F.lit(0)))
    out = layer
    while True:
        pairs = layer.groupBy(by, F.floor(F.col("pos") / 2).alias("p")).agg(F.min_by("hash", "pos").alias("l"), F.max_by("hash", "pos").alias("r"), F.count("*").alias("n"))
        wide = layer.groupBy(by).agg(F.count("*").alias("n")).filter("n > 1").select(by)
        if wide.isEmpty():
            return out
        above = pairs.join(wide, by, "left_semi").select(by, _pair("l", "r").alias("hash"), F.col("p").cast("int").alias("pos"))
        layer = _cut(above.withColumn("level", F.lit(out.agg(F.max("level")).first()[0] + 1)).select(*layer.columns))
        out = out.unionByName(layer)


#: Fixed value: the root of no leaves, the digest of an empty JSON list.
NO_LEAVES = "4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945"


def _pair(left: str, right: str):
    """The hash of two nodes: of their 64 bytes, not of their text."""
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def merkle_root(leaves: DataFrame, by: str, groups: DataFrame | None = None) -> DataFrame:
    """(by, root); of ``groups`` (by), those without leaves get the root of an empty set."""
    roots = merkle_levels(leaves, by).groupBy(by).agg(F.max_by("hash", "level").alias("root"))
    if groups is None:
        return roots
    return groups.select(by).distinct().join(roots, by, "left").select(by, F.coalesce("root", F.lit(NO_LEAVES)).alias("root"))


def merkle_proofs(leaves: DataFrame, by: str) -> DataFrame:
    """(by, digest, path): of each leaf the sibling hashes up to the root, with the side on which each stands."""
    nodes = _cut(merkle_levels(leaves, by))
    top = nodes.groupBy(by).agg(F.max("level").alias("top"))
    at = nodes.filter("level = 0").join(top, by).select(by, F.col("hash").alias("digest"), F.explode_outer(F.when(F.col("top") > 0, F.sequence(F.lit(0), F.col("top") - 1))).alias("level"), "pos")
    at = at.withColumn("p", F.expr("shiftright(pos, coalesce(level, 0))"))
    side = nodes.select(by, "level", F.col("pos").alias("q"), F.col("hash").alias("sibling"))
    own = nodes.select(by, "level", F.col("pos").alias("p"), F.col("hash").alias("own"))
    steps = at.withColumn("q", F.expr("p ^ 1")).join(side, [by, "level", "q"], "left").join(own, [by, "level", "p"], "left")
    step = F.struct("level", F.coalesce("sibling", "own").alias("hash"), (F.col("p") % 2 == 1).alias("left"))
    paths = steps.groupBy(by, "digest").agg(F.array_sort(F.collect_list(F.when(F.col("level").isNotNull(), step))).alias("path"))
    return paths


def merkle_verify(proofs: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """proofs (by, digest, path) with whether the path leads from the leaf to the group's root (by, root)."""
    join = lambda node, s: F.when(s["left"], F.sha2(F.concat(F.unhex(s["hash"]), F.unhex(node)), 256)).otherwise(F.sha2(F.concat(F.unhex(node), F.unhex(s["hash"])), 256))
    return proofs.join(roots, by, "left").withColumn("valid", F.coalesce(F.aggregate("path", F.col("digest"), join) == F.col("root"), F.lit(False)))


def elapsed(steps: DataFrame, by: str, order: list[str], seconds: str, value: str) -> DataFrame:
    """steps with the seconds up to each, and the change of ``value`` from the step before."""
    w = Window.partitionBy(by).orderBy(*order)
    return steps.withColumns({"elapsed": F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, 0)), "delta": F.col(value) - F.lag(value).over(w)})


def receipts(cited: DataFrame, ledger: DataFrame) -> DataFrame:
    """cited (case, event_hash, result) with whether the ledger (event_hash, result) has that transition with that result."""
    known = ledger.select("event_hash", F.col("result").alias("recorded"))
    return cited.join(known, "event_hash", "left").withColumn("binding", F.when(F.col("recorded").isNull(), "UNKNOWN").when(F.col("recorded") == F.col("result"), "BOUND").otherwise("MISMATCH")).drop("recorded")

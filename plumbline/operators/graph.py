"""Typed relationships (kind, src, dst, optionally world) and dependency graphs as tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """End lineage at a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="plumbline-"))
    return df.checkpoint()


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """End lineage at a table in the shared folder, whose real size plans know; ``by`` names a column of few values by which it is
    partitioned, so that scans with a filter on it read their part alone.

    Estimates of checkpoints are products of the estimates before them, which grow beyond use in loops of many joins.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._stored_path = path
    return out


def measured(spark: SparkSession, made: Callable[[], DataFrame]) -> DataFrame:
    """The stored result of ``made``, in which only what a shuffle has measured is broadcast.

    Plans take a file's bytes for its rows' size. Records of many alike texts take a hundredth of that in Parquet, and tables
    that look small would go through the driver whole.
    """
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(keys[0]), spark.conf.get(keys[1], None)]  # the second has no value of its own at first
    spark.conf.set(keys[1], before[1] or before[0])
    spark.conf.set(keys[0], "-1")
    try:
        return stored(made())
    finally:
        for k, x in zip(keys, before, strict=True):
            if x is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, x)


def dealt(df: DataFrame, by: str) -> DataFrame:
    """End lineage at a table in the warehouse, dealt into as many buckets of ``by`` as a shuffle has partitions.

    Joins and groupings by that column read the buckets where they lie, each use only the columns that it needs.
    """
    spark, name = df.sparkSession, f"dealt_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).format("parquet").saveAsTable(name)
    return spark.table(name)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def targets(rel: DataFrame, kind: str, nodes: DataFrame) -> DataFrame:
    """Where edges of a kind lead from ``nodes`` (node)."""
    return rel.filter(F.col("kind") == kind).join(nodes, F.col("src") == F.col("node")).select("src", "dst")


def sources(rel: DataFrame, kind: str, nodes: DataFrame) -> DataFrame:
    """Where edges of a kind come from that lead to ``nodes`` (node)."""
    return rel.filter(F.col("kind") == kind).join(nodes, F.col("dst") == F.col("node")).select("src", "dst")


def within(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both ends among ``entities`` (node)."""
    return rel.join(entities, F.col("src") == F.col("node"), "left_semi").join(entities, F.col("dst") == F.col("node"), "left_semi")


#: One-hop questions: which kind of edge to follow, and from which end.
HOPS = {
    "openings_of_wall": ("voids", "dst"), "wall_of_opening": ("voids", "src"), "fillers_of_opening": ("fills", "dst"), "opening_of_filler": ("fills", "src"),
    "bounding_walls": ("bounds", "dst"), "spaces_of_wall": ("bounds", "src"), "contained_elements": ("contains", "src"), "container_of": ("contains", "dst"), "aggregated_children": ("aggregates", "src"),
}
SPATIAL = ("aggregates", "contains")


def hop(rel: DataFrame, question: str, nodes: DataFrame) -> DataFrame:
    """(node, answer): the named one-hop question for every node of ``nodes`` (node)."""
    kind, end = HOPS[question]
    other = "dst" if end == "src" else "src"
    edges = rel.filter(F.col("kind") == kind).select(F.col(end).alias("node"), F.col(other).alias("answer"))
    return edges.join(nodes.select("node"), "node", "left_semi")


def spatial_edges(rel: DataFrame) -> DataFrame:
    return rel.filter(F.col("kind").isin(*SPATIAL)).select("src", "dst")


def external(entities: DataFrame, boundaries: DataFrame) -> DataFrame:
    """entities (node) with external: whether any boundary (src, side) of theirs is EXTERNAL."""
    out = boundaries.filter("side = 'EXTERNAL'").select(F.col("src").alias("node")).distinct().withColumn("external", F.lit(True))
    return entities.join(out, "node", "left").withColumn("external", F.coalesce("external", F.lit(False)))


def affinity(rel: DataFrame) -> DataFrame:
    """(a, b, strength), both ways: 1 between a wall and its space and a door and its wall, 0.5 between walls of a space."""
    bounds = rel.filter("kind = 'bounds'").select(F.col("src").alias("wall"), F.col("dst").alias("space")).distinct()
    voids, fills = (rel.filter(F.col("kind") == k).select(F.col("src").alias(a), F.col("dst").alias(b)) for k, a, b in (("voids", "opening", "wall"), ("fills", "door", "opening")))
    doors = fills.join(voids, "opening").select(F.col("door").alias("a"), F.col("wall").alias("b"), F.lit(1.0).alias("strength"))
    near = bounds.join(bounds.withColumnRenamed("wall", "other"), "space").filter("wall < other").select(F.col("wall").alias("a"), F.col("other").alias("b"), F.lit(0.5).alias("strength"))
    one = bounds.select(F.col("wall").alias("a"), F.col("space").alias("b"), F.lit(1.0).alias("strength")).unionByName(doors).unionByName(near)
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength")).filter("a <> b")
    return both.groupBy("a", "b").agg(F.max("strength").alias("strength"))


def factor_inventory(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: groups of each kind of edge, and entities on no such edge."""
    ends = {"contains": "src", "voids": "dst", "fills": "src"}
    counts = rel.agg(*(F.count_distinct(F.when(F.col("kind") == k, F.col(end))).alias(f"{k}_cliques") for k, end in ends.items()))
    held = rel.filter(F.col("kind").isin(*ends))
    alone = entities.join(held.select(F.col("src").alias("node")).union(held.select("dst")), "node", "left_anti").agg(F.count("*").alias("isolated"))
    return counts.join(F.broadcast(alone))  # one row with one row


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, level): what can be reached from ``seeds`` (node) along edges (src, dst), without the seeds, at the first level.

    Each level is written once; what has been seen is the union of the levels.
    """
    front = _cut(seeds.select("node", F.lit(0).alias("level")).distinct())
    seen = front
    for level in count(1):
        new = edges.join(front, F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct()
        front = _cut(new.join(seen, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("level > 0")


def peel(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, rest): nodes with the length of their longest path from a source; edges that lie on or behind cycles.

    Each round removes nodes that nothing leads to any more.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    left, levels = _cut(nodes), None
    rest = edges
    for level in count():
        ready = _cut(left.join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            break
        found = ready.withColumn("level", F.lit(level))
        levels = found if levels is None else levels.unionByName(found)
        left = _cut(left.join(ready, "node", "left_anti"))
        rest = _cut(rest.join(ready, F.col("src") == F.col("node"), "left_anti"))
    if levels is None:
        levels = nodes.limit(0).withColumn("level", F.lit(0))
    return levels, rest


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node of each connected component, by label exchange with pointer jumping."""
    both = _cut(edges.select("src", "dst").union(edges.select("dst", "src")).distinct())
    all_nodes = both.select(F.col("src").alias("node")).union(nodes.select("node")) if nodes is not None else both.select(F.col("src").alias("node"))
    labels = _cut(all_nodes.distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels, F.col("dst") == F.col("node")).groupBy("src").agg(F.min("component").alias("m"))
        low = labels.join(near, F.col("node") == F.col("src"), "left").select("node", "component", F.least("component", F.coalesce("m", "component")).alias("low"))
        jump = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))
        new = _cut(low.join(jump, F.col("low") == F.col("n"), "left").select("node", F.least("low", F.coalesce("c", "low")).alias("component"), F.col("component").alias("was")))
        labels = new.select("node", "component")
        if new.filter("component <> was").isEmpty():
            return labels


def spectrum(edges: DataFrame, steps: int = 40, tiny: float = 1e-9) -> DataFrame:
    """(component, nodes, edges, connectivity, largest): of each component the least eigenvalue of the Laplacian beyond the zero that
    belongs to it, and the largest; edges (src, dst) count once in either direction, loops not at all.

    Lanczos steps run for all components together, on vectors without a component's mean, which takes its zero away. A step is a
    join along the edges and sums by node and component; a component ends when its next vector vanishes. Only the
    tridiagonal matrices, of at most ``steps`` rows, are taken apart outside of joins. Large components whose eigenvalues lie
    close together give bounds: from above for the connectivity, from below for the largest.
    """
    import numpy as np
    import pandas as pd

    one = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = stored(one.select(F.col("a").alias("node"), F.col("b").alias("other")).union(one.select("b", "a")))
    at = stored(both.groupBy("node").agg(F.count("*").alias("degree")).join(connected(one.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "node"))
    sizes = at.groupBy("component").agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"))

    def centred(df: DataFrame, c: str) -> DataFrame:
        mean = df.groupBy("component").agg(F.avg(c).alias("mean"))
        return df.join(mean, "component").withColumn(c, F.col(c) - F.col("mean")).drop("mean")

    def scaled(df: DataFrame, c: str) -> tuple[DataFrame, DataFrame]:
        """The vectors that do not vanish at length 1, and (component, norm) of all."""
        norm = stored(df.groupBy("component").agg(F.sqrt(F.sum(F.col(c) ** 2)).alias("norm")))
        return df.join(norm.filter(F.col("norm") > tiny), "component").withColumn(c, F.col(c) / F.col("norm")).drop("norm"), norm

    start = at.withColumn("v", F.pmod(F.xxhash64("node"), F.lit(1_000_003)) / 1_000_003.0)
    now = stored(scaled(centred(start, "v"), "v")[0].withColumns({"u": F.lit(0.0), "beta": F.lit(0.0)}))
    found = None
    for j in range(steps):
        if now.isEmpty():
            break
        moved = both.join(now.select(F.col("node").alias("other"), F.col("v").alias("w")), "other").groupBy("node").agg(F.sum("w").alias("w"))
        next_ = now.join(moved, "node").withColumn("w", F.col("degree") * F.col("v") - F.col("w") - F.col("beta") * F.col("u"))
        alpha = next_.groupBy("component").agg(F.sum(F.col("w") * F.col("v")).alias("alpha"))
        next_ = stored(next_.join(alpha, "component").withColumn("w", F.col("w") - F.col("alpha") * F.col("v")))
        rows, norm = scaled(centred(next_, "w"), "w")
        told = next_.select("component", "alpha").distinct().join(norm, "component").select("component", F.lit(j).alias("j"), "alpha", F.col("norm").alias("beta"))
        found = stored(told) if found is None else found.unionByName(stored(told))
        now = stored(rows.join(norm, "component").select("node", "degree", "component", F.col("w").alias("v"), F.col("v").alias("u"), F.col("norm").alias("beta")))
    if found is None:
        return sizes.withColumns({"connectivity": F.lit(0.0), "largest": F.lit(0.0)})

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("j")
        off = pdf["beta"].to_numpy()[:-1]
        v = np.linalg.eigvalsh(np.diag(pdf["alpha"].to_numpy()) + np.diag(off, 1) + np.diag(off, -1))
        return pd.DataFrame({"component": [pdf["component"].iloc[0]], "connectivity": [v[0]], "largest": [v[-1]]})

    kind = dict(found.dtypes)["component"]
    return sizes.join(found.groupBy("component").applyInPandas(ends, f"component {kind}, connectivity double, largest double"), "component")

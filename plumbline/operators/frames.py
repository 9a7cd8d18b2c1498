"""Trees of coordinate frames with uncertain poses: composed to their roots, between frames, and as a joint belief over points.

frames (world, frame, parent, r, t, unit): ``r`` (nine numbers, row by row) and ``t`` (metres) take a frame's coordinates to its
parent's; the root has neither parent nor pose. Poses are composed by pointer jumping, a round halving all chains. A pose's
error is a right-local tangent (tx, ty, tz, rx, ry, rz) of its link; a point is moved by the errors of all links up to the root,
so points that share links are correlated. Gradients and covariances are rows of :mod:`plumbline.operators.belief`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import dropped, stored

#: Metres of a unit.
UNITS = {"m": 1.0, "cm": 0.01, "mm": 0.001, "in": 0.0254, "ft": 0.3048}
TANGENT = ("tx", "ty", "tz", "rx", "ry", "rz")
#: How far a rotation may be from orthonormal.
PROPER = 1e-10


class FrameError(ValueError):
    """Frames that aren't one tree with proper rotations."""


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def times(a: Column, b: Column) -> Column:
    """Product of two rotations."""
    return F.array(*(_sum([a[3 * i + k] * b[3 * k + j] for k in range(3)]) for i in range(3) for j in range(3)))


def turned(r: Column, p: Column, back: bool = False) -> Column:
    """A vector under a rotation, or under its inverse."""
    return F.array(*(_sum([(r[3 * k + i] if back else r[3 * i + k]) * p[k] for k in range(3)]) for i in range(3)))


def plus(a: Column, b: Column, sign: float = 1.0) -> Column:
    return F.array(*(a[i] + sign * b[i] for i in range(3)))


def faults(frames: DataFrame) -> DataFrame:
    """(world, frame, fault): what keeps frames from being a tree with proper rotations; circles are found by :func:`to_root`."""
    twice = frames.groupBy("world", "frame").count().filter("count > 1").select("world", "frame", F.lit("duplicate frame").alias("fault"))
    roots = frames.groupBy("world").agg(F.count_if(F.col("parent").isNull()).alias("n")).filter("n <> 1").select("world", F.lit(None).cast("string").alias("frame"), F.lit("not one root").alias("fault"))
    lost = frames.filter("parent IS NOT NULL").join(frames.select("world", F.col("frame").alias("parent")), ["world", "parent"], "left_anti").select("world", "frame", F.lit("unknown parent").alias("fault"))
    r = F.col("r")
    square = [_sum([r[3 * k + i] * r[3 * k + j] for k in range(3)]) - (1.0 if i == j else 0.0) for i in range(3) for j in range(i, 3)]
    det = r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    proper = F.coalesce(F.greatest(*(F.abs(x) for x in square), F.abs(det - 1)) <= PROPER, F.lit(False)) & (F.size("r") == 9) & (F.size("t") == 3)
    bent = frames.filter(F.col("parent").isNotNull() & ~proper).select("world", "frame", F.lit("improper rotation").alias("fault"))
    unit = frames.filter(~F.coalesce(F.col("unit").isin(*UNITS), F.lit(False))).select("world", "frame", F.lit("unknown unit").alias("fault"))
    return twice.unionByName(roots).unionByName(lost).unionByName(bent).unionByName(unit)


def to_root(frames: DataFrame) -> DataFrame:
    """(world, frame, r, t, metres): each frame's pose in its root, and its unit. Raises :class:`FrameError` with the first fault."""
    bad = faults(frames).orderBy("world", "frame").first()
    if bad is not None:
        raise FrameError(f"{bad.fault}: {bad.frame} of {bad.world}")
    one = F.array(*(F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)))
    root = F.col("parent").isNull()
    metres = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))[F.col("unit")]
    now = stored(frames.select("world", "frame", "parent", F.when(root, one).otherwise(F.col("r")).alias("r"), F.when(root, F.array(*[F.lit(0.0)] * 3)).otherwise(F.col("t")).alias("t"), metres.alias("metres")))
    most = now.groupBy("world").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        if now.filter("parent IS NOT NULL").isEmpty():
            return now.drop("parent")
        up = now.select("world", F.col("frame").alias("parent"), F.col("parent").alias("above"), F.col("r").alias("pr"), F.col("t").alias("pt"))
        j = now.join(up, ["world", "parent"], "left")
        own = F.col("parent").isNull()
        new = stored(j.select("world", "frame", F.col("above").alias("parent"), F.when(own, F.col("r")).otherwise(times(F.col("pr"), F.col("r"))).alias("r"), F.when(own, F.col("t")).otherwise(plus(F.col("pt"), turned(F.col("pr"), F.col("t")))).alias("t"), "metres"))
        dropped(now)
        now = new
    bad = now.filter("parent IS NOT NULL").orderBy("world", "frame").first()
    if bad is not None:
        raise FrameError(f"frames run in a circle: {bad.frame} of {bad.world}")
    return now.drop("parent")


def to_frame(points: DataFrame, poses: DataFrame, target: str = "target") -> DataFrame:
    """points (world, id, frame, p, target) with q, the same place in the target frame; both in their frames' own units."""
    a = poses.select("world", "frame", F.col("r").alias("ra"), F.col("t").alias("ta"), F.col("metres").alias("ma"))
    b = poses.select("world", F.col("frame").alias(target), F.col("r").alias("rb"), F.col("t").alias("tb"), F.col("metres").alias("mb"))
    j = points.join(a, ["world", "frame"]).join(b, ["world", target])
    p = F.transform("p", lambda x: x * F.col("ma"))
    there = turned(F.col("rb"), plus(plus(turned(F.col("ra"), p), F.col("ta")), F.col("tb"), -1.0), back=True)
    return j.withColumn("q", F.transform(there, lambda x: x / F.col("mb"))).select(*points.columns, "q")


def ancestors(frames: DataFrame) -> DataFrame:
    """(world, frame, link): the links between each frame and its root, its own among them; a link is named by its lower frame."""
    own = stored(frames.filter("parent IS NOT NULL").select("world", "frame", "parent"))
    new = out = stored(own.select("world", "frame", F.col("frame").alias("link")))
    while not new.isEmpty():
        up = own.select("world", F.col("frame").alias("link"), F.col("parent").alias("above"))
        higher = new.join(up, ["world", "link"]).select("world", "frame", F.col("above").alias("link"))
        new = stored(higher.join(own.select("world", F.col("frame").alias("link")), ["world", "link"], "left_semi"))
        out = out.unionByName(new)
    return out


def gradients(points: DataFrame, frames: DataFrame, poses: DataFrame) -> DataFrame:
    """jac (world, r, c, v) of points (world, id, frame, p) in the root: r is "<id>.x", c is "<link>.tx" for the error of a link and
    "<id>.px" for that of the point itself in its frame's axes, in metres."""
    j = points.join(poses, ["world", "frame"]).withColumn("p", F.transform("p", lambda x: x * F.col("metres")))
    j = stored(j.select("world", "id", "frame", "r", plus(turned(F.col("r"), F.col("p")), F.col("t")).alias("at")))
    cell = lambda rows: F.explode(F.array(*(F.struct(F.concat_ws(".", "id", F.lit("xyz"[i])).alias("r_"), name.alias("c"), v.alias("v")) for i, name, v in rows))).alias("g")
    own = j.select("world", cell([(i, F.concat(F.col("id"), F.lit(".p" + "xyz"[k])), F.col("r")[3 * i + k]) for i in range(3) for k in range(3)]))
    link = poses.select("world", F.col("frame").alias("link"), F.col("r").alias("lr"), F.col("t").alias("lt"))
    up = j.join(ancestors(frames), ["world", "frame"]).join(link, ["world", "link"])
    # the point in the link's own axes, on which its turns act
    up = up.withColumn("q", turned(F.col("lr"), plus(F.col("at"), F.col("lt"), -1.0), back=True))
    lr, q = F.col("lr"), F.col("q")
    rows = []
    for i in range(3):
        for k in range(3):
            a, b = (k + 1) % 3, (k + 2) % 3
            # the axis k times q has -q_b at a and q_a at b
            rows += [(i, F.concat(F.col("link"), F.lit("." + TANGENT[k])), lr[3 * i + k]), (i, F.concat(F.col("link"), F.lit("." + TANGENT[3 + k])), lr[3 * i + b] * q[a] - lr[3 * i + a] * q[b])]
    through = up.select("world", cell(rows))
    return own.unionByName(through).select("world", F.col("g.r_").alias("r"), "g.c", "g.v").filter("v <> 0")

"""Registration of scans onto a scene's Gaussian primitives, over the cluster: expectation steps are joins, the rest sums.

points (scan, scene, p, x, y, z) are seen in a scan's own frame; primitives (scene, k, element, px, py, pz, cxx ... czz, w) make a
mixture together with uniform outliers. A scan may see several scenes, such as rooms, each point one of them; it has one pose
for all. A pose turns about the vertical and shifts. Primitives stand in every cell of a
grid that lies within CUT deviations; a point meets those of its cell alone, so no task or driver holds points times
primitives. What the maximization needs is a fixed number of sums over points (of the precisions that a point sees, with its
coordinates), so shifts are solved and turns stepped on one row a pose. All poses, of all scans and starts, go through
a round together; a step that does not lower its pose's likelihood is halved, the others go on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import det3, inv3
from plumbline.operators.graph import dropped, stored

#: Deviations beyond which a primitive's density (below e^-32 of its peak) is not looked at.
CUT = 8.0
#: Spreads added to primitives in the coarse and the fine stage, share of outliers, starts, gate.
COARSE, FINE, OUTLIERS, STARTS, ACCEPT = 0.08, 0.03, 0.05, 8, 6.0
UPPER = ("xx", "xy", "xz", "yy", "yz", "zz")
_AT = {a: UPPER.index("".join(sorted(a))) for a in ("xx", "xy", "xz", "yx", "yy", "yz", "zx", "zy", "zz")}
#: Sums over the points of a pose: precision, its products with the point's coordinates, and with targets.
SUMS = [f"a{u}" for u in UPPER] + [f"b{d}" for d in "xyz"] + [f"{n}{d}" for n in "uvw" for d in "xyz"] + ["uau", "uav", "vav", "uaw", "vaw", "ub", "vb"]


def mixture(primitives: DataFrame, sigma: float, outliers: float = OUTLIERS) -> DataFrame:
    """(scene, k, element, px, py, pz, i (precision, upper), q (precision times mean), peak, floor, reach) of the smoothed mixture."""
    cov = {u: F.col(f"c{u}") + (sigma**2 if u[0] == u[1] else 0.0) for u in UPPER}
    m = primitives.withColumn("m", F.array(*(cov["".join(sorted(a + b))] for a in "xyz" for b in "xyz")))
    m = m.withColumns({"inv": F.expr(inv3("m")), "det": F.expr(det3("m"))})
    scene = primitives.groupBy("scene").agg(F.sum("w").alias("mass"), *((F.max(f"p{d}") - F.min(f"p{d}") + 2).alias(f"s{d}") for d in "xyz"))
    m = m.join(scene, "scene")
    i = [F.col("inv")[k] for k in (0, 1, 2, 4, 5, 8)]
    q = [sum((i[_AT[a + b]] * F.col(f"p{b}") for b in "xyz"), F.lit(0.0)) for a in "xyz"]
    peak = F.log(F.lit(1 - outliers) * F.col("w") / F.col("mass")) - 0.5 * (3 * math.log(2 * math.pi) + F.log("det"))
    reach = CUT * F.sqrt(F.greatest(*(cov[u] for u in ("xx", "yy", "zz"))) + F.abs(cov["xy"]) + F.abs(cov["xz"]) + F.abs(cov["yz"]))  # no eigenvalue is larger
    return m.select("scene", "k", "element", "px", "py", "pz", F.array(*i).alias("i"), F.array(*q).alias("q"), peak.alias("peak"), (outliers / (F.col("sx") * F.col("sy") * F.col("sz"))).alias("floor"), reach.alias("reach"))


def _cells(model: DataFrame, cell: float) -> DataFrame:
    for d in "xyz":
        model = model.withColumn(f"g{d}", F.explode(F.sequence(F.floor((F.col(f"p{d}") - F.col("reach")) / cell), F.floor((F.col(f"p{d}") + F.col("reach")) / cell))))
    return model


def seen(points: DataFrame, poses: DataFrame, model: DataFrame, cell: float) -> DataFrame:
    """Points at their poses (scan, start, theta, tx, ty, tz) with each primitive near them: density e, distance m2; far points once, without one."""
    c, s = F.cos("theta"), F.sin("theta")
    at = {"ax": c * F.col("x") - s * F.col("y") + F.col("tx"), "ay": s * F.col("x") + c * F.col("y") + F.col("ty"), "az": F.col("z") + F.col("tz")}
    p = points.join(poses, "scan").withColumns(at).withColumns({f"g{d}": F.floor(F.col(f"a{d}") / cell) for d in "xyz"})
    j = p.join(_cells(model, cell).drop("floor"), ["scene", "gx", "gy", "gz"], "left")
    d = {a: F.col(f"a{a}") - F.col(f"p{a}") for a in "xyz"}
    m2 = sum((F.col("i")[_AT[a + b]] * d[a] * d[b] for a in "xyz" for b in "xyz"), F.lit(0.0))
    j = j.withColumn("m2", m2).withColumn("e", F.when(F.col("k").isNull(), 0.0).otherwise(F.exp(F.col("peak") - F.col("m2") / 2)))
    return j.join(model.select("scene", "floor").distinct(), "scene")


def expect(points: DataFrame, poses: DataFrame, model: DataFrame, cell: float) -> DataFrame:
    """(scan, start, n, nll, SUMS): one row a pose; nll is the mean over its points."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    near = seen(points, poses, model, cell)
    g = near.groupBy("scan", "start", "p").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"), F.first("floor").alias("floor"), F.sum("e").alias("e"),
        *(F.sum(zero(F.col("e") * F.col("i")[k])).alias(f"a{u}") for k, u in enumerate(UPPER)), *(F.sum(zero(F.col("e") * F.col("q")[k])).alias(f"b{d}") for k, d in enumerate("xyz")),
    )
    total = F.col("e") + F.col("floor")
    g = g.withColumns({"nll": -F.log(total)} | {f"a{u}": F.col(f"a{u}") / total for u in UPPER} | {f"b{d}": F.col(f"b{d}") / total for d in "xyz"})
    a = lambda r, v: sum((F.col(f"a{UPPER[_AT[r + d]]}") * v[d] for d in v), F.lit(0.0))
    forms = {"u": {"x": F.col("x"), "y": F.col("y")}, "v": {"x": -F.col("y"), "y": F.col("x")}, "w": {"z": F.col("z")}}
    times = {f"{n}{r}": a(r, v) for n, v in forms.items() for r in "xyz"}
    dot = lambda n, of: sum((forms[n][d] * of(d) for d in forms[n]), F.lit(0.0))
    quad = {f"{n}a{m}": dot(n, lambda d, m=m: times[f"{m}{d}"]) for n, m in ("uu", "uv", "vv", "uw", "vw")}
    quad |= {f"{n}b": dot(n, lambda d: F.col(f"b{d}")) for n in "uv"}
    g = g.withColumns(times | quad)
    return g.groupBy("scan", "start").agg(F.count("*").alias("n"), F.avg("nll").alias("nll"), *(F.sum(s).alias(s) for s in SUMS))


def _shift(theta: Column) -> list[Column]:
    """The shift that fits best at a turn, from the sums."""
    right = [F.col(f"b{d}") - F.cos(theta) * F.col(f"u{d}") - F.sin(theta) * F.col(f"v{d}") - F.col(f"w{d}") for d in "xyz"]
    inv = F.col("inv")
    return [sum((inv[3 * r + c] * right[c] for c in range(3)), F.lit(0.0)) for r in range(3)]


def propose(poses: DataFrame) -> DataFrame:
    """poses (..., theta, alpha, SUMS) with the next turn and shift: a Gauss-Newton step of the turn, alpha of it, and the best shift."""
    p = poses.withColumn("m", F.array(*(F.col(f"a{UPPER[_AT[a + b]]}") for a in "xyz" for b in "xyz"))).withColumn("inv", F.expr(inv3("m")))
    p = p.withColumn("t0", F.array(*_shift(F.col("theta"))))
    c, s = F.cos("theta"), F.sin("theta")
    moved = lambda n: sum((F.col(f"{n}{d}") * F.col("t0")[k] for k, d in enumerate("xyz")), F.lit(0.0))
    grad = -s * (c * F.col("uau") + s * F.col("uav") + F.col("uaw") + moved("u")) + c * (c * F.col("uav") + s * F.col("vav") + F.col("vaw") + moved("v")) + s * F.col("ub") - c * F.col("vb")
    p = p.withColumn("grad", grad).withColumn("hess", s * s * F.col("uau") - 2 * s * c * F.col("uav") + c * c * F.col("vav"))
    p = p.withColumn("next", F.col("theta") + F.when(F.col("hess") > 0, -F.col("alpha") * F.col("grad") / F.col("hess")).otherwise(0.0))
    t = _shift(F.col("next"))
    # a pose that sees nothing stays where it is
    return p.withColumns({f"n{d}": F.coalesce(t[k], F.col(f"t{d}")) for k, d in enumerate("xyz")}).drop("m", "inv", "t0", "grad", "hess")


def climb(points: DataFrame, poses: DataFrame, model: DataFrame, cell: float, rounds: int, tol: float = 1e-9) -> DataFrame:
    """poses (scan, start, theta, tx, ty, tz) moved uphill for at most ``rounds``, with n, nll and the sums there."""
    keep = ["scan", "start", "theta", "tx", "ty", "tz", "n", "nll", *SUMS]
    now = stored(poses.join(expect(points, poses, model, cell), ["scan", "start"]).select(*keep, F.lit(1.0).alias("alpha"), F.lit(False).alias("done")))
    for _ in range(rounds):
        if now.filter("NOT done").isEmpty():
            break
        tried = stored(propose(now.filter("NOT done")).select("scan", "start", F.col("next").alias("theta"), F.col("nx").alias("tx"), F.col("ny").alias("ty"), F.col("nz").alias("tz")))
        after = tried.join(expect(points, tried, model, cell), ["scan", "start"])
        after = after.select("scan", "start", *(F.col(c).alias(f"{c}_") for c in keep[2:]))
        j = now.join(after, ["scan", "start"], "left")
        better = F.col("nll_").isNotNull() & (F.col("nll_") <= F.col("nll") + 1e-15)
        settled = F.col("done") | (better & (F.col("nll") - F.col("nll_") < tol)) | (~better & (F.col("alpha") < 1e-6))
        alpha = F.when(better, 1.0).otherwise(F.col("alpha") / 2)
        new = j.select("scan", "start", *(F.when(better, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in keep[2:]), alpha.alias("alpha"), settled.alias("done"))
        before, now = now, stored(new)
        dropped(before, tried)
    return now.select(*keep)


def register(points: DataFrame, primitives: DataFrame, starts: int = STARTS, coarse: float = COARSE, fine: float = FINE, rounds: tuple[int, int, int] = (6, 30, 30), cell: float = 1.0, accept: float = ACCEPT) -> DataFrame:
    """(scan, theta, tx, ty, tz, nll, accepted, info): each scan's pose, from several turns, coarse and then fine.

    ``info`` is the information of (turn, shift), row by row. Scans of fewer than ten points are an error.
    """
    few = points.groupBy("scan").count().filter("count < 10").select(F.min("scan")).first()[0]
    if few is not None:
        raise ValueError(f"scan {few} has too few points")
    middle = points.groupBy("scan", "scene").agg(F.count("*").alias("n"), *(F.sum(d).alias(d) for d in "xyz")).join(primitives.groupBy("scene").agg(*(F.avg(f"p{d}").alias(f"p{d}") for d in "xyz")), "scene")
    middle = middle.groupBy("scan").agg(*((F.sum(d) / F.sum("n")).alias(d) for d in "xyz"), *((F.sum(F.col("n") * F.col(f"p{d}")) / F.sum("n")).alias(f"p{d}") for d in "xyz"))
    first = middle.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("theta", F.col("start") * (2 * math.pi / starts))
    c, s = F.cos("theta"), F.sin("theta")
    poses = stored(first.select("scan", "start", "theta", (F.col("px") - c * F.col("x") + s * F.col("y")).alias("tx"), (F.col("py") - s * F.col("x") - c * F.col("y")).alias("ty"), (F.col("pz") - F.col("z")).alias("tz")))
    wide, narrow = stored(mixture(primitives, coarse)), stored(mixture(primitives, fine))
    tried = climb(points, poses, wide, cell, rounds[0])
    best = tried.groupBy("scan").agg(F.min(F.struct(F.round("nll", 9).alias("nll"), "start")).alias("b")).select("scan", F.col("b.start").alias("start"))
    poses = tried.join(best, ["scan", "start"]).select("scan", "start", "theta", "tx", "ty", "tz")
    poses = climb(points, stored(poses), wide, cell, rounds[1]).select("scan", "start", "theta", "tx", "ty", "tz")
    done = climb(points, stored(poses), narrow, cell, rounds[2])
    c, s = F.cos("theta"), F.sin("theta")
    turn = s * s * F.col("uau") - 2 * s * c * F.col("uav") + c * c * F.col("vav")
    cross = [-s * F.col(f"u{d}") + c * F.col(f"v{d}") for d in "xyz"]
    info = [turn, *cross]
    for k, d in enumerate("xyz"):
        info += [cross[k], *(F.col(f"a{UPPER[_AT[d + e]]}") for e in "xyz")]
    return done.select("scan", "theta", "tx", "ty", "tz", "nll", (F.col("nll") < accept).alias("accepted"), F.array(*info).alias("info"))


def evidence(points: DataFrame, poses: DataFrame, primitives: DataFrame, fine: float = FINE, cell: float = 1.0) -> DataFrame:
    """What accepted scans (scan, theta, tx, ty, tz, accepted) say of each element: (scan, element, primitives, effective_points, fraction,
    mean_m2, diversity, confidence); elements that no point supports have zeros. A scan that was not accepted is an error."""
    theta = F.when(F.col("accepted"), F.col("theta")).otherwise(F.raise_error(F.concat(F.lit("no evidence from scan "), F.col("scan").cast("string"), F.lit(": it failed the fit gate"))))
    poses = poses.select("scan", F.lit(0).alias("start"), theta.alias("theta"), "tx", "ty", "tz")
    near = stored(seen(points, poses, stored(mixture(primitives, fine)), cell).filter("k IS NOT NULL").select("scan", "scene", "p", "k", "element", "m2", "e", "floor"))
    total = near.groupBy("scan", "p").agg((F.sum("e") + F.first("floor")).alias("total"), F.sum("e").alias("all"))
    g = stored(near.join(total, ["scan", "p"]).select("scan", "scene", "p", "k", "element", "m2", (F.col("e") / F.col("total")).alias("g"), (F.col("all") / F.col("total")).alias("inlier")))
    by_primitive = g.groupBy("scan", "scene", "element", "k").agg(F.sum("g").alias("g"), F.sum(F.col("g") * F.col("m2")).alias("gm"))
    mass = by_primitive.groupBy("scan", "element").agg(F.sum("g").alias("n"), F.sum(F.col("g") ** 2).alias("g2"), F.sum("gm").alias("gm"))
    share = g.groupBy("scan", "p", "element").agg(F.sum("g").alias("g"), F.first("inlier").alias("inlier")).groupBy("scan", "element").agg(F.sum(F.when(F.col("inlier") > 0, F.col("g") ** 2 / F.col("inlier"))).alias("c"))
    sizes = primitives.groupBy("scene", "element").agg(F.count("*").alias("primitives"))
    sizes = points.select("scan", "scene").distinct().join(sizes, "scene").groupBy("scan", "element").agg(F.sum("primitives").alias("primitives"))
    each = sizes.join(mass, ["scan", "element"], "left").join(share, ["scan", "element"], "left")
    whole = each.join(mass.groupBy("scan").agg(F.sum("n").alias("every")), "scan", "left")
    some = lambda x: F.when(F.col("n") > 0, x).otherwise(0.0)
    return whole.select(
        "scan", "element", "primitives", F.coalesce("n", F.lit(0.0)).alias("effective_points"), some(F.col("n") / F.col("every")).alias("fraction"), some(F.col("gm") / F.col("n")).alias("mean_m2"),
        some(F.col("n") ** 2 / (F.col("primitives") * F.col("g2"))).alias("diversity"), some(F.col("c") / F.col("n")).alias("confidence"),
    )

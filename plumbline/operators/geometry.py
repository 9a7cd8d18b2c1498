"""Boxes, Gaussian primitives and their pairs.

Boxes are (id, x, y, z, angle, ex, ey, ez): centre, yaw and full extents. Pairs of near boxes come from a grid: a box enters
every cell that its padded bounds touch, cells are joined on equality, and a pair is kept in the first cell that both
touch, so that no pair is made twice and none without a common cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import erf_sql, lit, normal_cdf

PENETRATION = 0.01


def bounds(boxes: DataFrame) -> DataFrame:
    """Axis-parallel bounds of yawed boxes."""
    c, s = F.abs(F.cos("angle")), F.abs(F.sin("angle"))
    hx, hy, hz = (F.col("ex") * c + F.col("ey") * s) / 2, (F.col("ex") * s + F.col("ey") * c) / 2, F.col("ez") / 2
    return boxes.withColumns({"x0": F.col("x") - hx, "x1": F.col("x") + hx, "y0": F.col("y") - hy, "y1": F.col("y") + hy, "z0": F.col("z") - hz, "z1": F.col("z") + hz})


def near_pairs(boxes: DataFrame, clearance: float, cell: float, by: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b) with a < b whose bounds, each padded by half the clearance, overlap; within equal ``by`` if given.

    Columns of both boxes that are named in ``keep`` come along as ``<name>_a`` and ``<name>_b``: pairs, which are many more than
    boxes, need no join to look at them. Boxes are dealt by their cells over as many tasks as a shuffle has partitions, however few
    bytes they take: pairs grow with the square of a cell's boxes, and plans gather or broadcast what looks small.
    """
    pad, key = clearance / 2, ("part", "cx", "cy", "cz") if by else ("cx", "cy", "cz")
    b = bounds(boxes)
    p = b.select("id", *keep, *((F.col(by).alias("part"),) if by else ()), *((F.col(f"{d}0") - pad).alias(f"{d}0") for d in "xyz"), *((F.col(f"{d}1") + pad).alias(f"{d}1") for d in "xyz"))
    for d in "xyz":
        p = p.withColumn(f"c{d}", F.explode(F.sequence(F.floor(F.col(f"{d}0") / cell), F.floor(F.col(f"{d}1") / cell))))
    many = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (p.select(*key, *(F.col(c).alias(f"{c}_{x}") for c in ("id", "x0", "x1", "y0", "y1", "z0", "z1", *keep))).repartition(many, *key) for x in "ab")
    on = [left[c] == right[c] for c in key] + [F.col("id_a") < F.col("id_b")]
    for d in "xyz":
        on += [F.col(f"{d}0_a") <= F.col(f"{d}1_b"), F.col(f"{d}0_b") <= F.col(f"{d}1_a"), left[f"c{d}"] == F.floor(F.greatest(f"{d}0_a", f"{d}0_b") / cell)]
    return left.join(right.hint("merge"), on).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), *(f"{c}_{x}" for x in "ab" for c in keep))


def without(pairs: DataFrame, exempt: DataFrame) -> DataFrame:
    """Pairs that are not listed (in either order) in exempt (a, b)."""
    both = exempt.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


#: What a clearance needs of a box.
SHAPE = ("x", "y", "z", "angle", "ex", "ey", "ez")


def gap() -> Column:
    """The greatest gap of two boxes over their separating axes, from both boxes' SHAPE."""
    reach = lambda t, x: (F.abs(F.cos(t - F.col(f"angle_{x}"))) * F.col(f"ex_{x}") + F.abs(F.sin(t - F.col(f"angle_{x}"))) * F.col(f"ey_{x}")) / 2
    axes = [F.col(f"angle_{x}") + turn for x in "ab" for turn in (0.0, 3.141592653589793 / 2)]
    gaps = [F.abs((F.col("x_a") - F.col("x_b")) * F.cos(t) + (F.col("y_a") - F.col("y_b")) * F.sin(t)) - reach(t, "a") - reach(t, "b") for t in axes]
    up = F.abs(F.col("z_a") - F.col("z_b")) - (F.col("ez_a") + F.col("ez_b")) / 2
    return F.greatest(*gaps, up)


def clearances(pairs: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """(a, b, clearance): the greatest gap over the separating axes (three of the world and the boxes' own), negative if they overlap.

    Without ``boxes`` the pairs bring both boxes' SHAPE along (``near_pairs`` with ``keep``), and nothing is joined.
    """
    if boxes is None:
        p = pairs
    else:
        side = lambda x: boxes.select(*(F.col(c).alias(f"{c}_{x}" if c != "id" else x) for c in ("id", *SHAPE)))
        p = pairs.join(side("a"), "a").join(side("b"), "b")
    kept = [c for c in pairs.columns if c not in ("a", "b") and c.rsplit("_", 1)[0] not in SHAPE]
    return p.select("a", "b", *kept, gap().alias("clearance"))


def clash(clear: DataFrame, sd: float, ordered: bool = True) -> DataFrame:
    """clear (a, b, clearance) with the probability that the boxes clash by more than the tolerance, likeliest first if asked for."""
    out = clear.withColumn("p_clash", normal_cdf(-(F.col("clearance") + PENETRATION) / sd))
    return out.orderBy(F.desc("p_clash"), "a", "b") if ordered else out


def proposed(boxes: DataFrame, proposal: dict[str, float], clearance: float, sd: float) -> DataFrame:
    """(id, clearance, p_violation) of each box against one proposed box; the proposal is a row of constants, no join."""
    b = boxes
    axes = lambda angle: [F.lit(proposal["angle"]), F.lit(proposal["angle"] + 3.141592653589793 / 2), F.col(angle), F.col(angle) + 3.141592653589793 / 2]
    reach = lambda t, angle, ex, ey: (F.abs(F.cos(t - angle)) * ex + F.abs(F.sin(t - angle)) * ey) / 2
    gaps = [F.abs((F.col("x") - proposal["x"]) * F.cos(t) + (F.col("y") - proposal["y"]) * F.sin(t)) - reach(t, F.col("angle"), F.col("ex"), F.col("ey")) - reach(t, F.lit(proposal["angle"]), F.lit(proposal["ex"]), F.lit(proposal["ey"])) for t in axes("angle")]
    up = F.abs(F.col("z") - proposal["z"]) - (F.col("ez") + proposal["ez"]) / 2
    return b.select("id", F.greatest(*gaps, up).alias("clearance")).withColumn("p_violation", normal_cdf((F.lit(clearance) - F.col("clearance")) / sd))


def tile(boxes: DataFrame, spacing: float) -> DataFrame:
    """Gaussian primitives on a grid in each box: centre, variances along the box's axes, covariance in the world, weight (volume share)."""
    n = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / spacing).cast("int"))
    t = boxes.withColumns({"nx": n("ex"), "ny": n("ey"), "nz": n("ez")})
    for d in "xyz":
        t = t.withColumn(f"k{d}", F.explode(F.sequence(F.lit(0), F.col(f"n{d}") - 1)))
    at = lambda d: (F.col(f"k{d}") + 0.5) / F.col(f"n{d}") * F.col(f"e{d}") - F.col(f"e{d}") / 2
    var = lambda d: (F.col(f"e{d}") / (2 * F.col(f"n{d}"))) ** 2 / 3
    c, s = F.cos("angle"), F.sin("angle")
    return t.select(
        "id", "kx", "ky", "kz", (F.col("x") + at("x") * c - at("y") * s).alias("px"), (F.col("y") + at("x") * s + at("y") * c).alias("py"), (F.col("z") + at("z")).alias("pz"),
        var("x").alias("vx"), var("y").alias("vy"), var("z").alias("vz"),
        (c * c * var("x") + s * s * var("y")).alias("cxx"), (c * s * (var("x") - var("y"))).alias("cxy"), F.lit(0.0).alias("cxz"), (s * s * var("x") + c * c * var("y")).alias("cyy"), F.lit(0.0).alias("cyz"), var("z").alias("czz"),
        (F.col("ex") * F.col("ey") * F.col("ez") / (F.col("nx") * F.col("ny") * F.col("nz"))).alias("w"),
    )


def moment_match(primitives: DataFrame, by: list[str]) -> DataFrame:
    """One Gaussian per group of primitives (px, py, pz, cxx, cxy, cxz, cyy, cyz, czz, w): weight, mean, covariance (upper triangle)."""
    w = F.col("w")
    sums = [F.sum(w).alias("w")] + [F.sum(w * F.col(f"p{d}")).alias(f"m{d}") for d in "xyz"]
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums += [F.sum(w * (F.col(f"p{a}") * F.col(f"p{b}") + F.col(f"c{a}{b}"))).alias(f"s{a}{b}") for a, b in pairs]
    g = primitives.groupBy(*by).agg(*sums)
    mean = {d: F.col(f"m{d}") / F.col("w") for d in "xyz"}
    return g.select(*by, "w", *(mean[d].alias(f"mean_{d}") for d in "xyz"), *((F.col(f"s{a}{b}") / F.col("w") - mean[a] * mean[b]).alias(f"cov_{a}{b}") for a, b in pairs))


def levels_of_detail(primitives: DataFrame, outer: str, inner: str) -> DataFrame:
    """The match per inner group, per outer group and overall, in one rollup."""
    w = F.col("w")
    g = primitives.rollup(outer, inner).agg(F.grouping_id().alias("level"), F.sum("w").alias("w_sum"), *(F.sum(w * F.col(f"p{d}")).alias(f"m{d}") for d in "xyz"), *(F.sum(w * (F.col(f"p{d}") ** 2 + F.col(f"c{d}{d}"))).alias(f"s{d}") for d in "xyz"))
    return g.select(outer, inner, "level", F.col("w_sum").alias("w"), *((F.col(f"m{d}") / F.col("w_sum")).alias(f"mean_{d}") for d in "xyz"), *((F.col(f"s{d}") / F.col("w_sum") - (F.col(f"m{d}") / F.col("w_sum")) ** 2).alias(f"var_{d}") for d in "xyz"))


def overlap(pairs: DataFrame) -> DataFrame:
    """pairs (dx, dy, dz, sx, sy, sz, wa, wb) of diagonal Gaussians, s being summed variances: Mahalanobis square and overlap integral."""
    m2 = F.col("dx") ** 2 / F.col("sx") + F.col("dy") ** 2 / F.col("sy") + F.col("dz") ** 2 / F.col("sz")
    norm = F.sqrt(F.lit(2 * 3.141592653589793) ** 3 * F.col("sx") * F.col("sy") * F.col("sz"))
    return pairs.withColumn("m2", m2).withColumn("overlap", F.col("wa") * F.col("wb") * F.exp(-F.col("m2") / 2) / norm)


def attention(pairs: DataFrame) -> DataFrame:
    """pairs (i, j, logit): softmax over each row, the diagonal left out; a row without finite logits gets zeros."""
    p = pairs.filter("i <> j")
    row = Window.partitionBy("i")
    e = F.when(F.col("logit").isNull() | (F.col("logit") == float("-inf")), 0.0).otherwise(F.exp(F.col("logit") - F.max("logit").over(row)))
    p = p.withColumn("e", e).withColumn("s", F.sum("e").over(row))
    return p.select("i", "j", F.when(F.col("s") > 0, F.col("e") / F.nullif(F.col("s"), F.lit(0.0))).otherwise(0.0).alias("alpha"))


def propagate(values: DataFrame, alpha: DataFrame, rate: float, rounds: int) -> DataFrame:
    """values (i, v): each round moves a value by rate times (the weighted mean of others less its own), weights frozen."""
    for _ in range(rounds):
        mixed = alpha.join(values.select(F.col("i").alias("j"), F.col("v").alias("vj")), "j").groupBy("i").agg(F.sum(F.col("alpha") * F.col("vj")).alias("m"), F.sum("alpha").alias("mass"))
        values = values.join(mixed, "i", "left").select("i", (F.col("v") + rate * (F.coalesce("m", F.lit(0.0)) - F.coalesce("mass", F.lit(0.0)) * F.col("v"))).alias("v"))
    return values


def polygon(vertices: DataFrame, by: list[str]) -> DataFrame:
    """vertices (..., n, x, y) in order: signed area, centroid and second moments about the axes, by the shoelace rule."""
    ring = Window.partitionBy(*by).orderBy("n")
    whole = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in ("x", "y"))
    e = vertices.withColumns({"nx": nx, "ny": ny})
    cross = F.col("x") * F.col("ny") - F.col("nx") * F.col("y")
    e = e.withColumn("cross", cross)
    g = e.groupBy(*by).agg((F.sum("cross") / 2).alias("area"), F.sum((F.col("x") + F.col("nx")) * F.col("cross")).alias("sx"), F.sum((F.col("y") + F.col("ny")) * F.col("cross")).alias("sy"), (F.sum((F.col("y") ** 2 + F.col("y") * F.col("ny") + F.col("ny") ** 2) * F.col("cross")) / 12).alias("ixx"), (F.sum((F.col("x") ** 2 + F.col("x") * F.col("nx") + F.col("nx") ** 2) * F.col("cross")) / 12).alias("iyy"))
    return g.select(*by, "area", (F.col("sx") / (6 * F.col("area"))).alias("cx"), (F.col("sy") / (6 * F.col("area"))).alias("cy"), "ixx", "iyy")


# --- whole covariances: six entries of a symmetric 3 x 3 matrix, as SQL text that any engine evaluates alike -----------

SIX = ("xx", "xy", "xz", "yy", "yz", "zz")


def det_sql(m: dict[str, str]) -> str:
    return f"({m['xx']} * ({m['yy']} * {m['zz']} - {m['yz']} * {m['yz']}) - {m['xy']} * ({m['xy']} * {m['zz']} - {m['yz']} * {m['xz']}) + {m['xz']} * ({m['xy']} * {m['yz']} - {m['yy']} * {m['xz']}))"


def inverse_sql(m: dict[str, str]) -> dict[str, str]:
    """The inverse by cofactors; without one every entry is null."""
    minor = {"xx": "yy zz yz yz", "xy": "xz yz xy zz", "xz": "xy yz xz yy", "yy": "xx zz xz xz", "yz": "xy xz xx yz", "zz": "xx yy xy xy"}
    out = {}
    for k, names in minor.items():
        a, b, c, d = (m[n] for n in names.split())
        out[k] = f"(({a} * {b} - {c} * {d}) / nullif({det_sql(m)}, 0e0))"
    return out


def form_sql(m: dict[str, str], u: dict[str, str], v: dict[str, str]) -> str:
    """u' m v."""
    return "(" + " + ".join(f"{u[a]} * {m[min(a, b) + max(a, b)]} * {v[b]}" for a in "xyz" for b in "xyz") + ")"


def mahalanobis_sql(d: dict[str, str], s: dict[str, str]) -> str:
    return form_sql(inverse_sql(s), d, d)


def log_product_sql(d: dict[str, str], s: dict[str, str]) -> str:
    """The logarithm of the integral of the product of two Gaussians, with difference d and summed covariance s."""
    return f"(-0.5e0 * (3 * ln(2 * pi()) + ln({det_sql(s)}) + {mahalanobis_sql(d, s)}))"


def bhattacharyya_sql(d: dict[str, str], p: dict[str, str], q: dict[str, str]) -> str:
    mean = {k: f"(({p[k]} + {q[k]}) / 2)" for k in SIX}
    return f"({mahalanobis_sql(d, mean)} / 8 + 0.5e0 * (ln({det_sql(mean)}) - 0.5e0 * (ln({det_sql(p)}) + ln({det_sql(q)}))))"


def kl_sql(d: dict[str, str], p: dict[str, str], q: dict[str, str]) -> str:
    """KL(p || q) of two Gaussians, d being the difference of their means."""
    i = inverse_sql(q)
    trace = " + ".join(f"{2 if k[0] != k[1] else 1} * {i[k]} * {p[k]}" for k in SIX)
    return f"(0.5e0 * ({trace} + {form_sql(i, d, d)} - 3 + ln({det_sql(q)}) - ln({det_sql(p)})))"


def ray_depth_sql(d: dict[str, str], s: dict[str, str], u: tuple[float, float, float], length: float) -> str:
    """The integral of a Gaussian of covariance s along a ray of unit direction u, d being the ray's origin less the mean."""
    i, way = inverse_sql(s), dict(zip("xyz", map(lit, u), strict=True))
    a, b, c = form_sql(i, way, way), form_sql(i, way, d), form_sql(i, d, d)
    span = f"({erf_sql(f'(({a} * {lit(length)} + {b}) / sqrt(2 * {a}))')} - {erf_sql(f'({b} / sqrt(2 * {a}))')})"
    return f"(power(2 * pi(), -1.5e0) / sqrt({det_sql(s)}) * exp(-0.5e0 * ({c} - {b} * {b} / {a})) * sqrt(pi() / (2 * {a})) * {span})"


def support_radius_sql(u: tuple[float, float, float]) -> str:
    """How far a yawed box (angle, ex, ey, ez) reaches from its centre along u."""
    x, y, z = map(lit, u)
    return f"(abs({x} * cos(angle) + {y} * sin(angle)) * ex / 2 + abs({y} * cos(angle) - {x} * sin(angle)) * ey / 2 + abs({z}) * ez / 2)"


def extent_jacobian(boxes: DataFrame, fx: str = "fx", fy: str = "fy", fz: str = "fz") -> DataFrame:
    """How a point at fractions (fx, fy, fz, from -0.5 to 0.5) of a box moves with its extents and its yaw."""
    c, s, lx, ly = F.cos("angle"), F.sin("angle"), F.col(fx) * F.col("ex"), F.col(fy) * F.col("ey")
    return boxes.withColumns({
        "dx_dex": c * F.col(fx), "dy_dex": s * F.col(fx), "dx_dey": -s * F.col(fy), "dy_dey": c * F.col(fy), "dz_dez": F.col(fz),
        "dx_dangle": -s * lx - c * ly, "dy_dangle": c * lx - s * ly,
    })


def moved(primitives: DataFrame, angle: float, shift: tuple[float, float, float], scale: float = 1.0) -> DataFrame:
    """Primitives under a turn about z, a scale and a shift; weights scale as volumes."""
    import math

    c, s = scale * math.cos(angle), scale * math.sin(angle)
    m = [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, scale]]
    cov = lambda a, b: F.col("c" + "".join(sorted("xyz"[a] + "xyz"[b])))
    total = lambda terms: sum(terms[1:], terms[0])
    point = {f"p{d}": total([F.col(f"p{e}") * m[i][j] for j, e in enumerate("xyz")]) + shift[i] for i, d in enumerate("xyz")}
    spread = {"c" + "xyz"[i] + "xyz"[k]: total([cov(a, b) * (m[i][a] * m[k][b]) for a in range(3) for b in range(3)]) for i in range(3) for k in range(i, 3)}
    return primitives.withColumns({**point, **spread, "w": F.col("w") * abs(scale) ** 3})


def payload(primitives: DataFrame, by: str, value: str) -> DataFrame:
    """(by, payload): the mean of a value of primitives, by weight."""
    return primitives.groupBy(by).agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("payload"))

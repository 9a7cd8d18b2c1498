"""Lowering: STEP tables to worlds with raw and derived quantities, structural edges and constraints, a world a file.

Names of variables are "<global id>.<quantity>". Files that break a rule are told by :func:`faults`, with the reason, and
left out; the others are lowered together, with joins on the file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import Expr, const, var
from plumbline.operators import belief, derive, verify
from plumbline.operators.graph import stored
from plumbline.sources import scene, step
from plumbline.sources.scene import _json

#: Resistance factor of the bending check, and newtons per square metre in a megapascal.
RESISTANCE, MEGA = 0.9, 1e6
BEAM_NEEDS = ("YieldStrengthMPa", "PlasticSectionModulusMajorM3")
#: Derived quantities of one product. "storey" is the file's storey, other names are the product's own.
RULES: dict[str, dict[str, Expr]] = {
    "IFCOPENINGELEMENT": {"Area": var("Width") * var("Height")},
    "IFCDOOR": {"Area": var("Width") * var("Height")},
    "IFCWALL": {
        "Height": var("storey.ClearHeight"), "GrossSideArea": var("Length") * var("Height"), "GrossVolume": var("GrossSideArea") * var("Width"),
        "NetVolume": var("NetSideArea") * var("Width"), "Cost": var("NetVolume") * var("UnitCost"),
    },
    "IFCSPACE": {"FloorArea": var("Length") * var("Width"), "Volume": var("FloorArea") * var("storey.ClearHeight")},
    "IFCBEAM": {"NominalMomentCapacity": const(MEGA) * (var("YieldStrengthMPa") * var("PlasticSectionModulusMajorM3")), "DesignMomentCapacity": const(RESISTANCE) * var("NominalMomentCapacity")},
}
#: Sums of a storey over what an edge leads to: (edge, class, quantity summed, sum).
TOTALS = (("contains", "IFCWALL", "NetVolume", "TotalWallNetVolume"), ("contains", "IFCWALL", "Cost", "TotalWallCost"), ("aggregates", "IFCSPACE", "FloorArea", "TotalFloorArea"))
#: Bounds (class, edge, class of the larger, pairs of smaller and larger quantity).
BOUNDS = (("voids", (("Width", "Length"), ("Height", "Height"))), ("fills", (("Width", "Width"), ("Height", "Height"))))


@dataclass
class Lowered:
    """entities (file, step_id, ifc_class, global_id, name), edges (file, kind, src, dst) by global id, slots (file, i, mu, sigma) of
    raw quantities, terms (world, i, term, coef, refs) of derived ones, bounds (world, lhs, rhs), and restated (world, i, term, coef, refs):
    the second definitions of net areas, volumes and capacities."""

    entities: DataFrame
    edges: DataFrame
    slots: DataFrame
    terms: DataFrame
    bounds: DataFrame
    restated: DataFrame


def products(rows: DataFrame, marker: str = "Structural") -> DataFrame:
    """The products that are lowered: beams only if they have the property set ``marker``."""
    known = step.entities(rows)
    refs = lambda path: F.transform(F.regexp_extract_all(_json(path), F.lit(r'"ref":\s*(\d+)'), 1), lambda x: x.cast("long"))
    sets = step.by_type(rows, "IFCPROPERTYSET").filter(_json("$[2]") == marker).select("file", F.col("step_id").alias("set"))
    marked = step.by_type(rows, "IFCRELDEFINESBYPROPERTIES").select("file", _json("$[5].ref").cast("long").alias("set"), F.explode(refs("$[4]")).alias("step_id")).join(sets, ["file", "set"]).select("file", "step_id").distinct()
    return known.filter("ifc_class <> 'IFCBEAM'").unionByName(known.filter("ifc_class = 'IFCBEAM'").join(marked, ["file", "step_id"], "left_semi"))


def faults(rows: DataFrame, known: DataFrame, found: DataFrame) -> DataFrame:
    """(file, subject, fault): why a file can't be lowered. ``found`` has the quantities (file, product, quantity, value)."""
    twice = known.groupBy("file", "global_id").count().filter("count > 1").select("file", F.col("global_id").alias("subject"), F.lit("duplicate global id").alias("fault"))
    storeys = known.groupBy("file").agg(F.count_if(F.col("ifc_class") == "IFCBUILDINGSTOREY").alias("n")).filter("n <> 1").select("file", F.col("n").cast("string").alias("subject"), F.lit("not one storey").alias("fault"))
    needs = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for c, qs in step.PRODUCTS.items() for x in (c, (*qs, *(BEAM_NEEDS if c == "IFCBEAM" else ())))))
    want = known.select("file", "step_id", "global_id", F.explode(F.try_element_at(needs, F.col("ifc_class"))).alias("quantity"))
    lost = want.join(found.withColumnRenamed("product", "step_id"), ["file", "step_id", "quantity"], "left_anti").select("file", "global_id", "quantity")
    lost = lost.select("file", F.concat_ws(".", "global_id", "quantity").alias("subject"), F.lit("missing quantity").alias("fault"))
    stands = scene.placement_faults(rows, known).join(known.select("file", "step_id", "global_id"), ["file", "step_id"]).select("file", F.col("global_id").alias("subject"), F.regexp_extract("fault", "^[^:]*", 0).alias("fault"))
    return twice.unionByName(storeys).unionByName(lost).unionByName(stands)


def lower(rows: DataFrame, stated: tuple[str, ...] = ("Posterior", "Uncertainty", "Material", "Structural"), marker: str = "Structural") -> tuple[Lowered, DataFrame]:
    """The worlds of all sound files, and the faults of the others."""
    known = stored(products(rows, marker))
    bad = stored(faults(rows, known, step.quantities(rows)))
    known = stored(known.join(bad.select("file").distinct(), "file", "left_anti"))
    ids = known.select("file", F.col("step_id").alias("n"), "global_id", "ifc_class")
    edges = step.edges(rows, known)
    for end in ("src", "dst"):
        edges = edges.join(ids.select("file", F.col("n").alias(end), F.col("global_id").alias(f"{end}_id"), F.col("ifc_class").alias(f"{end}_class")), ["file", end])
    edges = stored(edges.select("file", "kind", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "src_class", "dst_class").distinct())
    slots = scene.priors(rows, known, stated).join(known.select("file", "step_id", "global_id"), ["file", "step_id"])
    slots = stored(slots.select("file", "global_id", "quantity", F.concat_ws(".", "global_id", "quantity").alias("i"), "mu", "sigma"))
    storey = known.filter("ifc_class = 'IFCBUILDINGSTOREY'").select("file", F.col("global_id").alias("storey"))
    each = known.join(storey, "file")
    priced = slots.filter("quantity = 'UnitCost'").select("file", "global_id")
    of = lambda c, priced_only: each.filter(F.col("ifc_class") == c).join(priced, ["file", "global_id"], "left_semi") if priced_only else each.filter(F.col("ifc_class") == c)
    own = lambda v: F.concat_ws(".", "storey", F.lit(v.split(".")[1])) if v.startswith("storey.") else F.concat_ws(".", "global_id", F.lit(v))
    at = lambda entity, q: F.concat_ws(".", entity, F.lit(q))
    parts = [derive.rules(of(c, q == "Cost"), "file", at("global_id", q), e, own) for c, qs in RULES.items() for q, e in qs.items()]
    parts.append(derive.rules(of("IFCWALL", False), "file", at("global_id", "NetSideArea"), var("GrossSideArea"), own))
    voids = edges.filter("kind = 'voids' AND src_class = 'IFCOPENINGELEMENT' AND dst_class = 'IFCWALL'")
    parts.append(derive.sums(voids, "file", at("dst", "NetSideArea"), at("src", "Area"), -1.0))
    for kind, c, q, total in TOTALS:
        members = edges.filter((F.col("kind") == kind) & (F.col("src_class") == "IFCBUILDINGSTOREY") & (F.col("dst_class") == c))
        if q == "Cost":
            members = members.join(priced.withColumnRenamed("global_id", "dst"), ["file", "dst"], "left_semi")
        parts.append(derive.sums(members, "file", at("src", total), at("dst", q)))
    terms = parts[0]
    for p in parts[1:]:
        terms = terms.unionByName(p)
    bounds = None
    for kind, pairs in BOUNDS:
        for small, large in pairs:
            b = edges.filter(F.col("kind") == kind).select(F.col("file").alias("world"), at("src", small).alias("lhs"), at("dst", large).alias("rhs"))
            bounds = b if bounds is None else bounds.unionByName(b)
    again = [
        derive.rules(of("IFCWALL", False), "file", at("global_id", "NetSideArea"), var("GrossSideArea"), own), derive.sums(voids, "file", at("dst", "NetSideArea"), at("src", "Area"), -1.0),
        derive.rules(of("IFCSPACE", False), "file", at("global_id", "Volume"), (var("Length") * var("Width")) * var("storey.ClearHeight"), own),
        derive.rules(of("IFCBEAM", False), "file", at("global_id", "NominalMomentCapacity"), RULES["IFCBEAM"]["NominalMomentCapacity"], own),
        derive.rules(of("IFCBEAM", False), "file", at("global_id", "DesignMomentCapacity"), RULES["IFCBEAM"]["DesignMomentCapacity"], own),
    ]
    restated = again[0]
    for p in again[1:]:
        restated = restated.unionByName(p)
    return Lowered(known, edges, slots, stored(terms), stored(bounds), stored(restated)), bad


@dataclass
class World:
    """values (world, i, mu, level), jac (world, r, c, v) of derived variables, cov (world, i, k, v) of raw ones, sd (world, i, sd) of all."""

    values: DataFrame
    jac: DataFrame
    cov: DataFrame
    sd: DataFrame
    lowered: Lowered


def compile_(low: Lowered) -> World:
    """All worlds' derived values, gradients and spreads."""
    raw = low.slots.select(F.col("file").alias("world"), "i", "mu")
    cov = low.slots.select(F.col("file").alias("world"), "i", F.col("i").alias("k"), (F.col("sigma") ** 2).alias("v"))
    done = derive.evaluate(raw, low.terms)
    jac = stored(derive.total_jacobian(done))
    var_ = belief.pushforward(jac, cov, variances_only=True).select("world", F.col("r").alias("i"), F.sqrt("v").alias("sd"))
    sd = low.slots.select(F.col("file").alias("world"), "i", F.col("sigma").alias("sd")).unionByName(var_)
    return World(stored(done.values), jac, cov, stored(sd), low)


def constraints(world: World) -> DataFrame:
    """Rows of CONS-01 on all variables, CONS-02 on bounds between products, CONS-03 on restated quantities."""
    full = world.values.select("world", "i", "mu").join(world.sd, ["world", "i"])
    one = verify.finished(verify.cons_01(full), "CONS-01")
    low = world.lowered
    mu = lambda side: world.values.select("world", F.col("i").alias(side), F.col("mu").alias(f"mu_{side}"))
    pairs = low.bounds.withColumn("i", F.concat_ws("<=", "lhs", "rhs")).join(mu("lhs"), ["world", "lhs"]).join(mu("rhs"), ["world", "rhs"])
    # the gradient of the difference, from which its variance follows with all correlations
    rows = world.jac.unionByName(world.values.filter("level = 0").select("world", F.col("i").alias("r"), F.col("i").alias("c"), F.lit(1.0).alias("v")))
    side = lambda s, sign: pairs.select("world", "i", F.col(s).alias("r")).join(rows, ["world", "r"]).select("world", F.col("i").alias("r"), "c", (F.col("v") * sign).alias("v"))
    gradient = side("lhs", 1.0).unionByName(side("rhs", -1.0)).groupBy("world", "r", "c").agg(F.sum("v").alias("v"))
    spread = belief.pushforward(gradient, world.cov, variances_only=True).select("world", F.col("r").alias("i"), "v")
    two = pairs.join(spread, ["world", "i"]).select("world", "i", F.col("mu_lhs").alias("lhs"), F.col("mu_rhs").alias("rhs"), F.col("v").alias("var_lhs"), F.lit(0.0).alias("var_rhs"), F.lit(0.0).alias("cov"))
    two = verify.finished(verify.cons_02(two), "CONS-02")
    # restatements read the values of all variables, raw and derived
    again = derive.evaluate(world.values.select("world", "i", "mu"), low.restated.withColumn("i", F.concat("i", F.lit("'"))))
    again = again.values.filter("level = 1").select("world", F.expr("substring(i, 1, length(i) - 1)").alias("i"), F.col("mu").alias("restated"))
    three = verify.finished(verify.cons_03(world.values.select("world", "i", F.col("mu").alias("value")).join(again, ["world", "i"])), "CONS-03")
    return one.unionByName(two).unionByName(three)



#: The extents of classes along their own axes (a number is a constant in metres), and which are solid.
EXTENTS = {"IFCWALL": ("Length", "Width", "Height"), "IFCSPACE": ("Length", "Width", "storey.ClearHeight"), "IFCDOOR": ("Width", 0.05, "Height")}
SOLID = ("IFCWALL", "IFCDOOR")


def boxes(rows: DataFrame, world: World) -> tuple[DataFrame, DataFrame]:
    """The scene of every world: boxes (id, world, ifc_class, solid, x, y, z, angle, ex, ey, ez) of products that have a placement, and
    motion (id, c, x, y, z, ex, ey, ez), how they change with the raw quantities. ``id`` and ``c`` begin with the world and a slash.

    A placement is a box's lower corner; the centre lies half the extents along the box's own axes.
    """
    low = world.lowered
    known = low.entities.filter(F.col("ifc_class").isin(*EXTENTS))
    has = rows.select("file", "step_id", _json("$[5].ref").alias("p")).filter("p IS NOT NULL").select("file", "step_id")
    at = scene.placed(rows, known.join(has, ["file", "step_id"], "left_semi"))
    storey = low.entities.filter("ifc_class = 'IFCBUILDINGSTOREY'").select("file", F.col("global_id").alias("storey"))
    at = at.join(storey, "file").withColumn("id", F.concat_ws("/", "file", "global_id"))
    own = lambda v: F.lit(None).cast("string") if isinstance(v, float) else F.concat_ws(".", "storey", F.lit(v.split(".")[1])) if v.startswith("storey.") else F.concat_ws(".", "global_id", F.lit(v))
    pick = lambda k, f, other: F.coalesce(*(F.when(F.col("ifc_class") == c, f(e[k])) for c, e in EXTENTS.items()), other)
    for k, e in enumerate(("ex", "ey", "ez")):
        at = at.withColumns({f"v_{e}": pick(k, own, F.lit(None).cast("string")), e: pick(k, lambda v: F.lit(v if isinstance(v, float) else None).cast("double"), F.lit(None).cast("double"))})
    long = at.select("file", "id", F.explode(F.array(*(F.struct(F.lit(e).alias("e"), F.col(f"v_{e}").alias("i")) for e in ("ex", "ey", "ez")))).alias("q")).select("file", "id", "q.*").filter("i IS NOT NULL")
    values = long.join(world.values.select(F.col("world").alias("file"), "i", "mu"), ["file", "i"]).groupBy("id").agg(*(F.max(F.when(F.col("e") == e, F.col("mu"))).alias(f"m_{e}") for e in ("ex", "ey", "ez")))
    at = stored(at.join(values, "id", "left").withColumns({e: F.coalesce(e, f"m_{e}") for e in ("ex", "ey", "ez")}))
    c, s = F.cos("angle"), F.sin("angle")
    centre = {"x": F.col("x") + c * F.col("ex") / 2 - s * F.col("ey") / 2, "y": F.col("y") + s * F.col("ex") / 2 + c * F.col("ey") / 2, "z": F.col("z") + F.col("ez") / 2}
    made = at.select("id", F.col("file").alias("world"), "ifc_class", F.col("ifc_class").isin(*SOLID).alias("solid"), *(centre[d].alias(d) for d in "xyz"), "angle", "ex", "ey", "ez")
    rows_ = world.jac.unionByName(world.values.filter("level = 0").select("world", F.col("i").alias("r"), F.col("i").alias("c"), F.lit(1.0).alias("v")))
    grad = long.join(rows_.select(F.col("world").alias("file"), F.col("r").alias("i"), "c", "v"), ["file", "i"]).join(at.select("id", "angle"), "id")
    grad = grad.groupBy("id", "angle", F.concat_ws("/", "file", "c").alias("c")).agg(*(F.sum(F.when(F.col("e") == e, F.col("v")).otherwise(0.0)).alias(e) for e in ("ex", "ey", "ez")))
    half = {"x": (F.cos("angle") * F.col("ex") - F.sin("angle") * F.col("ey")) / 2, "y": (F.sin("angle") * F.col("ex") + F.cos("angle") * F.col("ey")) / 2, "z": F.col("ez") / 2}
    return made, grad.select("id", "c", *(half[d].alias(d) for d in "xyz"), "ex", "ey", "ez")

"""Length units and placements of STEP tables (file, step_id, type_name, args), all files at once.

A file whose units break a rule fails the job with its name and instance. Faulty placements fail it only where a product
stands on one; :func:`placement_faults` tells which, and in which files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import stored
from plumbline.sources import step
from plumbline.sources.step import _ref, by_type

#: SI prefixes.
SI_PREFIXES = {
    "EXA": 1e18, "PETA": 1e15, "TERA": 1e12, "GIGA": 1e9, "MEGA": 1e6, "KILO": 1e3, "HECTO": 1e2, "DECA": 1e1,
    "DECI": 1e-1, "CENTI": 1e-2, "MILLI": 1e-3, "MICRO": 1e-6, "NANO": 1e-9, "PICO": 1e-12, "FEMTO": 1e-15, "ATTO": 1e-18,
}
TINY = 1e-12


def _json(path: str) -> Column:
    """A value of the arguments; a null element of a list reads as the text null."""
    return F.nullif(F.get_json_object("args", path), F.lit("null"))


def _refs(path: str) -> Column:
    """Instance numbers in a list; references and numbers have no other form in the JSON."""
    return F.transform(F.regexp_extract_all(_json(path), F.lit(r'"ref":\s*(\d+)'), 1), lambda x: x.cast("long"))


def _told(name: str, *said) -> Column:
    at = F.concat(F.lit(f"{name}: "), F.col("file"), F.lit(" #"), F.col("step_id").cast("string"))
    return F.concat(at, *(F.lit(s) if isinstance(s, str) else s for s in said))


def _fail(name: str, *said) -> Column:
    return F.raise_error(_told(name, *said))


def length_units(rows: DataFrame) -> DataFrame:
    """(file, scale, prefix, assumed): metres per length unit; a file without any length unit is taken to be in metres.

    The units that the project names count, or all units where no project names any. Units by conversion, names other
    than metre, unknown prefixes, a project without a length unit and units of unequal scale are errors.
    """
    files = rows.select("file").distinct()
    project = by_type(rows, "IFCPROJECT").select("file", _ref(8).alias("step_id")).filter("step_id IS NOT NULL").distinct()
    assigned = F.when(F.col("type_name") == "IFCUNITASSIGNMENT", F.coalesce(_refs("$[0]"), F.array())).otherwise(_fail("no unit assignment"))
    listed = rows.join(project, ["file", "step_id"]).select("file", F.explode(assigned).alias("step_id")).distinct()
    declared = project.select("file").distinct().withColumn("declared", F.lit(True))
    length = rows.filter(F.col("type_name").isin("IFCSIUNIT", "IFCCONVERSIONBASEDUNIT") & (_json("$[1].enum") == "LENGTHUNIT"))
    chosen = length.join(declared, "file", "left").join(listed.withColumn("listed", F.lit(True)), ["file", "step_id"], "left").filter("declared IS NULL OR listed")
    prefix = _json("$[2].enum")
    known = F.create_map(*(F.lit(x) for kv in SI_PREFIXES.items() for x in kv))
    scale = (
        F.when(F.col("type_name") == "IFCCONVERSIONBASEDUNIT", _fail("length unit by conversion"))
        .when(~_json("$[3].enum").eqNullSafe("METRE"), _fail("length unit is not metre"))
        .when(prefix.isNull() & _json("$[2]").isNull(), F.lit(1.0))
        .when(prefix.isNull() | F.try_element_at(known, prefix).isNull(), _fail("unknown prefix"))
        .otherwise(F.try_element_at(known, prefix))
    )
    one = chosen.select("file", "step_id", scale.alias("scale"), prefix.alias("prefix")).groupBy("file").agg(
        F.min("step_id").alias("step_id"), F.min("scale").alias("least"), F.max("scale").alias("most"), F.min_by("prefix", "step_id").alias("prefix")
    )
    out = files.join(one, "file", "left").join(declared, "file", "left")
    settled = F.when(F.col("step_id").isNull() & F.col("declared"), F.raise_error(F.concat(F.lit("project without length unit: "), F.col("file")))).when(F.col("step_id").isNull(), F.lit(1.0))
    settled = settled.when(F.col("least") < F.col("most"), _fail("length units disagree")).otherwise(F.col("least"))
    return out.select("file", settled.alias("scale"), "prefix", F.col("step_id").isNull().alias("assumed"))


def _numbers(rows: DataFrame, type_name: str, key: str, value: str) -> DataFrame:
    """Points or directions as three doubles, missing coordinates 0."""
    v = F.from_json(_json("$[0]"), "array<double>")
    return by_type(rows, type_name).select("file", F.col("step_id").alias(key), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(v, i), F.lit(0.0))).alias(value))


def _steps(rows: DataFrame) -> DataFrame:
    """(file, step_id, parent, x, y, z, angle, fault): each local placement within its parent, in file units, or why it has no place."""
    local = by_type(rows, "IFCLOCALPLACEMENT").select("file", "step_id", _ref(0).alias("parent"), _ref(1).alias("axes"))
    axes = rows.select("file", F.col("step_id").alias("axes"), F.col("type_name").alias("axes_type"), _ref(0).alias("at"), _ref(1).alias("up"), _ref(2).alias("along"))
    j = local.join(axes, ["file", "axes"], "left")
    for type_name, key in (("IFCCARTESIANPOINT", "at"), ("IFCDIRECTION", "up"), ("IFCDIRECTION", "along")):
        j = j.join(_numbers(rows, type_name, key, f"{key}_v"), ["file", key], "left")
    lost = lambda k: F.col(k).isNotNull() & F.col(f"{k}_v").isNull()
    up, along = F.col("up_v"), F.col("along_v")
    fault = (
        F.when(F.col("axes").isNotNull() & ~F.col("axes_type").eqNullSafe("IFCAXIS2PLACEMENT3D"), _told("unsupported axes"))
        .when(lost("at") | lost("up") | lost("along"), _told("axes refer to nothing"))
        .when((F.abs(up[0]) >= TINY) | (F.abs(up[1]) >= TINY) | (up[2] <= 0), _told("axis is not vertical"))
        .when(F.abs(along[2]) > TINY, _told("direction out of plane"))
    )
    at = [F.coalesce(F.col("at_v")[i], F.lit(0.0)).alias(n) for i, n in enumerate("xyz")]
    return j.select("file", "step_id", "parent", *at, F.coalesce(F.atan2(along[1], along[0]), F.lit(0.0)).alias("angle"), fault.alias("fault"))


def traced(rows: DataFrame) -> DataFrame:
    """(file, step_id, x, y, z, angle, fault): every local placement in metres in its file's own frame, or what is wrong with it or with
    one above it.

    Rigid motions compose in any grouping, so chains are halved at each round: a placement takes over its parent's motion
    and its parent's parent. Chains of n need log2 n rounds. Rounds stop when no parent is left; a chain still open after
    as many rounds as the longest file allows runs in a circle.
    """
    unit = length_units(rows).select("file", "scale")
    own = _steps(rows).join(unit, "file").select("file", "step_id", "parent", *((F.col(c) * F.col("scale")).alias(c) for c in "xyz"), "angle", "fault")
    now = stored(own)
    most = now.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length() + 1):
        if now.filter("parent IS NOT NULL").isEmpty():
            return now.drop("parent")
        up = now.select("file", F.col("step_id").alias("parent"), F.col("parent").alias("above"), *(F.col(c).alias(f"p{c}") for c in ("x", "y", "z", "angle", "fault")))
        j = now.join(up, ["file", "parent"], "left")
        own = F.col("parent").isNull()
        lost = F.when(~own & F.col("px").isNull(), _told("no such parent placement", F.concat(F.lit(" #"), F.col("parent").cast("string"))))
        c, s = F.cos("pangle"), F.sin("pangle")
        moved = {"x": F.col("px") + c * F.col("x") - s * F.col("y"), "y": F.col("py") + s * F.col("x") + c * F.col("y"), "z": F.col("pz") + F.col("z"), "angle": F.col("pangle") + F.col("angle")}
        now = stored(j.select("file", "step_id", F.col("above").alias("parent"), *(F.when(own | F.col("px").isNull(), F.col(n)).otherwise(e).alias(n) for n, e in moved.items()), F.coalesce("fault", lost, "pfault").alias("fault")))
    return now.withColumn("fault", F.when(F.col("parent").isNotNull(), _told("placements run in a circle")).otherwise(F.col("fault"))).drop("parent")


def placements(rows: DataFrame) -> DataFrame:
    """(file, step_id, x, y, z, angle) of all placements; one with a fault is an error."""
    return traced(rows).withColumn("x", F.when(F.col("fault").isNull(), F.col("x")).otherwise(F.raise_error(F.col("fault")))).drop("fault")


def _used(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Products with their placement's motion and fault; placements that no product stands on don't count."""
    at = rows.select("file", "step_id", _ref(5).alias("placement"))
    own = traced(rows).withColumnRenamed("step_id", "placement")
    j = products.join(at, ["file", "step_id"]).join(own, ["file", "placement"], "left")
    wrong = F.when(F.col("placement").isNotNull() & F.col("x").isNull(), _told("no such placement"))
    return j.withColumn("fault", F.coalesce("fault", wrong))


def placed(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Products (file, step_id, ...) with x, y, z, angle; one without a placement stands at the origin, one on a faulty placement is an error."""
    j = _used(rows, products)
    return j.select(*products.columns, *(F.when(F.col("fault").isNull(), F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.raise_error(F.col("fault"))).alias(c) for c in ("x", "y", "z", "angle")))


def placement_faults(rows: DataFrame, products: DataFrame) -> DataFrame:
    """(file, step_id, fault) of the products that stand on a faulty placement: other files hold."""
    return _used(rows, products).filter("fault IS NOT NULL").select("file", "step_id", "fault")


#: Standard deviations in metres of quantities that state none.
SIGMAS = {
    ("IFCBUILDINGSTOREY", "ClearHeight"): 0.01, ("IFCWALL", "Length"): 0.005, ("IFCWALL", "Width"): 0.002, ("IFCOPENINGELEMENT", "Width"): 0.005, ("IFCOPENINGELEMENT", "Height"): 0.005,
    ("IFCDOOR", "Width"): 0.003, ("IFCDOOR", "Height"): 0.003, ("IFCSPACE", "Length"): 0.005, ("IFCSPACE", "Width"): 0.005, ("IFCBEAM", "Length"): 0.005,
}
COST_SIGMA = 0.08  # of the mean
LENGTHS = ("ClearHeight", "Length", "Width", "Height")


def priors(rows: DataFrame, products: DataFrame, stated: tuple[str, ...] = ("Posterior", "Uncertainty")) -> DataFrame:
    """(file, step_id, quantity, mu, sigma): the products' lengths in metres and unit costs, with standard deviations.

    ``stated`` names property sets that hold a quantity's deviation as "<quantity>Sigma" in file units, the first that has
    one counts; else the default of the class counts. Quantities without a default are left out, as no model uses them.
    """
    q = step.quantities(rows).withColumnRenamed("product", "step_id").join(products.select("file", "step_id", "ifc_class"), ["file", "step_id"])
    q = q.join(length_units(rows).select("file", "scale"), "file").withColumn("unit", F.when(F.col("quantity").isin(*LENGTHS), F.col("scale")).otherwise(1.0))
    for k, name in enumerate(stated):
        own = rows.filter((F.col("type_name") != "IFCELEMENTQUANTITY") & ((F.col("type_name") != "IFCPROPERTYSET") | _json("$[2]").eqNullSafe(name)))
        said = step.quantities(own).filter("quantity LIKE '%Sigma'").select("file", F.col("product").alias("step_id"), F.regexp_replace("quantity", "Sigma$", "").alias("quantity"), F.col("value").alias(f"s{k}"))
        q = q.join(said, ["file", "step_id", "quantity"], "left")
    known = F.create_map(*(F.lit(x) for (c, n), v in SIGMAS.items() for x in (f"{c}.{n}", v)))
    mu = F.col("value") * F.col("unit")
    default = F.when(F.col("quantity") == "UnitCost", F.greatest(F.abs(mu) * COST_SIGMA, F.lit(1e-6))).otherwise(F.try_element_at(known, F.concat_ws(".", "ifc_class", "quantity")))
    sigma = F.coalesce(*(F.col(f"s{k}") * F.col("unit") for k in range(len(stated))), default)
    return q.select("file", "step_id", "quantity", mu.alias("mu"), sigma.alias("sigma")).filter("sigma IS NOT NULL")

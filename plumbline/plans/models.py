"""Queries over STEP texts that Spark writes for the ids of embeddings: lowering, derived values, gradients, constraints, faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import numeric
from plumbline.operators import clash, geometry, graph
from plumbline.plans import worlds as w
from plumbline.plans.catalog import query, r
from plumbline.sources import lower, patch, scene, step


class _Writer:
    """STEP records as Columns; ``file`` is true where the file is in millimetres."""

    def __init__(self, key, milli):
        self.key, self.milli, self.n, self.said = key, milli, 100, []

    def real(self, mm):
        """A length in millimetres as the file writes it."""
        text = F.lpad((mm % 1000).cast("string"), 3, "0")
        return F.when(self.milli, F.concat(mm.cast("string"), F.lit("."))).otherwise(F.concat((mm / 1000).cast("long").cast("string"), F.lit("."), text))

    def add(self, *parts, when=None):
        parts = [F.lit(p) if isinstance(p, str) else p for p in parts]
        text = F.concat(*parts)
        self.said.append(text if when is None else F.when(when, text).otherwise(""))

    def product(self, number: int, kind: str, name: str, lengths: dict, when=None, sets: dict | None = None, skip: dict | None = None, at: tuple | None = None):
        """One product with its quantity set, property sets {name: {property: text}}, and its corner in millimetres."""
        place = "$" if at is None else f"#{number + 1007}"
        self.add(f"#{number}=IFC{kind}('{name}", self.key.cast("string"), "',$,'", name, f"',$,$,{place},$,$,$);", when=when)
        if at is not None:
            x, y, z = (self.real(v if not isinstance(v, int) else F.lit(v).cast("long")) for v in at)
            self.add(f"#{number + 1005}=IFCCARTESIANPOINT((", x, ",", y, ",", z, f"));#{number + 1006}=IFCAXIS2PLACEMENT3D(#{number + 1005},$,$);#{place[1:]}=IFCLOCALPLACEMENT($,#{number + 1006});", when=when)
        for k, (q, mm) in enumerate(lengths.items()):
            own = when if not skip or q not in skip else (~skip[q] if when is None else when & ~skip[q])
            self.add(f"#{number + 1 + k}=IFCQUANTITYLENGTH('{q}',$,$,", self.real(mm), ",$);", when=own)
        refs = ",".join(f"#{number + 1 + k}" for k in range(len(lengths)))
        self.add(f"#{number + 5}=IFCELEMENTQUANTITY('q',$,'Base',$,$,({refs}));#{number + 6}=IFCRELDEFINESBYPROPERTIES('r',$,$,$,(#{number}),#{number + 5});", when=when)
        at = number + 7
        for s, (props, cond) in (sets or {}).items():
            both = cond if when is None else when if cond is None else when & cond
            parts = []
            for k, (p, v) in enumerate(props.items()):
                parts += [f"#{at + k}=IFCPROPERTYSINGLEVALUE('{p}',$,IFCREAL(", v, "),$);"]
            refs = ",".join(f"#{at + k}" for k in range(len(props)))
            end = at + len(props)
            self.add(*parts, f"#{end}=IFCPROPERTYSET('p',$,'{s}',$,({refs}));#{end + 1}=IFCRELDEFINESBYPROPERTIES('r',$,$,$,(#{number}),#{end});", when=both)
            at = end + 2


def offices(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): for each id a storey with two walls, up to three openings, a door, a room and a beam.

    Some files lack a width or have two storeys; some openings are higher than their storey.
    """
    c = w.table(spark, d, "embeddings").select(F.col("vec_id").alias("k"))
    k = F.col("k")
    x = _Writer(k, k % 2 == 0)
    x.add("ISO-10303-21;HEADER;FILE_DESCRIPTION(('m'),'2;1');ENDSEC;DATA;#1=IFCPROJECT('P',$,$,$,$,$,$,$,#2);#2=IFCUNITASSIGNMENT((#3));#3=IFCSIUNIT(*,.LENGTHUNIT.,", F.when(k % 2 == 0, ".MILLI.").otherwise("$"), ",.METRE.);")
    lit = lambda v: F.lit(v).cast("long")
    text = lambda v: F.concat(v.cast("string"), F.lit("."))
    x.product(100, "BUILDINGSTOREY", "S", {"ClearHeight": 2500 + 100 * (k % 10)})
    x.product(900, "BUILDINGSTOREY", "T", {"ClearHeight": lit(2500)}, when=k % 101 == 5)
    x.product(200, "WALL", "WA", {"Length": 3000 + 500 * (k % 7), "Width": lit(300)}, sets={"Material": ({"UnitCost": text(200 + k % 100)}, None), "Posterior": ({"LengthSigma": x.real(lit(4))}, k % 6 == 0)}, at=(0, 0, 0))
    x.product(300, "WALL", "WB", {"Length": 4000 + 250 * (k % 5), "Width": lit(200)}, sets={"Material": ({"UnitCost": F.lit("150.")}, k % 3 == 0)}, skip={"Width": k % 97 == 0}, at=(1000, 280 + 10 * (k % 4), 0))
    x.product(400, "OPENINGELEMENT", "OA", {"Width": 900 + 10 * (k % 5), "Height": F.when(k % 22 == 0, 2690).otherwise(2100).cast("long")}, when=k % 2 == 0)
    x.product(420, "OPENINGELEMENT", "OB", {"Width": lit(1200), "Height": lit(1500)}, when=k % 5 == 0)
    x.product(440, "OPENINGELEMENT", "OC", {"Width": lit(600), "Height": 600 + 100 * (k % 3)}, when=k % 5 == 0)
    x.product(460, "DOOR", "D", {"Width": lit(850), "Height": lit(2000)}, when=k % 4 == 0, at=(500, 100, 0))
    x.product(500, "SPACE", "R", {"Length": 4000 + 100 * (k % 9), "Width": lit(3000)}, at=(0, 480, 0))
    strength = {"YieldStrengthMPa": F.lit("350."), "YieldStrengthMPaSigma": F.lit("8."), "PlasticSectionModulusMajorM3": F.lit("0.001"), "PlasticSectionModulusMajorM3Sigma": F.lit("0.00001")}
    x.product(600, "BEAM", "B", {"Length": lit(6000)}, when=k % 4 < 2, sets={"Structural": (strength, k % 4 == 1)})
    x.add("#700=IFCRELCONTAINEDINSPATIALSTRUCTURE('c',$,$,$,(#200,#300),#100);#701=IFCRELAGGREGATES('a',$,$,$,#100,(#500));")
    x.add("#702=IFCRELVOIDSELEMENT('v',$,$,$,#200,#400);", when=k % 2 == 0)
    x.add("#703=IFCRELVOIDSELEMENT('v',$,$,$,#300,#420);#704=IFCRELVOIDSELEMENT('v',$,$,$,#300,#440);", when=k % 5 == 0)
    x.add("#705=IFCRELFILLSELEMENT('f',$,$,$,#400,#460);", when=k % 4 == 0)
    x.add("ENDSEC;END-ISO-10303-21;")
    return c.select(k.cast("string").alias("file"), F.concat(*x.said).alias("text"))


def _rows(spark, d):
    return graph.stored(step.read_texts(offices(spark, d)), "type_name")


def _lowered(spark, d):
    return lower.lower(_rows(spark, d))


#: The sound files' dimensions in metres with their spreads, and walls with what their openings take.
OFFICE = """
c AS (SELECT vec_id AS k, 2.5e0 + 0.1e0 * (vec_id % 10) AS ch FROM embeddings WHERE vec_id % 97 <> 0 AND vec_id % 101 <> 5),
o AS (SELECT k, 'WA' AS wall, 'OA' AS o, 0.9e0 + 0.01e0 * (k % 5) AS w, CASE WHEN k % 22 = 0 THEN 2.69e0 ELSE 2.1e0 END AS h FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'WB', 'OB', 1.2e0, 1.5e0 FROM c WHERE k % 5 = 0 UNION ALL SELECT k, 'WB', 'OC', 0.6e0, 0.6e0 + 0.1e0 * (k % 3) FROM c WHERE k % 5 = 0),
a AS (SELECT k, wall, sum(w * h) AS area, sum((h * h + w * w) * 0.000025e0) AS va FROM o GROUP BY k, wall),
x AS (SELECT k, ch, 'WA' AS wall, 3e0 + 0.5e0 * (k % 7) AS l, 0.3e0 AS t, CASE WHEN k % 6 = 0 THEN 0.004e0 ELSE 0.005e0 END AS sl, 200e0 + k % 100 AS u FROM c
  UNION ALL SELECT k, ch, 'WB', 4e0 + 0.25e0 * (k % 5), 0.2e0, 0.005e0, CASE WHEN k % 3 = 0 THEN 150e0 END FROM c),
y AS (SELECT x.*, coalesce(area, 0e0) AS area, coalesce(va, 0e0) AS va, l * ch - coalesce(area, 0e0) AS net, u * 0.08e0 AS su FROM x LEFT JOIN a USING (k, wall)),
z AS (SELECT *, (ch * sl) ** 2 + va AS own, (l * 0.01e0) ** 2 AS shared, net * net * 0.000004e0 AS vt FROM y),
room AS (SELECT k, ch, 4e0 + 0.1e0 * (k % 9) AS l FROM c)
"""


@query("derived_values", f"""WITH {OFFICE}, v AS (
SELECT k, o AS e, 'Area' AS q, w * h AS mu, (h * h + w * w) * 0.000025e0 AS v FROM o
UNION ALL SELECT k, 'D', 'Area', 0.85e0 * 2e0, (0.85e0 ** 2 + 4e0) * 0.000009e0 FROM c WHERE k % 4 = 0
UNION ALL SELECT k, wall, 'Height', ch, 0.0001e0 FROM z
UNION ALL SELECT k, wall, 'GrossSideArea', l * ch, (ch * sl) ** 2 + shared FROM z
UNION ALL SELECT k, wall, 'NetSideArea', net, own + shared FROM z
UNION ALL SELECT k, wall, 'GrossVolume', l * ch * t, ((ch * sl) ** 2 + shared) * t * t + (l * ch * 0.002e0) ** 2 FROM z
UNION ALL SELECT k, wall, 'NetVolume', net * t, (own + shared) * t * t + vt FROM z
UNION ALL SELECT k, wall, 'Cost', net * t * u, u * u * ((own + shared) * t * t + vt) + (net * t * su) ** 2 FROM z WHERE u IS NOT NULL
UNION ALL SELECT k, 'R', 'FloorArea', l * 3e0, (9e0 + l * l) * 0.000025e0 FROM room
UNION ALL SELECT k, 'R', 'Volume', l * 3e0 * ch, ch * ch * (9e0 + l * l) * 0.000025e0 + (l * 3e0 * 0.01e0) ** 2 FROM room
UNION ALL SELECT k, 'B', 'NominalMomentCapacity', 350000e0, 8000e0 ** 2 + 3500e0 ** 2 FROM c WHERE k % 4 = 1
UNION ALL SELECT k, 'B', 'DesignMomentCapacity', 315000e0, 0.81e0 * (8000e0 ** 2 + 3500e0 ** 2) FROM c WHERE k % 4 = 1
UNION ALL SELECT k, 'S', 'TotalWallNetVolume', sum(net * t), sum(own * t * t + vt) + sum(l * t) ** 2 * 0.0001e0 FROM z GROUP BY k
UNION ALL SELECT k, 'S', 'TotalWallCost', sum(net * t * u), sum(u * u * (own * t * t + vt) + (net * t * su) ** 2) + sum(l * t * u) ** 2 * 0.0001e0 FROM z WHERE u IS NOT NULL GROUP BY k
UNION ALL SELECT k, 'S', 'TotalFloorArea', l * 3e0, (9e0 + l * l) * 0.000025e0 FROM room)
SELECT k::VARCHAR AS world, e || k || '.' || q AS i, round(mu, 5) AS mu, round(sqrt(v), 6) AS sd FROM v""")
def derived_values(spark, d):
    """STEP texts lowered to worlds, and every derived quantity of every world with its spread."""
    low, _ = _lowered(spark, d)
    world = lower.compile_(low)
    v = world.values.filter("level > 0").join(world.sd, ["world", "i"])
    return v.select("world", "i", r("mu", 5).alias("mu"), r("sd", 6).alias("sd"))


@query("derived_jacobian", f"""WITH {OFFICE}, p AS (SELECT * FROM z WHERE u IS NOT NULL), v AS (
SELECT k, 'S' || k || '.ClearHeight' AS c, sum(l * t * u) AS v FROM p GROUP BY k
UNION ALL SELECT k, wall || k || '.Length', ch * t * u FROM p UNION ALL SELECT k, wall || k || '.Width', net * u FROM p UNION ALL SELECT k, wall || k || '.UnitCost', net * t FROM p
UNION ALL SELECT k, o || k || '.Width', -h * t * u FROM o JOIN p USING (k, wall) UNION ALL SELECT k, o || k || '.Height', -w * t * u FROM o JOIN p USING (k, wall))
SELECT k::VARCHAR AS world, c, round(v, 5) AS v FROM v""")
def derived_jacobian(spark, d):
    """Gradients of each storey's wall cost by every raw quantity it depends on, through five levels."""
    low, _ = _lowered(spark, d)
    world = lower.compile_(low)
    return world.jac.filter("r LIKE 'S%.TotalWallCost'").select("world", "c", r("v", 5).alias("v"))


@query("model_constraints", f"""WITH {OFFICE}, h AS (SELECT k, h - ch AS d, 2e0 * sqrt(0.000125e0) AS s FROM o JOIN c USING (k) WHERE o = 'OA')
SELECT 'CONS-02' AS rule, k || '/OA' || k || '.Height<=WA' || k || '.Height' AS subject, CASE WHEN d > 1e-9 THEN 'FAIL' ELSE 'WARN' END AS status FROM h WHERE d + s > 0
UNION ALL SELECT 'CONS-01', '', 'PASS' UNION ALL SELECT 'CONS-03', '', 'PASS'""")
def model_constraints(spark, d):
    """Constraints of all lowered worlds: openings against their walls with joint spreads, restated quantities, signs."""
    low, _ = _lowered(spark, d)
    return lower.constraints(lower.compile_(low)).select("rule", "subject", "status")


@query("lowering_faults", """SELECT vec_id::VARCHAR AS file, 'WB' || vec_id || '.Width' AS subject, 'missing quantity' AS fault FROM embeddings WHERE vec_id % 97 = 0
UNION ALL SELECT vec_id::VARCHAR, '2', 'not one storey' FROM embeddings WHERE vec_id % 101 = 5""")
def lowering_faults(spark, d):
    """Files that can't be lowered, with the reason; the others are lowered all the same."""
    return _lowered(spark, d)[1]


@query("model_clashes", f"""WITH {OFFICE}, p AS (SELECT k, -0.02e0 + 0.01e0 * (k % 4) AS d FROM c), q AS (SELECT k, d, {numeric.normal_cdf_sql("(-(d + 0.01e0) / 0.002e0)")} AS p FROM p)
SELECT k::VARCHAR AS world, 'WA' || k AS a, 'WB' || k AS b, round(d, 6) AS clearance, 0.002e0 AS sigma, round(p, 6) AS p FROM q WHERE p >= 0.001e0""")
def model_clashes(spark, d):
    """Clashes of the placed products of STEP texts, with spreads from the lowered belief; doors in their walls are exempt."""
    return graph.measured(spark, lambda: _clashes(spark, d))


def _clashes(spark, d):
    rows = _rows(spark, d)
    low, _ = lower.lower(rows)
    world = lower.compile_(low)
    boxes, motion = lower.boxes(rows, world)
    boxes = graph.stored(boxes.filter("solid"))
    join = lambda c: F.concat_ws("/", "world", c)
    free = clash.exempt(low.edges.withColumnRenamed("file", "world")).select(join("a").alias("a"), join("b").alias("b"))
    pairs = graph.stored(geometry.without(geometry.near_pairs(boxes, 0.5, 4.0, "world"), free))
    cov = world.cov.select(join("i").alias("i"), join("k").alias("k"), "v")
    out = clash.score(pairs, boxes, motion, cov, geometry.tile(boxes, 0.75), min_p=0.001)
    name = lambda c: F.split(c, "/")[1].alias(c)
    return out.select(F.split("a", "/")[0].alias("world"), name("a"), name("b"), r("clearance", 6).alias("clearance"), r("sigma", 6).alias("sigma"), r("p_clash", 6).alias("p"))


@query("exported_models", f"""WITH {OFFICE} SELECT k::VARCHAR AS file, e || k AS product, q AS quantity, round(mu, 6) AS mu, round(s, 6) AS sigma FROM (
SELECT k, wall AS e, 'Length' AS q, l + 0.25e0 AS mu, sl / 2 AS s FROM x UNION ALL SELECT k, wall, 'Width', t + 0.25e0, 0.001e0 FROM x
UNION ALL SELECT k, wall, 'UnitCost', u + 0.25e0, u * 0.04e0 FROM x WHERE u IS NOT NULL) v""")
def exported_models(spark, d):
    """Walls a quarter larger and twice as certain, written into their STEP texts, and what is read from those again."""
    texts = graph.stored(offices(spark, d))
    rows = graph.stored(step.read_texts(texts), "type_name")
    known = lower.products(rows)
    bad = lower.faults(rows, known, step.quantities(rows))
    walls = graph.stored(known.filter("ifc_class = 'IFCWALL'").join(bad.select("file").distinct(), "file", "left_anti"))
    before = scene.priors(rows, walls, ("Posterior",)).select("file", F.col("step_id").alias("product"), "quantity", (F.col("mu") + 0.25).alias("mu"), (F.col("sigma") / 2).alias("sigma"))
    again = graph.stored(step.read_texts(patch.export(texts, rows, graph.stored(before))), "type_name")
    found = scene.priors(again, walls, ("Posterior",)).join(walls.select("file", "step_id", "global_id"), ["file", "step_id"])
    return found.select("file", F.col("global_id").alias("product"), "quantity", r("mu", 6).alias("mu"), r("sigma", 6).alias("sigma"))

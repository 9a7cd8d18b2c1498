"""Queries over a tree of frames: regions, their nations and their customers, each nation turned and shifted in its region."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import belief, frames
from plumbline.operators.graph import stored
from plumbline.plans import worlds as w
from plumbline.plans.catalog import query, r

#: Spreads of a nation's link (shift along x, turn about z) and of a region's link (shift along y).
SHIFT, TURN, ROAD = 0.03, 0.002, 0.05


def _frames(spark, d):
    """(world, frame, parent, r, t, unit): one world; a quarter turn for every nation number, regions side by side."""
    n, g = w.table(spark, d, "nation"), w.table(spark, d, "region")
    num = lambda *xs: F.array(*(x.cast("double") if not isinstance(x, float) else F.lit(x) for x in xs))
    one = [F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)]
    root = spark.range(1).select(F.lit("w").alias("world"), F.lit("site").alias("frame"), F.lit(None).cast("string").alias("parent"), F.array(*one).alias("r"), num(0.0, 0.0, 0.0).alias("t"), F.lit("m").alias("unit"))
    region = g.select(F.lit("w").alias("world"), F.concat(F.lit("r"), "r_regionkey").alias("frame"), F.lit("site").alias("parent"), F.array(*one).alias("r"), num(100 * F.col("r_regionkey"), 0.0, 0.0).alias("t"), F.lit("m").alias("unit"))
    k = F.col("n_nationkey") % 4
    c, s = F.when(k == 0, 1.0).when(k == 2, -1.0).otherwise(0.0), F.when(k == 1, 1.0).when(k == 3, -1.0).otherwise(0.0)
    nation = n.select(F.lit("w").alias("world"), F.concat(F.lit("n"), "n_nationkey").alias("frame"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), num(c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0).alias("r"), num(0.0, 10 * F.col("n_nationkey"), 1.0).alias("t"), F.lit("mm").alias("unit"))
    return root.unionByName(region).unionByName(nation)


def _points(spark, d):
    c = w.table(spark, d, "customer")
    return c.select(F.lit("w").alias("world"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("frame"), F.array((F.col("c_custkey") % 1000).cast("double"), F.floor("c_acctbal").cast("double"), F.lit(500.0)).alias("p"))


#: Customers in metres in their nations' axes, and the turned vector.
SITE = """p AS (SELECT c_custkey AS k, n_nationkey AS n, n_regionkey AS g, (c_custkey % 1000) / 1000e0 AS x, floor(c_acctbal) / 1000e0 AS y FROM customer JOIN nation ON n_nationkey = c_nationkey),
q AS (SELECT *, CASE n % 4 WHEN 0 THEN 1e0 WHEN 2 THEN -1e0 ELSE 0e0 END AS c, CASE n % 4 WHEN 1 THEN 1e0 WHEN 3 THEN -1e0 ELSE 0e0 END AS s FROM p)"""


@query("frame_points", f"WITH {SITE} SELECT 'c' || k AS id, round(c * x - s * y + 100 * g, 6) AS x, round(s * x + c * y + 10 * n, 6) AS y, 1.5e0 AS z FROM q")
def frame_points(spark, d):
    """Every customer's place at the site."""
    poses = frames.to_root(_frames(spark, d))
    at = frames.to_frame(_points(spark, d).withColumn("target", F.lit("site")), poses).withColumns({k: F.col("q")[i] for i, k in enumerate("xyz")})
    return at.select("id", *(r(k, 6).alias(k) for k in "xyz"))


def _belief(spark, d, points):
    """Gradients of points, and the covariance of the links and of the points themselves (1 mm along x)."""
    tree = stored(_frames(spark, d))
    jac = stored(frames.gradients(points, tree, frames.to_root(tree)))
    sd = F.when(F.col("c").rlike(r"^n\d+\.tx$"), SHIFT).when(F.col("c").rlike(r"^n\d+\.rz$"), TURN).when(F.col("c").rlike(r"^r\d+\.ty$"), ROAD).when(F.col("c").rlike(r"\.px$"), 0.001)
    cov = jac.select("world", "c").distinct().withColumn("sd", sd).filter("sd IS NOT NULL").select("world", F.col("c").alias("i"), F.col("c").alias("k"), (F.col("sd") ** 2).alias("v"))
    return jac, cov


@query("frame_spreads", f"""WITH {SITE} SELECT 'c' || k || '.' || a AS r, round(sqrt(v) * 1000, 4) AS sd FROM (
SELECT k, 'x' AS a, c * c * 0.0009e0 + (s * x + c * y) ** 2 * 0.000004e0 + c * c * 0.000001e0 AS v FROM q
UNION ALL SELECT k, 'y', s * s * 0.0009e0 + (c * x - s * y) ** 2 * 0.000004e0 + s * s * 0.000001e0 + 0.0025e0 FROM q) WHERE v > 0""")
def frame_spreads(spark, d):
    """Every customer's spread at the site in millimetres, from its own error and those of the links above it."""
    jac, cov = _belief(spark, d, _points(spark, d))
    out = belief.pushforward(jac, cov, variances_only=True).filter("v > 0").withColumn("sd", F.sqrt("v") * 1000)
    return out.select("r", r("sd").alias("sd"))


@query("frame_shared", """WITH q AS (SELECT n_nationkey AS n, n_regionkey AS g, CASE n_nationkey % 4 WHEN 1 THEN 1e0 WHEN 3 THEN -1e0 ELSE 0e0 END AS s FROM nation)
SELECT 'o' || a.n || '.y' AS a, 'o' || b.n || '.y' AS b, round((0.0025e0 + CASE WHEN a.n = b.n THEN a.s * a.s * 0.000901e0 ELSE 0 END) * 1000000, 4) AS v FROM q a JOIN q b ON a.g = b.g""")
def frame_shared(spark, d):
    """Covariances between the nations' origins: those of one region share its link."""
    origins = w.table(spark, d, "nation").select(F.lit("w").alias("world"), F.concat(F.lit("o"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("frame"), F.array(*[F.lit(0.0)] * 3).alias("p"))
    jac, cov = _belief(spark, d, origins)
    out = belief.pushforward(jac, cov).filter("r LIKE '%.y' AND r2 LIKE '%.y'").withColumn("v", F.col("v") * 1_000_000)
    return out.select(F.col("r").alias("a"), F.col("r2").alias("b"), r("v").alias("v"))

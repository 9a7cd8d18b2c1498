"""Invariants of a state as queries; each gives rows (rule, subject, status, detail), and one PASS row if it finds nothing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.belief import once
from plumbline.operators.graph import peel, stored

TOL, REL_TOL, ASYMMETRY = 1e-9, 1e-9, 1e-9


def _rows(df: DataFrame, rule: str, subject: Column, status: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), status.alias("status"), detail.cast("string").alias("detail"))


def finished(found: DataFrame, rule: str) -> DataFrame:
    """``found`` without its PASS rows, or one PASS row if nothing is left."""
    bad = found.filter("status <> 'PASS'")
    none = bad.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(rule).alias("rule"), F.lit("").alias("subject"), F.lit("PASS").alias("status"), F.lit("").alias("detail"))
    return bad.unionByName(none)


def struct_01(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """Both ends of every edge exist."""
    ends = rel.select(F.col("src").alias("end"), "kind").union(rel.select("dst", "kind"))
    return _rows(ends.join(entities, F.col("end") == F.col("node"), "left_anti"), "STRUCT-01", F.col("end"), F.lit("FAIL"), F.col("kind"))


def struct_02(rel: DataFrame) -> DataFrame:
    """Containment has no cycles."""
    _, rest = peel(rel.filter("kind IN ('aggregates', 'contains')").select("src", "dst"))
    return _rows(rest, "STRUCT-02", F.col("src"), F.lit("FAIL"), F.col("dst"))


def struct_03(rel: DataFrame, entities: DataFrame) -> DataFrame:
    """An opening voids exactly one wall, a door fills exactly one opening; none is as wrong as two."""
    n = rel.filter("kind IN ('voids', 'fills')").groupBy("kind", "src").agg(F.count("*").alias("n"))
    need = entities.filter("ifc_class IN ('IfcOpeningElement', 'IfcDoor')").withColumn("need", F.when(F.col("ifc_class") == "IfcDoor", "fills").otherwise("voids"))
    got = need.join(n, [F.col("need") == F.col("kind"), F.col("node") == F.col("src")], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _rows(got, "STRUCT-03", F.col("node"), F.when(F.col("n") == 1, "PASS").otherwise("FAIL"), F.col("n"))


def gauss_01(cov: DataFrame, tol: float = ASYMMETRY) -> DataFrame:
    """Covariances are symmetric."""
    other = cov.select("world", F.col("k").alias("i"), F.col("i").alias("k"), F.col("v").alias("w"))
    d = cov.join(other, ["world", "i", "k"], "full").withColumn("d", F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))))
    return _rows(d.filter(F.col("i") < F.col("k")), "GAUSS-01", F.concat_ws("/", "world", "i", "k"), F.when(F.col("d") > tol, "FAIL").otherwise("PASS"), F.col("d"))


def packed_gauss_01(worlds: DataFrame, tol: float = ASYMMETRY) -> DataFrame:
    """:func:`gauss_01` of worlds (world, cov) that hold their covariance's cells (i, k, v) as an array; worlds are rows, joined with nothing."""
    w = once(once(worlds, "world", "cov", at=mirror("cov")), "world", d=asymmetries()).select("world", F.explode("d").alias("d")).select("world", "d.*")
    return _rows(w, "GAUSS-01", F.concat_ws("/", "world", "i", "k"), F.when(F.col("d") > tol, "FAIL").otherwise("PASS"), F.col("d"))


def place(i: Column, k: Column) -> Column:
    return F.concat_ws("\0", i, k)


def mirror(cells: str) -> Column:
    """A map of the cells' values by :func:`place`."""
    return F.map_from_arrays(F.transform(cells, lambda x: place(x["i"], x["k"])), F.transform(cells, lambda x: x["v"]))


def asymmetries() -> Column:
    """(i, k, d) for i < k of the cells ``cov`` with their map ``at``: how far both sides are apart; a missing one is 0."""
    other = lambda x: F.try_element_at("at", place(x["k"], x["i"]))
    high = F.transform(F.filter("cov", lambda x: x["i"] < x["k"]), lambda x: F.struct(x["i"].alias("i"), x["k"].alias("k"), F.abs(x["v"] - F.coalesce(other(x), F.lit(0.0))).alias("d")))
    low = F.transform(F.filter("cov", lambda x: (x["i"] > x["k"]) & other(x).isNull()), lambda x: F.struct(x["k"].alias("i"), x["i"].alias("k"), F.abs(x["v"]).alias("d")))
    return F.concat(high, low)


def gauss_02_diagonal(cov: DataFrame) -> DataFrame:
    """No variance is negative beyond rounding; whether the whole matrix is semidefinite is a dense kernel (``dense.psd``)."""
    return _rows(cov.filter("i = k"), "GAUSS-02", F.concat_ws("/", "world", "i"), F.when(F.col("v") >= -1e-12, "PASS").otherwise("FAIL"), F.col("v"))


def gauss_02(cov: DataFrame) -> DataFrame:
    """Whole covariances are semidefinite, world by world (world being a number)."""
    from plumbline.operators import dense

    return _rows(dense.psd(cov), "GAUSS-02", F.col("world"), F.when(F.col("psd"), "PASS").otherwise("FAIL"), F.col("jitter"))


def packed_gauss(worlds: DataFrame, tol: float = ASYMMETRY) -> DataFrame:
    """What :func:`gauss_01` finds, and :func:`gauss_02`, of worlds (world, cov) as :func:`packed_gauss_01` has them, looked at once."""
    from plumbline.operators import dense

    found, whole = dense.checked(worlds, tol), F.col("i").isNull()
    status = F.when(~whole | ~F.col("psd"), "FAIL").otherwise("PASS")
    out = _rows(found, "GAUSS-01", F.concat_ws("/", "world", "i", "k"), status, F.when(whole, F.col("jitter")).otherwise(F.col("d")))
    return out.withColumn("rule", F.when(F.contains("subject", F.lit("/")), F.lit("GAUSS-01")).otherwise(F.lit("GAUSS-02")))


def gauss_03(stored: DataFrame, exact: DataFrame) -> DataFrame:
    """Derived means (world, i, mu) equal their expressions evaluated anew; the worst one is reported."""
    return gauss_03_of(stored.join(exact.withColumnRenamed("mu", "again"), ["world", "i"]))


def gauss_03_of(both: DataFrame) -> DataFrame:
    """:func:`gauss_03` of means that stand beside what was evaluated anew: (world, i, mu, again)."""
    d = both.withColumn("d", F.abs(F.col("mu") - F.col("again")) / F.greatest(F.lit(1.0), F.abs("again")))
    worst = d.groupBy().agg(F.max_by(F.struct("world", "i", "d"), F.col("d")).alias("w")).filter("w IS NOT NULL").select("w.*")
    return _rows(worst, "GAUSS-03", F.concat_ws("/", "world", "i"), F.when(F.col("d") > REL_TOL, "FAIL").otherwise("PASS"), F.col("d"))


def cons_01(values: DataFrame, tol: float = TOL) -> DataFrame:
    """values (world, i, mu, sd) are not negative: FAIL at the mean, WARN within two spreads."""
    s = F.when(F.col("mu") < -tol, "FAIL").when(F.col("mu") - 2 * F.col("sd") < 0, "WARN").otherwise("PASS")
    return _rows(values, "CONS-01", F.concat_ws("/", "world", "i"), s, F.col("mu"))


def cons_02(pairs: DataFrame, tol: float = TOL, slack: float = 0.0) -> DataFrame:
    """pairs (world, i, lhs, rhs, var_lhs, var_rhs, cov): lhs <= rhs, with the joint variance of the difference.

    A bound that two spreads pass by at most ``slack`` times the right side counts as met exactly, which is a PASS.
    """
    d, v = F.col("lhs") - F.col("rhs"), F.greatest(F.lit(0.0), F.col("var_lhs") + F.col("var_rhs") - 2 * F.col("cov"))
    return _rows(pairs, "CONS-02", F.concat_ws("/", "world", "i"), F.when(d > tol, "FAIL").when(d + 2 * F.sqrt(v) > (slack * F.abs("rhs") if slack else 0), "WARN").otherwise("PASS"), d)


def cons_03(pairs: DataFrame, tol: float = TOL) -> DataFrame:
    """pairs (world, i, value, restated) are equal."""
    return _rows(pairs, "CONS-03", F.concat_ws("/", "world", "i"), F.when(F.abs(F.col("value") - F.col("restated")) > tol, "FAIL").otherwise("PASS"), F.col("value"))


def qty_01(by_graph: DataFrame, derived: DataFrame) -> DataFrame:
    """Sums (world, total) taken along the graph equal the derived totals."""
    return qty_01_of(by_graph.join(derived.withColumnRenamed("total", "derived"), "world", "full"))


def qty_01_of(d: DataFrame) -> DataFrame:
    """:func:`qty_01` of sums that stand beside the derived totals (world, total, derived); a missing one is null."""
    off = F.abs(F.coalesce("total", F.lit(0.0)) - F.coalesce("derived", F.lit(0.0))) / F.greatest(F.lit(1.0), F.abs(F.coalesce("derived", F.lit(0.0))))
    return _rows(d, "QTY-01", F.col("world"), F.when(off > REL_TOL, "FAIL").otherwise("PASS"), off)


def report(rules: list[DataFrame]) -> DataFrame:
    """All rules' rows, in their fixed order of names."""
    return reduce(DataFrame.unionByName, rules)


def reported(rules: dict[str, list[DataFrame]]) -> DataFrame:
    """What every rule finds, or its one PASS row, as :func:`finished` has it; only what was found is stored, and every rule runs once."""
    bad = stored(report([x.filter("status <> 'PASS'") for found in rules.values() for x in found]))
    names = bad.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, rules))).alias("rule"))
    none = names.join(bad.select("rule").distinct(), "rule", "left_anti")
    return bad.unionByName(none.select("rule", F.lit("").alias("subject"), F.lit("PASS").alias("status"), F.lit("").alias("detail")))


def passes(found: DataFrame) -> DataFrame:
    """Counts by status, and whether the report passes: it does unless something failed."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}")
    return found.agg(n("PASS"), n("WARN"), n("FAIL")).withColumn("passes", F.col("n_fail") == 0)


#: Extensions append (name, function of a dict of tables).
REGISTRY: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = [
    ("STRUCT-01", lambda t: struct_01(t["rel"], t["entity"])),
    ("STRUCT-02", lambda t: struct_02(t["rel"])),
    ("STRUCT-03", lambda t: struct_03(t["rel"], t["entity"])),
    ("GAUSS-01", lambda t: gauss_01(t["cov"])),
    ("GAUSS-02", lambda t: gauss_02(t["full_cov"])),
    ("GAUSS-03", lambda t: gauss_03(t["derived"], t["evaluated"])),
    ("CONS-01", lambda t: cons_01(t["values"])),
    ("CONS-02", lambda t: cons_02(t["less_equal"])),
    ("CONS-03", lambda t: cons_03(t["equals"])),
    ("QTY-01", lambda t: qty_01(t["graph_totals"], t["totals"])),
]


def verify(tables: dict[str, DataFrame]) -> DataFrame:
    return report([finished(rule(tables), name) for name, rule in REGISTRY])

"""Derived quantities as rows: a stored graph of sums of products, evaluated and differentiated level by level.

A derived variable is a sum of terms, terms (world, i, term, coef, refs): coef times the product of the variables in refs (an
array, empty for a constant). The operations of :mod:`plumbline.functions.expr` all expand to that form, so graphs come from
data: rules joined to entities, sums along edges, or expressions stored with their variables. A round evaluates all
variables of all worlds whose references have values; a reference is looked up among the values of the last round only.
Rounds are as many as the longest chain of dependencies, whatever the number of worlds and variables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import Expr
from plumbline.operators.graph import stored


class DependencyError(ValueError):
    """A derived variable that depends on itself or on something without a value."""


def literal(e: Expr, name=lambda v: F.lit(v)) -> Column:
    """An expression as an array of (term, coef, refs); ``name`` says which variable of the row's world a name means."""
    one = lambda k, coef, refs: F.struct(F.lit(k).alias("term"), F.lit(float(coef)).alias("coef"), F.array(*map(name, refs)).cast("array<string>").alias("refs"))
    return F.array(*(one(f"{k:04}", coef, refs) for k, (coef, refs) in enumerate(e.terms())))


def rules(rows: DataFrame, world: str, i: Column, e: Expr, name=lambda v: F.lit(v)) -> DataFrame:
    """(world, i, term, coef, refs): the same expression for every row."""
    return rows.select(F.col(world).alias("world"), i.alias("i"), F.explode(literal(e, name)).alias("t")).select("world", "i", "t.*")


def sums(edges: DataFrame, world: str, i: Column, ref: Column, coef: float = 1.0) -> DataFrame:
    """(world, i, term, coef, refs): for each i the scaled sum of ref over its rows."""
    return edges.select(F.col(world).alias("world"), i.alias("i"), ref.alias("term"), F.lit(float(coef)).alias("coef"), F.array(ref).alias("refs"))


@dataclass
class Evaluated:
    """values (world, i, mu, level) of all variables, raw ones at level 0; partials (world, child, parent, v, level)."""

    values: DataFrame
    partials: DataFrame
    depth: int


def evaluate(raw: DataFrame, terms: DataFrame) -> Evaluated:
    """Exact values of the derived variables at the means raw (world, i, mu), and their partial derivatives there."""
    factor = F.posexplode_outer("refs").alias("pos", "ref")
    found = stored(raw.select("world", "i", F.col("mu").cast("double").alias("mu"), F.lit(0).alias("level")))
    # one row per factor with its value once that is known; constants have a row without a reference
    left = stored(terms.select("world", "i", "term", "coef", factor).withColumn("x", F.when(F.col("ref").isNull(), F.lit(1.0))))
    new, values, partials, level = found, found, None, 0
    while not left.isEmpty():
        level += 1
        known = left.join(new.select("world", F.col("i").alias("ref"), F.col("mu").alias("now")), ["world", "ref"], "left")
        known = stored(known.select("world", "i", "term", "coef", "pos", "ref", F.coalesce("x", "now").alias("x")))
        open_ = known.filter("x IS NULL").select("world", "i").distinct()
        ready = known.join(open_, ["world", "i"], "left_anti")
        left = known.join(open_, ["world", "i"], "left_semi")
        product = lambda skip=None: F.aggregate("f", F.lit(1.0), lambda a, y: a * (y["x"] if skip is None else F.when(y["pos"] == skip["pos"], 1.0).otherwise(y["x"])))
        per = ready.groupBy("world", "i", "term", "coef").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "x"))).alias("f"))
        per = per.withColumn("d", F.transform("f", lambda y: F.struct(y["ref"].alias("parent"), (F.col("coef") * product(y)).alias("v"))))
        per = stored(per.select("world", "i", (F.col("coef") * product()).alias("mu"), F.filter("d", lambda y: y["parent"].isNotNull()).alias("d")))
        new = per.groupBy("world", "i").agg(F.sum("mu").alias("mu")).withColumn("level", F.lit(level))
        if per.isEmpty():
            at = left.filter("x IS NULL").orderBy("world", "i", "ref").first()
            exists = not terms.filter((F.col("world") == at.world) & (F.col("i") == at.ref)).isEmpty()
            raise DependencyError(f"{at.i} of {at.world} depends on {at.ref}, which {'depends on it or on another circle' if exists else 'has no value'}")
        step = per.select("world", F.col("i").alias("child"), F.explode("d").alias("d")).groupBy("world", "child", F.col("d.parent").alias("parent")).agg(F.sum("d.v").alias("v")).withColumn("level", F.lit(level))
        values = values.unionByName(new)
        partials = step if partials is None else partials.unionByName(step)
    if partials is None:
        partials = values.limit(0).select("world", F.col("i").alias("child"), F.col("i").alias("parent"), F.col("mu").alias("v"), "level")
    return Evaluated(values, partials, level)


def total_jacobian(done: Evaluated) -> DataFrame:
    """(world, r, c, v): the derivatives of every derived variable by the raw ones it depends on, by the chain rule.

    A level takes its rows from those of all levels below, which are read from tables.
    """
    raw = done.values.filter("level = 0").select("world", F.col("i").alias("r"), F.col("i").alias("c"), F.lit(1.0).alias("v"))
    below, out = stored(raw), None
    for level in range(1, done.depth + 1):
        p = done.partials.filter(F.col("level") == level).select("world", "child", F.col("parent").alias("r"), F.col("v").alias("p"))
        rows = p.join(below, ["world", "r"]).groupBy("world", F.col("child").alias("r"), "c").agg(F.sum(F.col("p") * F.col("v")).alias("v"))
        rows = stored(rows)
        below = below.unionByName(rows)
        out = rows if out is None else out.unionByName(rows)
    return raw.limit(0) if out is None else out


def affected(terms: DataFrame, changed: DataFrame) -> DataFrame:
    """(world, i): the derived variables that depend on ``changed`` (world, i), however far."""
    edges = stored(terms.select("world", "i", F.explode("refs").alias("ref")).distinct())
    new, out = changed.select("world", F.col("i").alias("ref")).distinct(), None
    while True:
        reached = edges.join(new, ["world", "ref"], "left_semi").select("world", "i").distinct()
        if out is not None:
            reached = reached.join(out, ["world", "i"], "left_anti")
        reached = stored(reached)
        if reached.isEmpty():
            return reached if out is None else out
        out = reached if out is None else stored(out.unionByName(reached))
        new = reached.select("world", F.col("i").alias("ref"))

"""The driver tables as state tables: every order is a small world.

Raw quantities of a line: quantity (q), unit price (p), discount (d); one price level (f) is shared by an order's lines.
Derived: net = q p f (1 - d) per line and their sum per order. Spreads by quantity: 0.5, one percent of the price, 0.005,
and 0.02. Variables are named ``q:<line>`` and so on, the level ``f``, derived ones ``net:<line>`` and ``total``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import Expr, const, var
from plumbline.operators.belief import total

SIGMA = {"q": 0.5, "p": 0.01, "d": 0.005, "f": 0.02}
NET: Expr = var("q") * var("p") * var("f") * (const(1.0) - var("d"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(world, line, q, p, d, f); rows of one order with equal line, part and supplier are one line.

    Lines are dealt by world once; whatever is keyed by worlds after that stays where it is. The filter is always true: it keeps
    all columns in that one exchange, so that every use of the lines reads the same one, whatever columns it needs.
    """
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount").repartition("l_orderkey")
    g = t.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("x"), F.min("l_discount").alias("d"))
    g = g.filter(F.array_min(F.array(F.lit(0.0), "q", "x", "d")).isNotNull())
    return g.select(F.col("l_orderkey").alias("world"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("line"), "q", (F.col("x") / F.col("q")).alias("p"), "d", F.lit(1.0).alias("f"))


def sigma(kind: str, p: str = "p"):
    return F.lit(SIGMA["p"]) * F.col(p) if kind == "p" else F.lit(SIGMA[kind])


def raw(l: DataFrame) -> DataFrame:
    """(world, i, mu, sigma) of all raw variables."""
    cell = lambda i, mu, sd: F.struct(i.alias("i"), mu.cast("double").alias("mu"), sd.cast("double").alias("sigma"))
    own = F.array(*(cell(F.concat(F.lit(f"{k}:"), "line"), F.col(k), sigma(k)) for k in "qpd"))
    level = F.when(F.row_number().over(Window.partitionBy("world").orderBy("line")) == 1, F.array(cell(F.lit("f"), F.lit(1.0), F.lit(SIGMA["f"])))).otherwise(F.array().cast("array<struct<i:string,mu:double,sigma:double>>"))
    # the first line brings the level along: a union with the worlds would deal all rows anew
    return l.withColumn("level", level).select("world", F.explode(F.concat(own, "level")).alias("s")).select("world", "s.*")


def prior(l: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mean, cov), the covariance diagonal."""
    r = raw(l)
    return r.select("world", "i", "mu"), r.select("world", "i", F.col("i").alias("k"), (F.col("sigma") ** 2).alias("v"))


def net_rows(l: DataFrame) -> DataFrame:
    """(world, r, c, v): gradients of each line's net, by symbolic partials."""
    name = lambda k: F.lit("f") if k == "f" else F.concat(F.lit(f"{k}:"), "line")
    cells = F.array(*(F.struct(name(k).alias("c"), NET.partial(k).column().alias("v")) for k in "qpdf"))
    return l.select("world", F.concat(F.lit("net:"), "line").alias("r"), F.explode(cells).alias("s")).select("world", "r", "s.c", "s.v")


def total_rows(l: DataFrame) -> DataFrame:
    """(world, r, c, v): gradients of each order's total, by the chain rule."""
    return net_rows(l).groupBy("world", F.lit("total").alias("r"), "c").agg(F.sum("v").alias("v")).select("world", "r", "c", "v")


def totals(l: DataFrame) -> DataFrame:
    """(world, total): exact totals."""
    return l.groupBy("world").agg(F.sum(NET.column()).alias("total"))


def packed(l: DataFrame) -> DataFrame:
    """(world, lines): one row a world, its lines in order with their raw quantities, nets and gradients.

    Lines are dealt by world already, so they are gathered where they lie; what a query asks of a world is then work on one row.
    """
    own = l.select("world", F.struct("line", "q", "p", "d", NET.column().alias("net"), *(NET.partial(k).column().alias(f"g{k}") for k in "qpdf")).alias("x"))
    return own.groupBy("world").agg(F.sort_array(F.collect_list("x")).alias("lines"))


def _name(kind: str, x) -> Column:
    return F.lit("f") if kind == "f" else F.concat(F.lit(f"{kind}:"), x["line"])


def packed_prior() -> Column:
    """The cells (i, k, v) of a packed world's covariance, as :func:`prior` lists them."""
    cell = lambda i, sd: F.struct(i.alias("i"), i.alias("k"), (sd.cast("double") ** 2).alias("v"))
    own = F.transform("lines", lambda x: F.array(*(cell(_name(k, x), F.lit(SIGMA["p"]) * x["p"] if k == "p" else F.lit(SIGMA[k])) for k in "qpd")))
    return F.concat(F.flatten(own), F.array(cell(F.lit("f"), F.lit(SIGMA["f"]))))


def packed_mean() -> Column:
    """The means (i, mu) of a packed world, as :func:`prior` lists them."""
    cell = lambda i, mu: F.struct(i.alias("i"), mu.cast("double").alias("mu"))
    own = F.transform("lines", lambda x: F.array(*(cell(_name(k, x), x[k]) for k in "qpd")))
    return F.concat(F.flatten(own), F.array(cell(F.lit("f"), F.lit(1.0))))


def packed_net_rows() -> Column:
    """The rows (r, g) of a packed world's nets, g their gradients by variable, as :func:`net_rows` lists them."""
    return F.transform("lines", lambda x: F.struct(F.concat(F.lit("net:"), x["line"]).alias("r"), F.create_map(*(c for k in "qpdf" for c in (_name(k, x), x[f"g{k}"]))).alias("g")))


def packed_total_rows() -> Column:
    """The one row (r, g) of a packed world's total, as :func:`total_rows` lists it."""
    names = F.concat(F.flatten(F.transform("lines", lambda x: F.array(*(_name(k, x) for k in "qpd")))), F.array(F.lit("f")))
    values = F.concat(F.flatten(F.transform("lines", lambda x: F.array(*(x[f"g{k}"] for k in "qpd")))), F.array(packed_sum("gf")))
    return F.array(F.struct(F.lit("total").alias("r"), F.map_from_arrays(names, values).alias("g")))


def packed_sum(field: str) -> Column:
    return total(F.transform("lines", lambda x: x[field]))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, x, y, z, angle, ex, ey, ez): the first three coordinates of an embedding as a box's centre, in units of 10."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double") * 10
    return e.select(F.col("vec_id").alias("id"), "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.lit(0.0).alias("angle"), (F.lit(0.3) + F.col("label") * 0.02).alias("ex"), F.lit(0.3).alias("ey"), F.lit(0.2).alias("ez"))


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, src, dst): region, nation, customer as a containment tree."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    agg = n.select(F.lit("aggregates").alias("kind"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return agg.union(c.select(F.lit("contains"), F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda t, letter, col: table(spark, sf_dir, t).select(F.concat(F.lit(letter), col).alias("node"))
    return pick("region", "r", "r_regionkey").union(pick("nation", "n", "n_nationkey")).union(pick("customer", "c", "c_custkey"))

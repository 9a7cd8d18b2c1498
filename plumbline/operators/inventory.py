"""Audits, inventories, identity digests and evidence records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit(entities: DataFrame, available: DataFrame, required: DataFrame) -> DataFrame:
    """Each entity's status from what its class requires: entities (id, ifc_class, derivable), available (id, quantity),
    required (ifc_class, quantity)."""
    need = required.groupBy("ifc_class").agg(F.collect_set("quantity").alias("need"))
    have = available.groupBy("id").agg(F.collect_set("quantity").alias("have"))
    none = F.array().cast("array<string>")
    out = entities.join(need, "ifc_class", "left").join(have, "id", "left")
    out = out.withColumn("missing", F.array_sort(F.array_except(F.coalesce("need", none), F.coalesce("have", none))))
    status = F.when(F.col("need").isNull(), "BLOCKED").when(F.size("missing") == 0, "READY").when(F.col("derivable"), "NEEDS_GEOMETRY_DERIVATION").otherwise("MISSING_SOURCE_DATA")
    return out.select("id", "ifc_class", F.array_join("missing", ",").alias("missing"), status.alias("status"))


def census(entities: DataFrame) -> DataFrame:
    return entities.groupBy("ifc_class").agg(F.count("*").alias("n"))


def inventory_diff(left: DataFrame, right: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Rows of two inventories that are on one side only or differ in an attribute."""
    pick = lambda df, s: df.select(*key, *(F.col(a).alias(f"{a}_{s}") for a in attributes), F.lit(True).alias(f"in_{s}"))
    both = pick(left, "l").join(pick(right, "r"), key, "full")
    differs = ~F.lit(True)
    for a in attributes:
        differs = differs | ~F.col(f"{a}_l").eqNullSafe(F.col(f"{a}_r"))
    kind = F.when(F.col("in_r").isNull(), "left_only").when(F.col("in_l").isNull(), "right_only").when(differs, "mismatch")
    return both.select(*key, kind.alias("difference")).filter("difference IS NOT NULL")


def set_digest(rows: DataFrame, by: str, line: Column) -> DataFrame:
    """(by, digest): SHA-256 of the sorted lines of each group; the order of rows does not matter."""
    return rows.select(by, line.alias("l")).groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("l")), "\n"), 256).alias("digest"))


def colour_refinement(nodes: DataFrame, edges: DataFrame, rounds: int = 3, counted: bool = False) -> DataFrame:
    """(node, colour) after ``rounds`` of hashing each node's colour with its neighbours' sorted colours: names don't matter.

    nodes (node, label), edges (src, dst, kind). With ``counted``, equal neighbours are hashed as one with their number, so
    that a node of many neighbours holds only their different colours.
    """
    colours = nodes.select("node", F.sha2(F.col("label").cast("string"), 256).alias("colour"))
    both = edges.select("src", "dst", F.concat(F.lit("+"), "kind").alias("kind")).union(edges.select("dst", "src", F.concat(F.lit("-"), "kind")))
    for _ in range(rounds):
        near = both.join(colours.select(F.col("node").alias("dst"), "colour"), "dst").select("src", F.concat("kind", "colour").alias("near"))
        if counted:
            near = near.groupBy("src", "near").agg(F.count("*").alias("n")).select("src", F.concat("near", F.lit("*"), F.col("n").cast("string")).alias("near"))
        near = near.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list("near")), ",").alias("around"))
        colours = colours.join(near, F.col("node") == F.col("src"), "left").select("node", F.sha2(F.concat_ws("|", "colour", F.coalesce("around", F.lit(""))), 256).alias("colour"))
    return colours


def closed_json(rows: DataFrame, column: str, schema: str, keys: list[str]) -> DataFrame:
    """Parsed records whose keys are exactly those listed; others are an error."""
    exact = F.array_sort(F.json_object_keys(column)) == F.array(*map(F.lit, sorted(keys)))
    ok = F.when(F.coalesce(exact, F.lit(False)), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("fields differ from the schema: "), F.coalesce(column, F.lit("null")))))
    return rows.withColumn("record", F.from_json(ok, schema, {"mode": "FAILFAST"}))


def snapshot_checks(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> dict[str, bool]:
    """Per table, whether both snapshots hold the same rows."""
    return {name: left[name].exceptAll(right[name]).isEmpty() and right[name].exceptAll(left[name]).isEmpty() for name in left}


def fixed_point_product(rows: DataFrame, a: str, b: str, divisor: int) -> DataFrame:
    """a * b / divisor in integers, ties to even; a product past 38 digits is an error."""
    p = F.col(a).cast("decimal(19,0)") * F.col(b).cast("decimal(19,0)")
    q = F.expr(f"cast({a} as decimal(19,0)) * cast({b} as decimal(19,0)) div {divisor}").cast("decimal(38,0)")
    r = p - q * divisor
    up = (2 * r > divisor) | ((2 * r == divisor) & (q % 2 == 1))
    return rows.withColumn("product", (q + F.when(up, 1).otherwise(0)).cast("decimal(38,0)"))


def lyapunov_i32(rows: DataFrame, a: tuple, p: tuple) -> DataFrame:
    """rows (x, y) with v = x'Px, vn the same after x+ = Ax, and whether it falls: in 32-bit integers, where an overflow is an error."""
    whole = lambda c: c.cast("int")
    x, y = F.col("x"), F.col("y")
    nx, ny = (whole(F.lit(m) * x + F.lit(n) * y) for m, n in a)
    form = lambda u, v: whole(u * (F.lit(p[0][0]) * u + F.lit(p[0][1]) * v) + v * (F.lit(p[1][0]) * u + F.lit(p[1][1]) * v))
    return rows.withColumns({"v": form(x, y), "vn": form(nx, ny)}).withColumn("decreases", F.col("vn") < F.col("v"))

"""Queries that leave no row of their tables out."""

import hashlib
from collections import Counter

import __spark_entry__ as entry_module
from helpers import rows


def test_every_line_gets_a_bound_verdict(spark, tmp_path):
    """A discount of 0.01 is two spreads: a tie that passes, whatever the price is."""
    lines = [(o, k, k, 1, float(o % 50 + 1), (o % 50 + 1) * (900.0 + 0.37 * o), k / 100) for o in range(1, 60) for k in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = entry_module.queries()["cons02_all"](spark, str(tmp_path))
    assert rows(got) == sorted((f"{o}/1-{k}-{k}", "PASS" if k else "WARN") for o in range(1, 60) for k in range(5))


def refined(labels: dict, edges: list, rounds: int) -> dict:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    colour = {n: sha(x) for n, x in labels.items()}
    for _ in range(rounds):
        near = {n: Counter() for n in labels}
        for kind, a, b in edges:
            near[a]["+" + kind + colour[b]] += 1
            near[b]["-" + kind + colour[a]] += 1
        colour = {n: sha(c + "|" + ",".join(sorted(f"{x}*{k}" for x, k in near[n].items()))) for n, c in colour.items()}
    return colour


def test_colours_of_all_nodes(spark, tmp_path):
    nations = [(k, k % 3) for k in range(8)]
    customers = [(k, k % 5 if k < 30 else 7) for k in range(33)]
    for name, data, schema in (
        ("region", [(k,) for k in range(4)], "r_regionkey long"), ("nation", nations, "n_nationkey long, n_regionkey long"),
        ("customer", customers, "c_custkey long, c_nationkey long"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    edges = [("aggregates", f"r{r}", f"n{n}") for n, r in nations] + [("contains", f"n{n}", f"c{c}") for c, n in customers]
    labels = {f"r{k}": "r" for k in range(4)} | {f"n{n}": "n" for n, _ in nations} | {f"c{c}": "c" for c, _ in customers}
    got = dict(rows(entry_module.queries()["wl_colours_all"](spark, str(tmp_path)).select("node", "colour")))
    assert got == refined(labels, edges, 3)
    # customers tell nations apart
    assert got["n0"] != got["n6"] and got["n7"] not in (got["n1"], got["n4"]) and got["c0"] != got["c30"]


def test_reports_see_lines_without_an_order(spark, tmp_path):
    for name, data, schema in (
        ("region", [(1,)], "r_regionkey long"), ("nation", [(1, 1)], "n_nationkey long, n_regionkey long"), ("customer", [(1, 1)], "c_custkey long, c_nationkey long"), ("orders", [(1,)], "o_orderkey long"),
        ("lineitem", [(1, 1, 1, 1, 2.0, 20.0, 0.05), (1, 2, 1, 2, 3.0, 33.0, 0.0), (2, 1, 1, 1, 1.0, 9.0, 0.01)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"),
    ):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    run = lambda name: entry_module.queries()[name](spark, str(tmp_path))
    passed = {(r, "PASS") for r in ("STRUCT-01", "STRUCT-02", "GAUSS-02", "CONS-01")}
    assert set(rows(run("verification_report"))) == passed | {("QTY-01", "FAIL")}
    passed = {(r, "", "PASS") for r in ("STRUCT-01", "STRUCT-02", "STRUCT-03", "GAUSS-01", "GAUSS-02", "GAUSS-03", "CONS-03")}
    assert set(rows(run("verification_report_all"))) == passed | {("QTY-01", "2", "FAIL"), ("CONS-01", "1/d:2-2-1", "WARN"), ("CONS-02", "1/2-2-1", "WARN")}

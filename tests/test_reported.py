"""A report on all rules takes every rule once, and deals no cells of covariances."""

from helpers import rows
from pyspark.sql import functions as F

from plumbline.operators import dense, graph, verify
from plumbline.plans.catalog import QUERIES

CELL = "world long, i string, k string, v double"


def _packed(cov):
    return cov.groupBy("world").agg(F.collect_list(F.struct("i", "k", "v")).alias("cov"))


def test_packed_rules_find_what_the_listed_ones_find(spark):
    unit = lambda w, c, d: [(w, "a", "a", 1.0), (w, "b", "b", 1.0), (w, "a", "b", c), (w, "b", "a", d)]
    cov = spark.createDataFrame([*unit(1, 0.5, 0.5), *unit(2, 1.5, 1.5), *unit(3, 0.5, 0.3), *unit(4, 0.2, 0.9)[:3], (5, "a", "a", -1.0)], CELL)
    want = [tuple(x) for f in (verify.gauss_01(cov, 1e-3), verify.gauss_02(cov)) for x in f.filter("status <> 'PASS'").select("rule", "subject", "status").collect()]
    got = rows(verify.packed_gauss(_packed(cov), 1e-3).filter("status <> 'PASS'").select("rule", "subject", "status"))
    assert got == sorted(want, key=str) and len(got) == 4
    assert rows(dense.checked(_packed(cov), 1e-3).filter("i IS NULL").select("world", "psd")) == rows(dense.psd(cov).select("world", "psd"))


def test_one_pass_row_for_a_rule_that_finds_nothing(spark):
    one = lambda rule, *status: spark.createDataFrame([(rule, str(k), s, "") for k, s in enumerate(status)], "rule string, subject string, status string, detail string")
    got = verify.reported({"A": [one("A", "PASS", "PASS")], "B": [one("B", "PASS", "FAIL"), one("B", "WARN")], "C": [one("C", "PASS")]})
    assert rows(got.select("rule", "subject", "status")) == [("A", "", "PASS"), ("B", "0", "WARN"), ("B", "1", "FAIL"), ("C", "", "PASS")]


def test_a_report_deals_lines_once_and_no_cells(spark, monkeypatch):
    plans, key = [], "spark.sql.autoBroadcastJoinThreshold"
    before, real = spark.conf.get(key), graph.stored

    def kept(df, by=None):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return real(df, by)

    monkeypatch.setattr(verify, "stored", kept)
    spark.conf.set(key, "-1")
    try:
        QUERIES["verification_report_all"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set(key, before)
    made = [x for x in plans[0].split("\n") if "Exchange hashpartitioning" in x and "Reused" not in x]
    assert sum("l_orderkey" in x for x in made) == 1 and not any("world" in x and "k#" in x for x in made)

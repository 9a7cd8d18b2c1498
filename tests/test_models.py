"""The derived layer against plain Python, and lowering of single models."""

import itertools
import math
import random

import pytest
from helpers import rows

from plumbline.functions.expr import Expr, const, mean, scaled_sum, var
from plumbline.operators import derive
from plumbline.plans import models
from plumbline.sources import lower, step
from pyspark.sql import functions as F

TERMS = "world string, i string, term string, coef double, refs array<string>"
RAW = "world string, i string, mu double"


def value(e: Expr, env: dict) -> float:
    a = [value(x, env) for x in e.args]
    match e.op:
        case "const":
            return e.value
        case "var":
            return env[e.value]
        case "add" | "mean":
            return sum(a) / (len(a) if e.op == "mean" else 1)
        case "sub":
            return a[0] - a[1]
        case "mul":
            return a[0] * a[1]
        case "neg":
            return -a[0]
        case _:
            return e.value[0] + sum(c * x for c, x in zip(e.value[1:], a, strict=True))


def test_expressions_as_sums_of_products():
    r = random.Random(0)
    names = ["a", "b", "c"]

    def tree(depth):
        if depth == 0 or r.random() < 0.2:
            return var(r.choice(names)) if r.random() < 0.7 else const(r.choice([0.0, 2.0, -1.5]))
        k = r.randrange(6)
        x, y = tree(depth - 1), tree(depth - 1)
        return [x + y, x - y, x * y, -x, scaled_sum([(2.0, x), (-0.5, y)], 1.0), mean(x, y, x)][k]

    for _ in range(200):
        e, env = tree(4), {n: r.uniform(-2, 2) for n in names}
        got = sum(c * math.prod(env[v] for v in vs) for c, vs in e.terms())
        assert math.isclose(got, value(e, env), rel_tol=1e-9, abs_tol=1e-9)
    assert scaled_sum([]).terms() == [(0.0, ())]


def test_graphs_of_many_worlds_equal_plain_evaluation(spark):
    r = random.Random(1)
    raw, terms, want = [], [], {}
    for k in range(12):
        world, env, defs = f"w{k}", {}, []
        for n in range(4):
            env[f"x{n}"] = 0.0 if n == 3 else r.uniform(-2, 2)  # a zero factor must not hide the others' derivatives
            raw.append((world, f"x{n}", env[f"x{n}"]))
        for n in range(8):  # each refers to anything before it
            known = list(env)
            e = r.choice([var(r.choice(known)) * var(r.choice(known)) * var(r.choice(known)), scaled_sum([(r.uniform(-1, 1), var(v)) for v in r.sample(known, 2)], 0.5), const(3.0), var(r.choice(known)) * var("x3")])
            env[f"d{n}"] = value(e, env)
            defs.append((f"d{n}", e))
            terms += [(world, f"d{n}", f"{t}", c, list(vs)) for t, (c, vs) in enumerate(e.terms())]
        want[world] = (env, defs)
    df = spark.createDataFrame(terms, TERMS).repartition(5)
    done = derive.evaluate(spark.createDataFrame(raw, RAW), df)
    got = {(x.world, x.i): x.mu for x in done.values.collect()}
    assert len(got) == sum(len(e) for e, _ in want.values())
    jac = {(x.world, x.r, x.c): x.v for x in derive.total_jacobian(done).collect()}
    for world, (env, defs) in want.items():
        for i in env:
            assert math.isclose(got[world, i], env[i], rel_tol=1e-9, abs_tol=1e-12)
        for x in (f"x{n}" for n in range(4)):
            sides = []
            for h in (1e-6, -1e-6):
                moved = {n: env[n] + (h if n == x else 0) for n in ("x0", "x1", "x2", "x3")}
                for i, e in defs:
                    moved[i] = value(e, moved)
                sides.append(moved)
            for i, _ in defs:
                slope = (sides[0][i] - sides[1][i]) / 2e-6
                assert math.isclose(jac.get((world, i, x), 0.0), slope, rel_tol=1e-4, abs_tol=1e-4)
    changed = spark.createDataFrame([("w0", "x1")], "world string, i string")
    reach, found = {"x1"}, {x.i for x in derive.affected(df, changed).collect()}
    for i, e in want["w0"][1]:
        if reach & {v for _, vs in e.terms() for v in vs}:
            reach.add(i)
    assert found == reach - {"x1"}


def test_circles_and_unknown_references(spark):
    raw = spark.createDataFrame([("w", "a", 1.0)], RAW)
    with pytest.raises(derive.DependencyError, match="depends on it"):
        derive.evaluate(raw, spark.createDataFrame([("w", "b", "0", 1.0, ["c"]), ("w", "c", "0", 1.0, ["b"])], TERMS))
    with pytest.raises(derive.DependencyError, match="nothing, which has no value"):
        derive.evaluate(raw, spark.createDataFrame([("w", "b", "0", 1.0, ["nothing"])], TERMS))
    done = derive.evaluate(raw, spark.createDataFrame([], TERMS))
    assert done.depth == 0 and done.values.count() == 1 and derive.total_jacobian(done).count() == 0


def text_of(spark, k):
    c = spark.createDataFrame([(k,)], "vec_id long")
    real = models.w.table
    models.w.table = lambda *a: c
    try:
        return models.offices(spark, "").first()["text"]
    finally:
        models.w.table = real


def lowered(spark, texts):
    return lower.lower(step.read_texts(spark.createDataFrame(list(texts.items()), "file string, text string")).cache())


def test_renumbered_and_reordered_texts_lower_alike(spark):
    text = text_of(spark, 20)
    header, records = step.parse(text)
    r = random.Random(2)
    numbers = [n for n, _, _ in records]
    moved = dict(zip(numbers, r.sample(range(1, 9_999), len(numbers)), strict=True))

    def renumber(v):
        if isinstance(v, list):
            return [renumber(x) for x in v]
        return {"ref": moved[v["ref"]]} if isinstance(v, dict) and "ref" in v else v

    other = [(moved[n], t, renumber(a)) for n, t, a in records]
    r.shuffle(other)
    low, bad = lowered(spark, {"a": text, "b": step.write(header, other)})
    assert bad.isEmpty()
    world = lower.compile_(low)
    for df, cols in ((world.values, ("i", F.round("mu", 9), "level")), (world.sd, ("i", F.round("sd", 9))), (world.jac, ("r", "c", F.round("v", 7))), (low.bounds, ("lhs", "rhs"))):
        a, b = (rows(df.filter(F.col("world") == f).select(*cols)) for f in "ab")
        assert a == b and a
    assert world.values.filter("world = 'a' AND level > 0").count() == 20


def test_faulty_files_leave_others_alone(spark):
    good, wide = text_of(spark, 8), text_of(spark, 9)
    twice = good.replace("IFCWALL('WB8'", "IFCWALL('WA8'")
    none = good.replace("IFCBUILDINGSTOREY", "IFCBUILDING")
    weak = wide.replace("'PlasticSectionModulusMajorM3'", "'Other'")
    low, bad = lowered(spark, {"good": good, "twice": twice, "none": none, "weak": weak, "wide": wide})
    assert rows(bad.select("file", "subject", "fault")) == [
        ("none", "0", "not one storey"), ("twice", "WA8", "duplicate global id"), ("weak", "B9.PlasticSectionModulusMajorM3", "missing quantity"),
    ]
    world = lower.compile_(low)
    assert {x.file for x in low.entities.select("file").distinct().collect()} == {"good", "wide"}
    beam = dict(rows(world.values.filter("i LIKE 'B9.%' AND level > 0").select("i", F.round("mu", 3))))
    assert beam == {"B9.NominalMomentCapacity": 350000.0, "B9.DesignMomentCapacity": 315000.0}
    # a beam without its contract is not lowered
    assert world.values.filter("i LIKE 'B8.%'").isEmpty()


def test_constraints_find_what_is_wrong(spark):
    low, _ = lowered(spark, {"x": text_of(spark, 220)})
    found = rows(lower.constraints(lower.compile_(low)).select("rule", "subject", "status"))
    assert found == [("CONS-01", "", "PASS"), ("CONS-02", "x/OA220.Height<=WA220.Height", "FAIL"), ("CONS-03", "", "PASS")]
    assert list(itertools.chain(*lower.RULES.values()))

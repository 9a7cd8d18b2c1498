import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from plumbline.operators import decide, geometry, graph, inventory, ledger, verify
from plumbline.sources import ply, step
from plumbline.streaming import kalman

MODEL = """ISO-10303-21;
HEADER;
FILE_DESCRIPTION(('demo'),'2;1');
ENDSEC;
DATA;
#1=IFCBUILDINGSTOREY('S1',$,'Level ''one''',$,$,$,$,$,.ELEMENT.,0.);
#2=IFCWALL('W1',$,'Wall',$,$,$,$,$,$); /* a wall */
#3=IFCOPENINGELEMENT('O1',$,'Opening',$,$,$,$,$,*);
#4=IFCRELCONTAINEDINSPATIALSTRUCTURE('R1',$,$,$,(#2),#1);
#5=IFCRELVOIDSELEMENT('R2',$,$,$,#2,#3);
#6=IFCELEMENTQUANTITY('Q',$,'Base',$,$,(#7,#8));
#7=IFCQUANTITYLENGTH('Length',$,$,9.2,$);
#8=IFCQUANTITYLENGTH('Width',$,$,3.0E-1,$);
#9=IFCRELDEFINESBYPROPERTIES('R3',$,$,$,(#2),#6);
#10=IFCPROPERTYSET('P',$,'X',$,(#11));
#11=IFCPROPERTYSINGLEVALUE('UnitCost',$,IFCREAL(320.),$);
#12=IFCRELDEFINESBYPROPERTIES('R4',$,$,$,(#2),#10);
ENDSEC;
END-ISO-10303-21;
"""


def test_step_round_trip_and_errors():
    header, rows_ = step.parse(MODEL)
    assert len(rows_) == 12 and rows_[0][2][2] == "Level 'one'" and rows_[10][2][2] == {"type": "IFCREAL", "args": [320.0]}
    assert step.parse(step.write(header, rows_)) == (header, rows_)
    with pytest.raises(step.StepError, match="twice"):
        step.parse(MODEL.replace("#2=", "#1=", 1))
    with pytest.raises(step.StepError, match="line 6"):
        step.parse(MODEL.replace("'S1'", "@"))


def test_step_lowering(spark, tmp_path):
    (tmp_path / "m.ifc").write_text(MODEL)
    table = step.load(spark, str(tmp_path / "*.ifc")).cache()
    assert table.count() == 12 and step.dangling(table).isEmpty()
    known = step.entities(table)
    assert {r.global_id for r in known.collect()} == {"S1", "W1", "O1"}
    assert rows(step.edges(table, known).select("kind", "src", "dst")) == [("contains", 1, 2), ("voids", 3, 2)]
    assert rows(step.quantities(table).select("product", "quantity", "value")) == [(2, "Length", 9.2), (2, "UnitCost", 320.0), (2, "Width", 0.3)]
    assert rows(step.missing(known, step.quantities(table)).select("global_id", "quantity")) == [("O1", "Height"), ("O1", "Width"), ("S1", "ClearHeight")]
    assert step.entities(table, ["W1"]).count() == 1
    spark.dataSource.register(step.StepSource)
    assert spark.read.format("step").option("path", str(tmp_path / "m.ifc")).load().count() == 12


def test_ply(spark, tmp_path):
    p = np.array([[0.0, 1.0, 2.0], [3.0, 4.0, 5.5]])
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii 1.0") + "\n".join(" ".join(map(str, r)) for r in p))
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + p.astype("<f4").tobytes())
    got = ply.load(spark, str(tmp_path / "*.ply"))
    assert got.count() == 4 and got.agg(F.sum("z")).first()[0] == 15.0
    with pytest.raises(ValueError):
        ply.points(b"nope")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_graph(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")])
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reachable(e, seeds)) == [("b", 1), ("c", 1)]
    levels, rest = graph.peel(e)
    assert rows(levels) == [("a", 0), ("b", 1), ("c", 2)] and rows(rest) == [("x", "y"), ("y", "x")]
    assert dict(rows(graph.connected(e))) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    long = edges(spark, [(f"{i:03}", f"{i + 1:03}") for i in range(120)])
    assert {r.component for r in graph.connected(long).collect()} == {"000"}


def test_invariants(spark):
    rel = spark.createDataFrame([("aggregates", "a", "b"), ("aggregates", "b", "a"), ("voids", "o", "w"), ("fills", "d", "o")], "kind string, src string, dst string")
    ent = spark.createDataFrame([("a", "X"), ("b", "X"), ("o", "IfcOpeningElement"), ("d", "IfcDoor"), ("d2", "IfcDoor")], "node string, ifc_class string")
    assert rows(verify.struct_01(rel, ent).select("subject", "status")) == [("w", "FAIL")]
    assert verify.struct_02(rel).count() == 2
    assert dict(rows(verify.struct_03(rel, ent).select("subject", "status"))) == {"o": "PASS", "d": "PASS", "d2": "FAIL"}
    v = spark.createDataFrame([(1, "a", -1.0, 0.1), (1, "b", 0.1, 0.1), (1, "c", 5.0, 0.1)], "world long, i string, mu double, sd double")
    assert [s for _, s in rows(verify.cons_01(v).select("subject", "status"))] == ["FAIL", "WARN", "PASS"]
    done = verify.finished(verify.cons_01(v.filter("i = 'c'")), "CONS-01")
    assert rows(done.select("rule", "status")) == [("CONS-01", "PASS")] and verify.passes(done).first().passes
    cov = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "a", 1.1)], "world long, i string, k string, v double")
    assert verify.gauss_01(cov).first().status == "FAIL"
    le = spark.createDataFrame([(1, "x", 1.0, 2.0, 0.01, 0.01, 0.0), (1, "y", 2.0, 2.05, 1.0, 1.0, 0.0), (1, "z", 3.0, 2.0, 1.0, 1.0, 1.0)], "world long, i string, lhs double, rhs double, var_lhs double, var_rhs double, cov double")
    assert [s for _, s in rows(verify.cons_02(le).select("subject", "status"))] == ["PASS", "WARN", "FAIL"]


def test_decisions(spark):
    v = spark.createDataFrame([(1, 10.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)], "id int, mu double, sd double")
    assert dict(rows(decide.minimum(v, 3.0, 0.95).select("id", "verdict"))) == {1: "SATISFIED", 2: "VIOLATED", 3: "VIOLATED"}
    with pytest.raises(ValueError):
        decide.minimum(v, 3.0, 0.4)
    c = spark.createDataFrame([(1, "SATISFIED", True), (2, "SATISFIED", False), (3, "UNRESOLVED", True), (3, "VIOLATED", True), (4, "UNRESOLVED", True)], "id int, verdict string, covered boolean")
    assert dict(rows(decide.acceptance(c, ["id"]).select("id", "disposition"))) == {1: "ACCEPT", 2: "REQUEST_EVIDENCE", 3: "REJECT", 4: "REQUEST_EVIDENCE"}
    b = spark.createDataFrame([(1, 0.02), (1, 0.02), (2, 0.97), (3, 0.4)], "id int, p_violation double")
    assert dict(rows(decide.clearance(b, 0.95, ["id"]).select("id", "verdict"))) == {1: "SATISFIED", 2: "VIOLATED", 3: "UNRESOLVED"}
    with pytest.raises(Exception, match="unit"):
        decide.calibrated(spark.createDataFrame([(1.0, "mm", "m", 1.0, 0.0)], "indicated double, unit string, expected_unit string, scale double, offset double")).collect()


def test_near_pairs_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    data = [(i, *map(float, rng.uniform(-3, 3, 3)), float(rng.uniform(0, 3)), *map(float, rng.uniform(0.1, 1.5, 3))) for i in range(120)]
    b = spark.createDataFrame(data, "id long, x double, y double, z double, angle double, ex double, ey double, ez double")
    bounds = {r.id: r for r in geometry.bounds(b).collect()}
    want = [(i, j) for i in range(120) for j in range(i + 1, 120) if all(bounds[i][f"{d}0"] - 0.1 <= bounds[j][f"{d}1"] + 0.1 and bounds[j][f"{d}0"] - 0.1 <= bounds[i][f"{d}1"] + 0.1 for d in "xyz")]
    assert rows(geometry.near_pairs(b, 0.2, 0.9)) == sorted(want, key=str)
    one = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.5, 1.0, 2.0, 0.5)], b.schema)
    m = geometry.moment_match(geometry.tile(one, 0.4), ["id"]).first()
    assert np.isclose(m.w, 1.0) and np.allclose([m.mean_x, m.mean_y, m.mean_z], [1, 2, 3])
    square = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (2, 0), (2, 1), (0, 1)])], "id int, n int, x double, y double")
    p = geometry.polygon(square, ["id"]).first()
    assert (p.area, p.cx, p.cy) == (2.0, 1.0, 0.5)


def test_ledger(spark):
    e = spark.createDataFrame([(u, t, f"{u}-{t}") for u in (1, 2) for t in range(5)], "user long, t long, digest string")
    chained = ledger.chain(e, "user", ["t"]).cache()
    assert ledger.validate(chained, "user").isEmpty()
    broken = chained.withColumn("digest", F.when((F.col("user") == 1) & (F.col("seq") == 2), "x").otherwise(F.col("digest")))
    assert rows(ledger.validate(broken, "user").select("user", "seq", "fault")) == [(1, 2, "hash")]
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    leaves = sorted({sha("a"), sha("b"), sha("c")})
    pair = lambda x, y: hashlib.sha256(bytes.fromhex(x) + bytes.fromhex(y)).hexdigest()
    top = pair(pair(leaves[0], leaves[1]), pair(leaves[2], leaves[2]))
    df = spark.createDataFrame([("g", sha(x)) for x in "abca"] + [("h", sha("z"))], "g string, digest string")
    assert dict(rows(ledger.merkle_root(df, "g"))) == {"g": top, "h": sha("z")}


def test_inventory(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, None), (4, "q")], "id int, v string")
    assert rows(inventory.inventory_diff(a, b, ["id"], ["v"])) == [(1, "left_only"), (2, "mismatch"), (4, "right_only")]
    renamed = lambda p: inventory.colour_refinement(spark.createDataFrame([(p + x, "n") for x in "abc"], "node string, label string"), spark.createDataFrame([(p + "a", p + "b", "k"), (p + "b", p + "c", "k")], "src string, dst string, kind string"))
    assert sorted(r.colour for r in renamed("1").collect()) == sorted(r.colour for r in renamed("2").collect())
    with pytest.raises(Exception, match="fields differ"):
        inventory.closed_json(spark.createDataFrame([('{"k":1,"x":2}',)], "j string"), "j", "k int", ["k"]).collect()
    p = spark.createDataFrame([(5, 1), (15, 1), (25, 1)], "a long, b long")
    assert [int(r.product) for r in inventory.fixed_point_product(p, "a", "b", 10).orderBy("a").collect()] == [0, 2, 2]


def test_streamed_filter_equals_batch(spark, tmp_path):
    seen = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 6.0)], "k int, v double")
    seen.write.parquet(str(tmp_path / "in"))
    batch = rows(kalman.posterior(seen, "k", "v", 1.0, 0.0, 10.0))
    q = kalman.posterior(spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in")), "k", "v", 1.0, 0.0, 10.0).writeStream.format("memory").queryName("kf").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("kf")) == batch

import math

import pytest
from helpers import rows

from plumbline.sources import scene, step

HEAD = [("FILE_DESCRIPTION", [["demo"], "2;1"])]
REF = lambda n: {"ref": n}
SI = lambda prefix, name="METRE": [{"omitted": True}, {"enum": "LENGTHUNIT"}, prefix and {"enum": prefix}, {"enum": name}]


def table(spark, *files):
    return step.read_texts(spark.createDataFrame([(f"f{k}", step.write(HEAD, f)) for k, f in enumerate(files)], "file string, text string"))


def chain(n, first=100, cycle=False):
    """n placements, each 1 along x of its parent and turned by a quarter."""
    out = [(1, "IFCCARTESIANPOINT", [[1.0, 0.0]]), (2, "IFCDIRECTION", [[0.0, 1.0, 0.0]]), (3, "IFCDIRECTION", [[0.0, 0.0, 1.0]]), (4, "IFCAXIS2PLACEMENT3D", [REF(1), REF(3), REF(2)])]
    return out + [(first + k, "IFCLOCALPLACEMENT", [REF(first + k - 1) if k else REF(first + n - 1) if cycle else None, REF(4)]) for k in range(n)]


def test_chains_compose_from_the_root(spark):
    got = scene.placements(table(spark, chain(37), [(9, "IFCSIUNIT", SI("MILLI")), *chain(2)]))
    at = {(r.file, r.step_id): (r.x, r.y, r.z, r.angle) for r in got.collect()}
    x = y = angle = 0.0
    for k in range(37):
        x, y = x + math.cos(angle), y + math.sin(angle)
        angle += math.pi / 2
        assert at["f0", 100 + k] == pytest.approx((x, y, 0.0, angle), abs=1e-9)
    assert at["f1", 101] == pytest.approx((1e-3, 1e-3, 0.0, math.pi), abs=1e-12) and len(at) == 39


def test_products_stand_where_their_placement_is(spark):
    t = table(spark, [*chain(1), (5, "IFCWALL", ["W", None, "w", None, None, REF(100)]), (6, "IFCDOOR", ["D", None, "d", None, None, None])])
    got = scene.placed(t, step.entities(t)).select("global_id", "x", "y", "angle")
    assert rows(got) == [("D", 0.0, 0.0, 0.0), ("W", 1.0, 0.0, math.pi / 2)]
    empty = t.filter("false")
    assert scene.placements(empty).isEmpty() and scene.length_units(empty).isEmpty()


@pytest.mark.parametrize(
    ("model", "said"),
    [
        (chain(3, cycle=True), "circle"),
        ([(4, "IFCAXIS2PLACEMENT3D", [None, None, None]), (7, "IFCLOCALPLACEMENT", [REF(99), REF(4)])], "no such parent"),
        ([(3, "IFCDIRECTION", [[0.0, 1.0, 1.0]]), (4, "IFCAXIS2PLACEMENT3D", [None, REF(3), None]), (7, "IFCLOCALPLACEMENT", [None, REF(4)])], "not vertical"),
        ([(3, "IFCDIRECTION", [[1.0, 0.0, 1.0]]), (4, "IFCAXIS2PLACEMENT3D", [None, None, REF(3)]), (7, "IFCLOCALPLACEMENT", [None, REF(4)])], "out of plane"),
    ],
)
def test_wrong_placements(spark, model, said):
    with pytest.raises(Exception, match=said):
        scene.placements(table(spark, model)).collect()


def test_units(spark):
    project = lambda *units: [(1, "IFCPROJECT", ["P", *[None] * 7, REF(2)]), (2, "IFCUNITASSIGNMENT", [[REF(u) for u in units]])]
    t = table(spark, [(1, "IFCWALL", ["W"])], [(1, "IFCSIUNIT", SI(None))], [*project(3), (3, "IFCSIUNIT", SI("CENTI")), (4, "IFCSIUNIT", SI("KILO"))])
    assert rows(scene.length_units(t)) == [("f0", 1.0, None, True), ("f1", 1.0, None, False), ("f2", 0.01, "CENTI", False)]
    wrong = {
        "disagree": [(3, "IFCSIUNIT", SI("CENTI")), (4, "IFCSIUNIT", SI(None))],
        "without length": project(3),
        "not metre": [(3, "IFCSIUNIT", SI(None, "INCH"))],
        "unknown prefix": [(3, "IFCSIUNIT", SI("DOZEN"))],
        "conversion": [(3, "IFCCONVERSIONBASEDUNIT", [None, {"enum": "LENGTHUNIT"}, "foot", None])],
    }
    for said, model in wrong.items():
        with pytest.raises(Exception, match=said):
            scene.length_units(table(spark, model)).collect()


def test_priors_in_metres_with_stated_and_default_deviations(spark):
    number = lambda name, v: ("IFCPROPERTYSINGLEVALUE", [name, None, {"type": "IFCREAL", "args": [v]}, None])
    to = lambda n, s: ("IFCRELDEFINESBYPROPERTIES", ["r", None, None, None, [REF(n)], REF(s)])
    model = [
        (1, "IFCSIUNIT", SI("MILLI")), (2, "IFCWALL", ["W", None, "w"]),
        (3, "IFCQUANTITYLENGTH", ["Length", None, None, 9000.0, None]), (4, "IFCQUANTITYLENGTH", ["Width", None, None, 300.0, None]), (5, *number("UnitCost", 250.0)),
        (6, "IFCELEMENTQUANTITY", ["q", None, "Base", None, None, [REF(3), REF(4)]]), (7, "IFCPROPERTYSET", ["p", None, "Cost", None, [REF(5)]]),
        (8, *number("LengthSigma", 7.0)), (9, *number("LengthSigma", 4.0)), (10, "IFCPROPERTYSET", ["u", None, "Uncertainty", None, [REF(8)]]), (11, "IFCPROPERTYSET", ["o", None, "Posterior", None, [REF(9)]]),
        *((20 + k, *to(2, s)) for k, s in enumerate((6, 7, 10, 11))),
    ]
    t = table(spark, model)
    got = {r.quantity: (r.mu, r.sigma) for r in scene.priors(t, step.entities(t)).collect()}
    assert got == {"Length": pytest.approx((9.0, 0.004)), "Width": pytest.approx((0.3, 0.002)), "UnitCost": pytest.approx((250.0, 20.0))}


def test_faults_of_placements_stay_with_what_stands_on_them(spark):
    tilted = [(3, "IFCDIRECTION", [[0.0, 1.0, 1.0]]), (4, "IFCAXIS2PLACEMENT3D", [None, REF(3), None]), (7, "IFCLOCALPLACEMENT", [None, REF(4)]), (8, "IFCLOCALPLACEMENT", [REF(7), None]), (9, "IFCLOCALPLACEMENT", [REF(99), None])]
    wall = lambda n, at: (n, "IFCWALL", [f"W{n}", None, "w", None, None, at])
    t = table(spark, [*tilted, wall(20, None), wall(21, REF(50)), (50, "IFCLOCALPLACEMENT", [None, None])], [*tilted, wall(20, REF(8)), wall(21, REF(9)), wall(22, REF(98))], chain(3, cycle=True) + [wall(20, REF(101))])
    known = step.entities(t)
    assert scene.placed(t.filter("file = 'f0'"), known.filter("file = 'f0'")).count() == 2
    got = {(r.file, r.step_id): r.fault.split(":")[0] for r in scene.placement_faults(t, known).collect()}
    assert got == {("f1", 20): "axis is not vertical", ("f1", 21): "no such parent placement", ("f1", 22): "no such placement", ("f2", 20): "placements run in a circle"}
    with pytest.raises(Exception, match="not vertical|no such"):
        scene.placed(t, known).collect()

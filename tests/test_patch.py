"""STEP texts edited in place."""

import pytest
from helpers import rows
from test_models import text_of

from plumbline.operators.graph import stored
from plumbline.sources import patch, scene, step
from pyspark.sql import functions as F

TEXT = """ISO-10303-21;HEADER;FILE_DESCRIPTION(('DATA;#1=X();'),'2;1');ENDSEC;
DATA;
#1 = IFCWALL('W' , $, 'a;(b)#2=', $ ) ; /* #3=note(); */
#2=IFCQUANTITYLENGTH('Length',$,$, 9.2 ,$);
#3=IFCPROPERTYSINGLEVALUE('C',$,IFCREAL( 3. ),$);  #4=X();
#5=IFCPROPERTYSET('p',$,'n',$,(#3,(#2,#4)));
ENDSEC;
END-ISO-10303-21;
"""


def test_only_what_is_told_changes():
    assert patch.edit(TEXT, {}, set(), []) == TEXT
    for key, old, new in (((2, 3), "9.2", "1.5"), ((3, 2), "IFCREAL( 3. )", "IFCREAL(7.)"), ((5, 4), "(#3,(#2,#4))", "(#9)"), ((1, 0), "'W'", "'V'"), ((1, 3), "$ )", "* )"), ((5, 0), "'p'", "''")):
        assert patch.edit(TEXT, {key: new.removesuffix(" )")}, set(), []) == TEXT.replace(old, new, 1)
    assert patch.edit(TEXT, {}, {2}, []) == TEXT.replace("#2=IFCQUANTITYLENGTH('Length',$,$, 9.2 ,$);\n", "")
    assert patch.edit(TEXT, {(4, 0): "1"}, {4}, ["#6=Y();", "#7=Z();"]) == TEXT.replace("#4=X();\n", "").replace("ENDSEC;\nEND", "#6=Y();\n#7=Z();\nENDSEC;\nEND")
    for wrong in ((9, 0), (2, 7), (4, 0)):
        with pytest.raises(step.StepError, match="nothing to edit"):
            patch.edit(TEXT, {wrong: "1."}, set(), [])


def test_exports_replace_each_other(spark):
    text = text_of(spark, 6)
    texts = spark.createDataFrame([("a", text), ("b", text)], "file string, text string")
    belief = spark.createDataFrame([("a", 200, "Length", 5.5, 0.0125), ("a", 200, "UnitCost", 333.25, 0.0), ("a", 300, "Width", 0.25, 0.002)], "file string, product long, quantity string, mu double, sigma double")
    parsed = lambda df: stored(step.read_texts(df))
    once = stored(patch.export(texts, parsed(texts), belief))
    got = dict(rows(once))
    assert got["b"] == text and got["a"] != text
    read = parsed(once)
    known = step.entities(read).filter("file = 'a'")
    said = {(r.step_id, r.quantity): (round(r.mu, 9), round(r.sigma, 9)) for r in scene.priors(read, known, ("Posterior",)).collect()}
    assert said[200, "Length"] == (5.5, 0.0125) and said[200, "UnitCost"] == (333.25, 1e-6) and said[300, "Width"] == (0.25, 0.002)
    assert said[300, "Length"] == (4.25, 0.005)  # not in the belief
    twice = parsed(patch.export(once, read, belief))
    assert twice.filter("type_name = 'IFCPROPERTYSET' AND args LIKE '%Posterior%'").groupBy("file").count().filter("file = 'a'").first()["count"] == 2
    again = twice.filter("file = 'a'")
    assert again.count() == read.filter("file = 'a'").count() and again.groupBy("step_id").count().filter("count > 1").isEmpty()
    assert {(r.step_id, r.quantity): (round(r.mu, 9), round(r.sigma, 9)) for r in scene.priors(twice, known, ("Posterior",)).collect()} == said


def test_reals(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 0.1, 1e300, 1e-7, -2.5e17, 333.25)], "x double").select("x", patch.real(F.col("x")).alias("t"))
    for r in df.collect():
        assert float(r.t) == r.x and step.parse(f"ISO-10303-21;HEADER;ENDSEC;DATA;#1=X({r.t});ENDSEC;END-ISO-10303-21;")[1][0][2] == [r.x]

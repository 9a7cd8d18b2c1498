"""Texts that lie together are parsed and written by all tasks."""

from pyspark.sql import functions as F

from plumbline.sources import patch, step

TEXT = "ISO-10303-21;HEADER;ENDSEC;DATA;#1=IFCPROJECT('P',$,$,$,$,$,$,$,#2);#2=IFCUNITASSIGNMENT((#3));#3=IFCSIUNIT(*,.LENGTHUNIT.,$,.METRE.);ENDSEC;END-ISO-10303-21;"


def tasks(df):
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_texts_of_one_partition_are_spread(spark):
    texts = spark.createDataFrame([(f"f{k}", TEXT) for k in range(60)], "file string, text string").coalesce(1)
    rows = step.read_texts(texts)
    assert rows.count() == 180 and tasks(rows) > 1
    none = spark.createDataFrame([], "file string, product long, quantity string, mu double, sigma double")
    back = patch.export(texts, rows, none)
    assert {r.text for r in back.collect()} == {TEXT} and tasks(back) > 1

"""Large rows are read a few at a time, and a measurement makes the blocks that it touches alone."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import blocks
from plumbline.sources import step


def test_variances_need_only_the_touched_blocks(spark):
    size, n = 4, 18
    v = spark.range(n).select(F.lit("w").alias("world"), F.col("id").alias("i"), (1.0 + F.col("id") % 3).alias("sd"), (F.col("id") * 1.0).alias("mu"))
    sd, mu = blocks.vectors(v, "sd", size), blocks.vectors(v, "mu", size)
    row = spark.createDataFrame([("w", 2, [0.0, 1.0, 0.0, 0.0])], blocks.VECTOR)
    seen = spark.createDataFrame([("w", 19.0, 9.0, 25.0)], "world string, y double, predicted double, noise double")
    some = blocks.touched(sd, row)
    assert some.count() == 9  # five on the diagonal, and the row's block with each of the others
    m2, cov = blocks.condition(mu, blocks.correlated(sd, 0.9, size), row, seen)
    m1, var = blocks.condition(mu, blocks.correlated(sd, 0.9, size, some), row, seen, variances_only=True)
    pick = lambda df: [x.v for x in blocks.cells(df, size).orderBy("i").collect()]
    assert np.allclose(pick(m1), pick(m2))
    assert np.allclose(pick(var), [x.v for x in blocks.diagonal(cov, size).orderBy("i").collect()])


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    key, told = "spark.sql.parquet.columnarReaderBatchSize", []
    real = blocks.stored
    monkeypatch.setattr(blocks, "stored", lambda df: (told.append(int(spark.conf.get(key))), real(df))[1])
    before = spark.conf.get(key)
    sd = spark.createDataFrame([("w", 0, [1.0, 2.0])], blocks.VECTOR)
    blocks.diagonal(blocks.correlated(sd, 0.9))
    assert told == [blocks.BATCH, blocks.BATCH] and spark.conf.get(key) == before


def test_texts_are_parsed_in_slices(spark, monkeypatch):
    text = "ISO-10303-21;HEADER;FILE_DESCRIPTION(('m'),'2;1');ENDSEC;DATA;#1=IFCPROJECT('P');ENDSEC;END-ISO-10303-21;"
    most = []

    class Texts:
        def select(self, *names):
            return self

        def mapInPandas(self, run, schema):
            import pandas as pd

            return [most.append(len(x)) or x for x in run(iter([pd.DataFrame({"file": [str(k) for k in range(250)], "text": [text] * 250})]))]

    out = step.read_texts(Texts())
    assert max(most) <= 100 and sum(most) == 250 and out[2]["file"].iloc[-1] == "249"

"""Takes instrument readings as their files arrive, and keeps beliefs, decisions and dispositions of every asset.

A stream over the input's files, run until nothing new is left; its checkpoint knows which files were taken. Every batch
refuses readings that can't be used, with the reason, calibrates the others, drops those that earlier batches brought
already (the same reading at the same time), and writes three tables under the number of the batch, whose folder a
repeated batch writes anew: ``readings`` by day, ``refusals`` by reason, and ``statistics``, the number and the exact sum of
each asset's readings of a kind. Those add up over batches, so a belief (the posterior of a constant seen with noise) never
needs old readings again. At the end beliefs are decided against each kind's least value, and decisions folded into one
disposition per asset: ``decisions`` by kind and ``dispositions`` are written anew from all statistics.

Cases: nulls in any column are refused with the first reason that fits; of readings repeated within a batch the least
(asset, kind, value) counts and the others are refused as repeated; an empty input leaves empty tables; a run with nothing new
leaves every table as it was; kinds without a config entry are refused as unknown.

Run: python jobs/readings.py --input DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from plumbline.operators import decide
from plumbline.streaming import kalman

NAME = "readings"
log = logging.getLogger(f"jobs.{NAME}")

KEY = "reading long, at timestamp, asset long, kind string"
READINGS = f"{KEY}, value double, batch long, day date"
REFUSALS = f"{KEY}, value double, copies long, batch long, reason string"
STATISTICS = "asset long, kind string, n long, total decimal(38,6), batch long"
DECISIONS = "asset long, n long, mean double, sd double, p double, verdict string, covered boolean, kind string"
DISPOSITIONS = "asset long, violated long, unresolved long, uncovered long, disposition string"


def kind_map(config: dict, name: str) -> Column:
    """What the config says of the row's kind; null for unknown kinds."""
    known = F.create_map(*(F.lit(x) for k, v in sorted(config["kinds"].items()) for x in (k, float(v[name]))))
    return F.try_element_at(known, F.col("kind"))


def reason(config: dict) -> Column:
    """Why a reading can't be used; null if it can."""
    bad = F.when(F.col("reading").isNull(), "no reading id").when(F.col("at").isNull(), "no time").when(F.col("asset").isNull(), "no asset")
    bad = bad.when(F.col("kind").isNull() | kind_map(config, "noise").isNull(), "unknown kind").when(F.col("value").isNull(), "no value")
    return bad.when(F.isnan("value") | (F.abs("value") == float("inf")), "value not finite")


def calibrated(rows: DataFrame, config: dict) -> DataFrame:
    """Readings in the unit of their kind's least value, to six decimals so that sums are exact."""
    seen = rows.withColumns({"indicated": F.col("value"), "unit": F.col("kind"), "expected_unit": F.col("kind"), "scale": kind_map(config, "scale"), "offset": kind_map(config, "offset")})
    return decide.calibrated(seen).select("reading", "at", "asset", "kind", F.round("value", 6).alias("value"))


def own(spark: SparkSession, output: str) -> None:
    """A stream that begins must not find batches of another checkpoint: they would count twice."""
    try:
        other = spark.read.schema(STATISTICS).parquet(f"{output}/statistics").agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return
    if other:
        raise ValueError(f"{output} holds batches up to {other} of another checkpoint; give an empty folder or that checkpoint")


def take(batch: DataFrame, number: int, output: str, config: dict) -> None:
    """One batch: readings, refusals and statistics under its number."""
    spark = batch.sparkSession
    if number == 0:
        own(spark, output)
    rows = batch.withColumn("reason", reason(config)).persist()
    try:
        value = F.struct("asset", "kind", "value")
        one = rows.filter("reason IS NULL").groupBy("reading", "at").agg(F.min(value).alias("least"), F.count("*").alias("copies"))
        one = one.select("reading", "at", "least.*", "copies", F.to_date("at").alias("day"))
        fresh = one
        if number:
            earlier = spark.read.schema(READINGS).parquet(f"{output}/readings").filter(F.col("batch") < number)
            fresh = one.join(earlier.join(one.select("day").distinct(), "day", "left_semi"), ["reading", "at"], "left_anti")
        kept = calibrated(fresh, config).withColumn("day", F.to_date("at"))
        kept.write.mode("overwrite").partitionBy("day").parquet(f"{output}/readings/batch={number}")
        kept = spark.read.schema(READINGS).parquet(f"{output}/readings").filter(F.col("batch") == number)
        # copies beyond those that were taken
        again = one.join(kept.select("reading", "at", F.lit(1).alias("taken")), ["reading", "at"], "left").withColumn("copies", F.col("copies") - F.coalesce("taken", F.lit(0)))
        columns = [c.split()[0] for c in KEY.split(", ")] + ["value", "copies", "reason"]
        refused = rows.filter("reason IS NOT NULL").withColumn("copies", F.lit(1).cast("long")).select(*columns)
        refused = refused.unionByName(again.filter("copies > 0").withColumn("reason", F.lit("repeated")).select(*columns))
        refused.write.mode("overwrite").partitionBy("reason").parquet(f"{output}/refusals/batch={number}")
        sums = kept.groupBy("asset", "kind").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("decimal(38,6)").alias("total"))
        sums.write.mode("overwrite").parquet(f"{output}/statistics/batch={number}")
        said = spark.read.schema(REFUSALS).parquet(f"{output}/refusals").filter(F.col("batch") == number).agg(F.sum("copies")).first()[0] or 0
        log.info("batch %d: read %d rows, wrote %d readings and refused %d", number, rows.count(), kept.count(), said)
    finally:
        rows.unpersist()


def settle(spark: SparkSession, output: str, config: dict) -> None:
    """Decisions and dispositions from the statistics of all batches."""
    sums = spark.read.schema(STATISTICS).parquet(f"{output}/statistics").groupBy("asset", "kind").agg(F.sum("n").alias("n"), F.sum("total").cast("double").alias("s"))
    beliefs = kalman.settled(sums, *(kind_map(config, k) for k in ("noise", "prior_mean", "prior_variance")))
    beliefs = beliefs.withColumns({"mu": F.col("mean"), "sd": F.sqrt("variance")})
    p = decide.probability_above(F.col("mu"), F.col("sd"), kind_map(config, "least"))
    decided = beliefs.withColumn("p", p).withColumns({"verdict": decide.verdict(F.col("p"), config["confidence"]), "covered": F.col("n") >= config["readings_needed"]})
    decided = decided.select(*(c.split()[0] for c in DECISIONS.split(", ")))
    decided.write.mode("overwrite").partitionBy("kind").parquet(f"{output}/decisions")
    cases = decide.acceptance(spark.read.schema(DECISIONS).parquet(f"{output}/decisions"), ["asset"])
    cases.write.mode("overwrite").parquet(f"{output}/dispositions")


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take all new files of ``input`` and bring the tables under ``output`` up to date; returns their numbers of rows."""
    config = config or common.defaults(NAME)
    schema = spark.read.format(config["format"]).load(input).schema
    rows = spark.readStream.format(config["format"]).schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).load(input)
    rows = common.columns(rows, config["columns"]).selectExpr(*(f"cast(`{c}` AS {t}) AS `{c}`" for c, t in (x.split() for x in f"{KEY}, value double".split(", "))))
    log.info("reading new files of %s (checkpoint %s)", input, checkpoint)
    query = rows.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    settle(spark, output, config)
    tables = tables_of(spark, output)
    counts = {k: df.count() for k, df in tables.items()}
    log.info("%s now holds %s", output, ", ".join(f"{n} {k}" for k, n in counts.items()))
    return counts


def tables_of(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The job's tables by name."""
    return {k: spark.read.schema(s).parquet(f"{output}/{k}") for k, s in (("readings", READINGS), ("refusals", REFUSALS), ("statistics", STATISTICS), ("decisions", DECISIONS), ("dispositions", DISPOSITIONS))}


def job1_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all events, twice into one folder; its readings, refusals, decisions and dispositions after the second run.

    A stream takes a single file only by a pattern.
    """
    base = common.scratch(spark, NAME)
    for _ in range(2):
        run(spark, f"{sf_dir}/event[s].parquet", f"{base}/output", f"{base}/checkpoint")
    t = tables_of(spark, f"{base}/output")
    out = None
    for name, row in (
        ("reading", {"asset": "asset", "kind": "kind", "reading": "reading", "n": "1", "value": "round(value, 4)"}),
        ("refusal", {"asset": "asset", "kind": "kind", "reading": "reading", "n": "copies", "value": "round(value, 4)", "said": "reason"}),
        ("decision", {"asset": "asset", "kind": "kind", "n": "n", "value": "round(mean, 6)", "p": "round(p, 6)", "said": "verdict"}),
        ("disposition", {"asset": "asset", "n": "violated + unresolved + uncovered", "said": "disposition"}),
    ):
        types = {"asset": "long", "kind": "string", "reading": "long", "n": "long", "value": "double", "p": "double", "said": "string"}
        part = t[f"{name}s"].selectExpr(f"'{name}' AS output", *(f"cast({row.get(c, 'null')} AS {k}) AS {c}" for c, k in types.items()))
        out = part if out is None else out.unionByName(part)
    return out


if __name__ == "__main__":
    common.main(NAME, run, {"input": "folder of reading files", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"})

"""What the jobs share: their command line, config files, and paths."""

from __future__ import annotations

import argparse
import json
import logging
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def defaults(name: str) -> dict:
    """The config file that comes with a job."""
    with open(os.path.join(HERE, f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)


def config(spark: SparkSession, name: str, path: str | None) -> dict:
    """The job's own config, with what the file at ``path`` (any path that Spark reads) says instead; unknown keys are errors."""
    base = defaults(name)
    if path is None:
        return base
    said = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(said, dict) or (more := set(said) - set(base)):
        raise ValueError(f"{path}: unknown keys {sorted(more)}" if isinstance(said, dict) else f"{path}: not an object")
    return base | said


def columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that a job needs, under its own names; others are not read."""
    lost = [c for c in names.values() if c.lower() not in {x.lower() for x in df.columns}]
    if lost:
        raise ValueError(f"the input lacks the columns {lost}")
    return df.selectExpr(*(f"`{c}` AS `{k}`" for k, c in names.items()))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a session on one machine, as in tests, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="plumbline-")
    return f"{base.rstrip('/')}/jobs/{name}-{uuid.uuid4().hex}"


def main(name: str, run: Callable[..., dict], paths: dict[str, str], argv: list[str] | None = None) -> None:
    """Command line: a session is made, the job run with the paths and its config, and the session stopped."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for path, said in paths.items():
        parser.add_argument(f"--{path}", required=True, help=said)
    parser.add_argument("--config", help=f"a JSON file whose keys replace those of jobs/{name}.json")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, config=config(spark, name, args.pop("config")), **args)
    finally:
        spark.stop()

"""From raw documents to a token-ready corpus: each stage is one operator of ``plumbline.llm``.

Every stage works on all that its predecessor kept. The first four return the columns of ``documents``; the last adds the
piece numbers. A document that the mix takes several times has that many equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, mixing, near_dedup, subword, toxicity
from plumbline.llm.common import drop, materialize

#: Documents with at least this toxicity go.
TOXIC = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """row, and key: the id, which may be null or stand on several texts, and the text's digest."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("doc_id").alias("id"), digest.alias("digest")).alias("key"))


def _kept(packed: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``packed`` for each key in ``keys``: of rows with one id and text the first by all their columns."""
    fields = packed.schema["row"].dataType.fields
    row = F.min("row")
    if any("map<" in f.dataType.simpleString() for f in fields):  # maps have no order: their text stands for them
        own = [F.to_json(F.struct(F.col(f"row.`{f.name}`").alias("m"))) if "map<" in f.dataType.simpleString() else F.col(f"row.`{f.name}`") for f in fields]
        row = F.min_by("row", F.struct(*(c.alias(f"c{i}") for i, c in enumerate(own))))
    return packed.join(keys, "key", "left_semi").groupBy("key").agg(row.alias("row")).select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels finds toxic go.

    Null and empty texts stay; repeated rows are judged alike; without labels of both kinds, or with an empty table, nothing
    goes; all columns stay as they are, but one named as a result of the scoring (toxicity, toxic_spans) is an error.
    """
    clash = {"toxicity", "toxic_spans"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"documents have columns with the names of results: {sorted(clash)}")
    model = toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).filter(F.col("toxicity") < TOXIC).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null counts as the empty text; a row without an id stays only if no other has its text; of rows with one id and text the
    first by all columns stays; an empty table stays empty; columns of any name are kept.
    """
    found = exact_dedup.exact_duplicates(docs)
    return _kept(_packed(docs), found.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.struct("id", "digest").alias("key")))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays; a row without an id counts as the largest.

    Null and empty texts are linked with nothing and stay; an id on several texts is one document for each of them; of rows
    with one id and text the first by all columns stays; an empty table stays empty; columns of any name are kept.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        found = near_dedup.near_duplicates(docs.select("doc_id", "text"))
        ids = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id")
        return docs.join(ids, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    # ids don't tell the rows apart: numbers in the order of ids and digests stand for them
    packed = _packed(docs)
    order = packed.select("key").distinct().orderBy(F.asc_nulls_last("key.id"), "key.digest")
    number = materialize(order.withColumn("n", F.monotonically_increasing_id()), "row-numbers")
    found = near_dedup.near_duplicates(packed.join(number, "key").select("n", "row.text"), "n")
    keys = number.join(found.filter(F.col("n") == F.col("component_id")).select("n"), "n", "left_semi").select("key")
    return _kept(packed, keys)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them.

    A null source is one of its own; texts without words are taken like others; equal rows share their copies; an empty
    table stays empty; columns of any name are kept.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with sampled pieces.

    Null and empty texts have no pieces; equal rows get equal pieces; a column named pieces is replaced, others are kept.
    """
    return subword.encode_texts(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mixing", mix_sources), ("sentencepiece", tokenize)]
#: The first, third and last stage can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs

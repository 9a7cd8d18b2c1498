"""Registers evidence documents: one commitment for each, Merkle roots for each source and for all, and refusals with reasons.

A reviewer who holds a root can be shown that a document was registered, and that it is unchanged, without the other
documents. A document's commitment covers its id, language, source and text. Documents of a source are dealt to 256 buckets by
the first byte of their commitments; a bucket's root is that of its sorted commitments, a source's root that of its
buckets' roots, and the root of all that of the sources' roots, so that no task sorts a whole source. Four tables are
written: ``register`` and ``refusals``, both by source, ``roots``, and ``proofs``, the paths to the source's root for the ids that
the config lists, each verified before it is written.

Cases: a null id and a null or blank text are refused; an id with different contents is refused as a conflict, one with equal
contents is registered once with its number of copies; a null source counts as ``unknown`` (and so do empty ones) and a null language as an
empty one; an empty input leaves empty tables; a run over the same input writes the same tables.

Run: python jobs/register.py --input DIR --output DIR [--config FILE]
"""

from __future__ import annotations

import logging
import os
import sys

if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from plumbline.operators import ledger

NAME = "register"
log = logging.getLogger(f"jobs.{NAME}")

REGISTER = "id long, lang string, digest string, text_sha256 string, n_chars long, copies long, bucket string, source string"
REFUSALS = "id long, copies long, reason string, source string"
ROOTS = "level string, source string, bucket string, root string, documents long"
PROOFS = "id long, source string, digest string, path array<struct<level:long,hash:string,left:boolean>>, root string, valid boolean"
#: Between source and bucket in the name of a group; no source name holds it, as all control characters count as spaces.
SEP = "\x1f"


def committed(rows: DataFrame) -> DataFrame:
    """rows (id, text, lang, source) with reason, digest, text_sha256 and n_chars; the text itself goes no further."""
    source = F.coalesce(F.nullif(F.trim(F.regexp_replace("source", r"[\x00-\x1F\x7F]", " ")), F.lit("")), F.lit("unknown"))
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "no text")
    out = rows.withColumns({"source": source, "reason": reason, "text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256), "n_chars": F.length("text").cast("long")})
    return out.withColumn("digest", ledger.event_digest(["id", "lang", "source", "text_sha256"])).drop("text")


def settled(rows: DataFrame) -> DataFrame:
    """One row per id (and per source, for refused rows) with its copies; an id with several digests is a conflict."""
    sound = rows.filter("reason IS NULL").groupBy("id").agg(F.min(F.struct("digest", "lang", "source", "text_sha256", "n_chars")).alias("one"), F.max("digest").alias("most"), F.count("*").alias("copies"))
    sound = sound.select("id", "one.*", "copies", F.when(F.col("one.digest") != F.col("most"), "conflict").alias("reason"))
    refused = rows.filter("reason IS NOT NULL").groupBy("id", "source", "reason").agg(F.count("*").alias("copies"))
    return sound.unionByName(refused, allowMissingColumns=True).withColumn("bucket", F.substring("digest", 1, 2))


def roots(register: DataFrame) -> DataFrame:
    """(level, source, bucket, root, documents) of buckets, sources and all."""
    group = F.concat_ws(SEP, "source", "bucket").alias("group")
    name = F.split("group", SEP)
    sizes = register.groupBy("source", "bucket").agg(F.count("*").alias("documents"))
    low = ledger.merkle_root(register.select(group, "digest"), "group").select(name[0].alias("source"), name[1].alias("bucket"), "root").join(sizes, ["source", "bucket"])
    low = ledger._cut(low)
    mid = ledger.merkle_root(low.select("source", F.col("root").alias("digest")), "source").join(sizes.groupBy("source").agg(F.sum("documents").alias("documents")), "source")
    mid = ledger._cut(mid)
    whole = ledger.merkle_root(mid.select(F.lit("").alias("all"), F.col("root").alias("digest")), "all").join(mid.agg(F.sum("documents").alias("documents")))
    pick = lambda df, level, source, bucket: df.select(F.lit(level).alias("level"), source.cast("string").alias("source"), bucket.cast("string").alias("bucket"), "root", "documents")
    return pick(low, "bucket", F.col("source"), F.col("bucket")).unionByName(pick(mid, "source", F.col("source"), F.lit(None))).unionByName(pick(whole, "all", F.lit(None), F.lit(None)))


def proofs(register: DataFrame, made: DataFrame, ids: list[int]) -> DataFrame:
    """(id, source, digest, path, root, valid) of the listed ids: from the commitment through its bucket to the source's root.

    Only the buckets of those ids are read again.
    """
    asked = register.filter(F.col("id").isin([int(i) for i in ids])).select("id", "source", "bucket", "digest")
    leaves = register.join(asked.select("source", "bucket").distinct(), ["source", "bucket"], "left_semi").select(F.concat_ws(SEP, "source", "bucket").alias("group"), "digest")
    low = ledger.merkle_proofs(leaves, "group").join(asked.select("id", F.concat_ws(SEP, "source", "bucket").alias("group"), "digest"), ["group", "digest"])
    low = low.select("id", "digest", F.split("group", SEP)[0].alias("source"), F.split("group", SEP)[1].alias("bucket"), F.col("path").alias("low"))
    buckets = made.filter("level = 'bucket'").join(asked.select("source").distinct(), "source", "left_semi")
    high = ledger.merkle_proofs(buckets.select("source", F.col("root").alias("digest")), "source").select("source", F.col("digest").alias("root"), F.col("path").alias("high"))
    whole = low.join(buckets.select("source", "bucket", "root"), ["source", "bucket"]).join(high, ["source", "root"]).select("id", "source", "digest", F.concat("low", "high").alias("path"))
    return ledger.merkle_verify(whole, made.filter("level = 'source'").select("source", "root"), "source")


def run(spark: SparkSession, input: str, output: str, config: dict | None = None) -> dict:
    """Register all documents of ``input`` in tables under ``output``; returns their numbers of rows."""
    config = config or common.defaults(NAME)
    log.info("reading %s", input)
    rows = common.columns(spark.read.format(config["format"]).load(input), config["columns"])
    rows = rows.selectExpr("cast(id AS long) AS id", "cast(text AS string) AS text", "cast(lang AS string) AS lang", "cast(source AS string) AS source")
    one = ledger._cut(settled(committed(rows)))
    names = lambda schema: [c.split()[0] for c in schema.split(", ")]
    # a task writes one bucket of one source: a source with a third of all documents goes to 256
    kept = one.filter("reason IS NULL").select(*names(REGISTER)).repartition("source", "bucket")
    kept.sortWithinPartitions("source", "digest").write.mode("overwrite").partitionBy("source").parquet(f"{output}/register")
    one.filter("reason IS NOT NULL").select(*names(REFUSALS)).write.mode("overwrite").partitionBy("source").parquet(f"{output}/refusals")
    register = spark.read.schema(REGISTER).parquet(f"{output}/register")
    roots(register).write.mode("overwrite").partitionBy("level").parquet(f"{output}/roots")
    made = spark.read.schema(ROOTS).parquet(f"{output}/roots")
    shown = proofs(register, made, config["prove"]) if config["prove"] else spark.createDataFrame([], PROOFS)
    shown.selectExpr(*(f"cast({c} AS {t}) AS {c}" for c, t in (x.split(" ", 1) for x in PROOFS.split(", ")))).write.mode("overwrite").parquet(f"{output}/proofs")
    tables = tables_of(spark, output)
    counts = {k: df.count() for k, df in tables.items()}
    log.info("wrote %s to %s", ", ".join(f"{n} {k}" for k, n in counts.items()), output)
    if (bad := tables["proofs"].filter("NOT valid").count()) or counts["proofs"] < tables["register"].filter(F.col("id").isin(config["prove"])).count():
        raise ValueError(f"{bad} of the proofs lead to no root")
    return counts


def tables_of(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The job's tables by name."""
    return {k: spark.read.schema(s).parquet(f"{output}/{k}") for k, s in (("register", REGISTER), ("refusals", REFUSALS), ("roots", ROOTS), ("proofs", PROOFS))}


def job2_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over all documents, twice into one folder; its register, refusals and roots after the second run."""
    base = common.scratch(spark, NAME)
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{base}/output")
    t = tables_of(spark, f"{base}/output")
    out = None
    for name, row in (
        ("register", {"id": "id", "source": "source", "bucket": "bucket", "digest": "digest", "n": "copies", "n_chars": "n_chars", "said": "lang"}),
        ("refusals", {"id": "id", "source": "source", "n": "copies", "said": "reason"}),
        ("roots", {"source": "source", "bucket": "bucket", "digest": "root", "n": "documents", "said": "level"}),
    ):
        types = {"id": "long", "source": "string", "bucket": "string", "digest": "string", "n": "long", "n_chars": "long", "said": "string"}
        part = t[name].selectExpr(f"'{name}' AS output", *(f"cast({row.get(c, 'null')} AS {k}) AS {c}" for c, k in types.items()))
        out = part if out is None else out.unionByName(part)
    return out


if __name__ == "__main__":
    common.main(NAME, run, {"input": "folder of documents", "output": "folder of the tables"})

"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest. A batch of documents is reduced to one row per digest and
anti-joined with the index by sort-merge on the buckets (the index side needs neither shuffle nor sort); what is new is
appended in the same layout. For texts that the index knows, a row with the batch's largest id and its number of rows is
appended too, so that the index always gives the largest id and the size of each group over all batches: reading it
adds the rows of a digest up within its bucket. The number of buckets is kept beside the data and holds for whoever
attaches the index later.

Cases: null counts as the empty text; repeated rows and ties are equal texts, of which the largest id of all batches
stays; a null id stays only if its text has no other; an empty table gives an empty table; columns other than the id and
the text are not read, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import delete, drop, hot_join, materialize, shared_dir

#: Buckets of an index, each one sorted file per batch: at least so many, and one for so many rows of the first batch.
BUCKETS, BUCKET_ROWS = 16, 250_000
#: Batches in which :func:`exact_duplicates` adds a table: the later ones are anti-joined with the earlier.
BATCHES = 2


class DigestIndex:
    """What has been seen so far: digest, keep_id, group_size, batch, and whether the batch brought the text (first).

    ``path`` holds the rows in ``rows`` and the number of buckets in ``layout``. An index that is there already is attached with
    its own number of buckets, whatever ``buckets`` says.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/plumbline/{self.name}"
        layout = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout")
        if layout.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(layout):
            self.buckets = spark.read.parquet(f"{self.path}/layout").first()[0]
        else:
            self.buckets = buckets
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{self.path}/layout")

    def exists(self) -> bool:
        """Whether rows have been written; those that an earlier application left at ``path`` are attached."""
        if self.spark.catalog.tableExists(self.name):
            return True
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return False
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING, first BOOLEAN) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")
        return True

    def read(self) -> DataFrame:
        """(digest, keep_id, group_size) of every text; the buckets make a shuffle unnecessary."""
        return self.spark.table(self.name).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def known(self) -> DataFrame:
        """(digest): each text once, from the batch that brought it."""
        return self.spark.table(self.name).filter("first").select("digest")

    def append(self, digests: DataFrame) -> DataFrame:
        """Add the rows of ``digests`` (id, digest); returns (digest, keep_id, group_size) of the texts that were new."""
        batch = digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        stamp = uuid.uuid4().hex
        if self.exists():
            batch = materialize(batch, "digest-batch")
            known = self.known().hint("merge")
            new = batch.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
            again = batch.join(known, "digest", "left_semi").withColumn("first", F.lit(False))
            rows = new.unionByName(again)
        else:
            rows = batch.withColumn("first", F.lit(True))
        rows = rows.select("digest", "keep_id", "group_size", F.lit(stamp).alias("batch"), "first").repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").option("path", f"{self.path}/rows").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        if hasattr(batch, "_plumbline_path"):
            drop(batch)
        return self.spark.table(self.name).filter((F.col("batch") == stamp) & F.col("first")).select("digest", "keep_id", "group_size")

    def remove(self) -> None:
        """Delete the index with its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of each row."""
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def groups(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` (id, digest) with keep_id and group_size from the index."""
    total = index.read().agg(F.sum("group_size")).first()[0] or 0
    return hot_join(rows, index.read(), "digest", "group_size", total).select("id", "digest", "keep_id", "group_size")


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """Adds the rows of ``docs`` to the index and returns, per row: id, digest, keep_id, group_size.

    The rows go in in ``batches`` parts, dealt by a hash of id and digest, so that copies meet both within a part and across
    parts. Without ``index`` one is made for this table and removed at the end.
    """
    spark = docs.sparkSession
    rows = materialize(digests(docs, id_col, text_col).withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.lit(batches))), "digests")
    own = index is None
    index = index or DigestIndex(spark, buckets=max(BUCKETS, rows.count() // BUCKET_ROWS))
    for part in range(batches):
        index.append(rows.filter(F.col("part") == part))
    found = materialize(groups(rows.select("id", "digest"), index), "digest-groups")
    drop(rows)
    if own:
        index.remove()
    return found


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    found = exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY sha256(coalesce(text, '')))
"""

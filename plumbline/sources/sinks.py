"""Writers: snapshots, ledgers, JSON state, splat files and issue topics."""

from __future__ import annotations

import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.belief import belief_digest, correlations


def write_snapshot(mean: DataFrame, cov: DataFrame, path: str) -> None:
    """Means, covariances and their digests as Parquet, dealt by world."""
    mean.write.mode("overwrite").parquet(f"{path}/mean")
    cov.write.mode("overwrite").parquet(f"{path}/cov")
    belief_digest(mean, cov).write.mode("overwrite").parquet(f"{path}/digest")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of a snapshot; a digest that does not fit is an error."""
    mean, cov = spark.read.parquet(f"{path}/mean"), spark.read.parquet(f"{path}/cov")
    wrong = belief_digest(mean, cov).exceptAll(spark.read.parquet(f"{path}/digest")).limit(1).collect()
    if wrong:
        raise ValueError(f"the snapshot of world {wrong[0].world} is not what was written")
    return mean, cov


def append_ledger(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def state_json(mean: DataFrame, cov: DataFrame, k: int = 200, floor: float = 0.2) -> DataFrame:
    """(world, state): each world's quantities and its ``k`` strongest correlations, as JSON."""
    sd = cov.filter("i = k").select("world", "i", F.sqrt("v").alias("sd"))
    q = mean.join(sd, ["world", "i"]).groupBy("world").agg(F.array_sort(F.collect_list(F.struct("i", "mu", "sd"))).alias("quantities"))
    rank = F.row_number().over(Window.partitionBy("world").orderBy(F.desc(F.abs("corr")), "i", "k"))
    c = correlations(cov, floor).withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("world").agg(F.array_sort(F.collect_list(F.struct("i", "k", "corr"))).alias("correlations"))
    return q.join(c, "world", "left").select("world", F.to_json(F.struct("quantities", F.coalesce("correlations", F.array().cast("array<struct<i:string,k:string,corr:double>>")).alias("correlations"))).alias("state"))


def splat(rows: list[tuple[float, ...]]) -> bytes:
    """A binary PLY of primitives (x, y, z, vx, vy, vz, weight): log scales, unit rotation, opacity as a logit."""
    import math

    names = ("x", "y", "z", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")
    head = "ply\nformat binary_little_endian 1.0\n" + f"element vertex {len(rows)}\n" + "".join(f"property float {n}\n" for n in names) + "end_header\n"
    logit = lambda w: math.log(min(max(w, 1e-6), 1 - 1e-6) / (1 - min(max(w, 1e-6), 1 - 1e-6)))
    return head.encode() + b"".join(struct.pack("<11f", x, y, z, logit(w), *(math.log(math.sqrt(max(v, 1e-12))) for v in (vx, vy, vz)), 1, 0, 0, 0) for x, y, z, vx, vy, vz, w in rows)


def topics(requests: DataFrame, case: str, check: str, title: str) -> DataFrame:
    """One issue topic per evidence request, its id derived from the case and the check, so that reruns agree."""

    # a name-based UUID of version 5: the first 16 bytes of a SHA-1, with version and variant set
    space = F.unhex(F.lit(uuid.NAMESPACE_URL.hex))
    digest = F.sha1(F.concat(space, F.concat_ws("/", F.col(case).cast("string"), F.col(check).cast("string")).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 8).cast("long")))
    topic = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return requests.select(topic.alias("topic_id"), F.col(title).alias("title"), F.lit("Open").alias("status"))


def file_digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()

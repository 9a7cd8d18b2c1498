"""Lifecycles over the events: a user's week is an external action, its events are steps; once as a batch and once as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.graph import new_folder
from plumbline.plans import worlds as w
from plumbline.plans.catalog import query
from plumbline.streaming import lifecycles

STATES = {"view": "PROPOSED", "click": "AUTHORIZED", "signup": "STARTED", "purchase": "COMPLETED", "error": "CANCELLED"}


def _records(e):
    """(RECORD): the events' order by time and id is their sequence number; small values lack an authorization."""
    state = F.create_map(*(F.lit(x) for kv in STATES.items() for x in kv))[F.col("event_type")]
    name = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.dayofmonth("ts") / 7).cast("string"))
    seq = (F.unix_date(F.to_date("ts")) - 19_000).cast("long") * 10_000_000_000 + F.col("event_id")
    return e.select(F.lit("external_action").alias("kind"), name.alias("id"), seq.alias("seq"), state.alias("state"), F.when(F.col("value") >= 10, F.lit("order")).alias("authorization"), F.sha2(F.col("user_id").cast("string"), 256).alias("world_digest"), F.lit(None).cast("string").alias("evidence_digest"))


LIFE = """WITH RECURSIVE r AS (SELECT user_id || '-' || (day(ts) // 7) AS id, ((ts::DATE - DATE '1970-01-01') - 19000)::BIGINT * 10000000000 + event_id AS seq, value,
  CASE event_type WHEN 'view' THEN 'PROPOSED' WHEN 'click' THEN 'AUTHORIZED' WHEN 'signup' THEN 'STARTED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'CANCELLED' END AS state FROM events),
bad AS (SELECT * FROM r WHERE value < 10 AND state IN ('AUTHORIZED', 'STARTED', 'COMPLETED')),
g AS (SELECT id, seq, state, row_number() OVER (PARTITION BY id ORDER BY seq) AS n FROM r ANTI JOIN bad USING (seq)),
m(a, b) AS (VALUES ('NEW', 'PROPOSED'), ('PROPOSED', 'AUTHORIZED'), ('PROPOSED', 'CANCELLED'), ('AUTHORIZED', 'STARTED'), ('AUTHORIZED', 'CANCELLED'), ('STARTED', 'COMPLETED'), ('STARTED', 'FAILED'), ('STARTED', 'CANCELLED')),
s AS (SELECT id, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS state, '' AS before, 'NEW' AS at, '' AS refused FROM (SELECT DISTINCT id FROM g)
  UNION ALL SELECT g.id, g.n, g.seq, g.state, s.at, CASE WHEN m.a IS NULL THEN s.at ELSE g.state END, CASE WHEN m.a IS NULL THEN 'forbidden ' || s.at || ' > ' || g.state ELSE '' END
  FROM s JOIN g ON g.id = s.id AND g.n = s.n + 1 LEFT JOIN m ON m.a = s.at AND m.b = g.state)
SELECT id, seq, state, before, nullif(refused, '') AS refused FROM s WHERE n > 0 UNION ALL SELECT id, seq, state, NULL, 'no authorization' FROM bad"""


@query("lifecycle_records", LIFE)
def lifecycle_records(spark, d):
    """Every record with its state before and why it was refused, as a batch."""
    return lifecycles.batch(_records(w.table(spark, d, "events"))).select("id", "seq", "state", "before", "refused")


@query("lifecycle_stream", LIFE)
def lifecycle_stream(spark, d):
    """The same as a stream over the table's files, with keyed state."""
    spot = new_folder(spark)
    schema = w.table(spark, d, "events").schema
    # a stream takes a single file only by a pattern
    lifecycles.run(_records(spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")), f"{spot}/out", f"{spot}/checkpoint")
    return lifecycles.told(spark, f"{spot}/out").select("id", "seq", "state", "before", "refused")

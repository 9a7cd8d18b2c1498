"""The jobs as registered queries, with SQL for their whole output."""

from __future__ import annotations

from jobs import common, readings, register
from plumbline.functions import numeric

QUERIES = {"job1_readings": readings.job1_readings, "job2_register": register.job2_register}

_config = common.defaults(readings.NAME)
_kinds = ", ".join("(" + ", ".join([f"'{k}'", *(f"{float(v[n])!r}::DOUBLE" for n in ("scale", "offset", "noise", "prior_mean", "prior_variance", "least"))]) + ")" for k, v in sorted(_config["kinds"].items()))
_c = f"{_config['confidence']!r}::DOUBLE"

JOB1_SQL = f"""
WITH k(kind, scale, shift, noise, pm, pv, least) AS (VALUES {_kinds}),
e AS (SELECT event_id AS reading, ts AS t, user_id AS asset, event_type AS kind, value FROM events),
j AS (
  SELECT e.*, scale, shift, CASE WHEN reading IS NULL THEN 'no reading id' WHEN t IS NULL THEN 'no time' WHEN asset IS NULL THEN 'no asset' WHEN k.kind IS NULL THEN 'unknown kind'
    WHEN value IS NULL THEN 'no value' WHEN isnan(value) OR isinf(value) THEN 'value not finite' END AS reason
  FROM e LEFT JOIN k ON k.kind = e.kind),
g AS (SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY reading, t) AS copies FROM j WHERE reason IS NULL WINDOW w AS (PARTITION BY reading, t ORDER BY asset, kind, value)),
kept AS (SELECT reading, asset, kind, round(scale * value + shift, 6) AS v FROM g WHERE nth = 1),
sums AS (SELECT asset, kind, count(*) AS n, sum(CAST(v AS DECIMAL(18, 6)))::DOUBLE AS s FROM kept GROUP BY asset, kind),
b AS (SELECT asset, sums.kind, n, (pm / pv + s / noise) / (1 / pv + n / noise) AS mu, sqrt(1 / (1 / pv + n / noise)) AS sd, least FROM sums JOIN k ON k.kind = sums.kind),
p AS (SELECT *, {numeric.probability_above_sql("mu", "sd", "least")} AS p FROM b),
d AS (SELECT *, CASE WHEN p >= {_c} THEN 'SATISFIED' WHEN 1 - p >= {_c} THEN 'VIOLATED' ELSE 'UNRESOLVED' END AS verdict, n >= {_config['readings_needed']} AS covered FROM p),
c AS (SELECT asset, count_if(verdict = 'VIOLATED') AS violated, count_if(verdict = 'UNRESOLVED') AS unresolved, count_if(NOT covered) AS uncovered FROM d GROUP BY asset)
SELECT 'reading' AS output, asset, kind, reading, 1::BIGINT AS n, round(v, 4) AS value, NULL::DOUBLE AS p, NULL AS said FROM kept
UNION ALL SELECT 'refusal', asset, kind, reading, 1, round(value, 4), NULL, reason FROM j WHERE reason IS NOT NULL
UNION ALL SELECT 'refusal', asset, kind, reading, copies - 1, round(value, 4), NULL, 'repeated' FROM g WHERE nth = 1 AND copies > 1
UNION ALL SELECT 'decision', asset, kind, NULL, n, round(mu, 6), round(p, 6), verdict FROM d
UNION ALL SELECT 'disposition', asset, NULL, NULL, violated + unresolved + uncovered, NULL, NULL,
  CASE WHEN violated > 0 THEN 'REJECT' WHEN unresolved > 0 OR uncovered > 0 THEN 'REQUEST_EVIDENCE' ELSE 'ACCEPT' END FROM c
"""

_up = lambda step, base, key: f"""{step} AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY h) - 1 AS pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM (SELECT DISTINCT {key}, h FROM {base})
UNION ALL SELECT {key}, pos // 2, sha256(unhex(min_by(h, pos)) || unhex(max_by(h, pos))), (any_value(n) + 1) // 2 FROM {step} WHERE n > 1 GROUP BY {key}, pos // 2)"""  # noqa: E731

JOB2_SQL = f"""
WITH RECURSIVE e AS (
  SELECT doc_id AS id, lang, coalesce(nullif(trim(regexp_replace(source, '[\\x00-\\x1F\\x7F]', ' ', 'g')), ''), 'unknown') AS source, sha256(coalesce(text, '')) AS t, length(text) AS n_chars,
    CASE WHEN doc_id IS NULL THEN 'no id' WHEN text IS NULL OR NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'no text' END AS reason
  FROM documents),
x AS (SELECT *, sha256(concat_ws('|', coalesce(id::VARCHAR, ''), coalesce(lang, ''), source, t)) AS digest FROM e),
s AS (SELECT id, min_by(lang, digest) AS lang, min_by(source, digest) AS source, min_by(n_chars, digest) AS n_chars, min(digest) AS digest, max(digest) AS most, count(*) AS n FROM x WHERE reason IS NULL GROUP BY id),
r AS (SELECT id, lang, source, n_chars, n, digest, left(digest, 2) AS bucket, digest AS h FROM s WHERE digest = most),
{_up("l1", "r", "source, bucket")},
b AS (SELECT source, bucket, h FROM l1 WHERE n = 1),
{_up("l2", "b", "source")},
o AS (SELECT source, h, '' AS whole FROM l2 WHERE n = 1),
{_up("l3", "o", "whole")}
SELECT 'register' AS output, id, source, bucket, digest, n, n_chars, lang AS said FROM r
UNION ALL SELECT 'refusals', id, source, NULL, NULL, n, NULL, 'conflict' FROM s WHERE digest < most
UNION ALL SELECT 'refusals', id, source, NULL, NULL, count(*), NULL, reason FROM x WHERE reason IS NOT NULL GROUP BY id, source, reason
UNION ALL SELECT 'roots', NULL, b.source, b.bucket, h, (SELECT count(*) FROM r WHERE r.source = b.source AND r.bucket = b.bucket), NULL, 'bucket' FROM b
UNION ALL SELECT 'roots', NULL, o.source, NULL, h, (SELECT count(*) FROM r WHERE r.source = o.source), NULL, 'source' FROM o
UNION ALL SELECT 'roots', NULL, NULL, NULL, h, (SELECT count(*) FROM r), NULL, 'all' FROM l3 WHERE n = 1
"""

ORACLE_SQL = {"job1_readings": JOB1_SQL, "job2_register": JOB2_SQL}

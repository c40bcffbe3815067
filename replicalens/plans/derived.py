"""Two replicas made by rule from the driver's tables, as SQL that Spark and DuckDB both read.

A conversation's number modulo 20 says what happened to it: 0 nothing, 1 and 2 one side lacks the last turn, 3 both went
on differently, 4 rewritten, 5 another conversation of the same name, 6 and 7 on one side only, 8 a side branch, 9 cursors
apart, 10 a bookkeeping row more, 11 a parent loop, 12 a line that can't be read, 13 a uuid with two contents, 14 a side
chain, 15 a tool result that fans out, 16 a title that the longer side lacks, 17 a cursor left behind, 18 a cursor moved
back, 19 a turn whose parent is a bookkeeping row.
"""

from __future__ import annotations

LINES = """
c AS (SELECT conv_id, turn, role, text, max(turn) OVER (PARTITION BY conv_id) AS last, conv_id % 20 AS v, CAST(conv_id AS STRING) AS sid FROM {conversations}),
b AS (SELECT 'local' AS side, * FROM c UNION ALL SELECT 'hub' AS side, * FROM c),
rows_of AS (
  SELECT side, v, conv_id, last, concat('p', CAST(conv_id % 5 AS STRING)) AS project_key, sid, CAST(turn AS INT) AS idx, NOT (v = 12 AND side = 'hub' AND turn = last) AS ok,
    CASE WHEN v = 3 AND turn = last THEN concat(sid, ':', CAST(turn AS STRING), ':', side) WHEN v = 5 AND side = 'hub' THEN concat('h', sid, ':', CAST(turn AS STRING)) ELSE concat(sid, ':', CAST(turn AS STRING)) END AS uuid,
    CASE WHEN turn = 0 THEN CASE WHEN v = 11 THEN concat(sid, ':0') END WHEN v = 8 AND turn = last THEN concat(sid, ':0') WHEN v = 19 AND turn = last THEN concat(sid, ':m')
         WHEN v = 5 AND side = 'hub' THEN concat('h', sid, ':', CAST(turn - 1 AS STRING)) ELSE concat(sid, ':', CAST(turn - 1 AS STRING)) END AS parent,
    concat('2026-01-01T00:00:', lpad(CAST(turn AS STRING), 2, '0'), '.000Z') AS ts, role AS type, CAST(NULL AS STRING) AS leaf_uuid, FALSE AS is_sidechain, FALSE AS is_tool_fanout,
    {sha}(CASE WHEN v = 4 AND side = 'hub' AND turn = last THEN concat(text, '!') ELSE text END{bits}) AS canon_hash
  FROM b WHERE NOT (v IN (1, 8, 11, 16, 17, 18, 19) AND side = 'hub' AND turn = last) AND NOT (v = 2 AND side = 'local' AND turn = last)
    AND NOT (v = 6 AND side = 'hub') AND NOT (v = 7 AND side = 'local')
  UNION ALL
  SELECT side, v, conv_id, last, concat('p', CAST(conv_id % 5 AS STRING)), sid, CASE WHEN v = 17 THEN -1 ELSE 1000 END, TRUE,
    CASE WHEN v = 13 THEN concat(sid, ':', CAST(last AS STRING)) WHEN v = 19 THEN concat(sid, ':m') WHEN v IN (14, 15) THEN concat(sid, ':x') END,
    CASE WHEN v IN (14, 15, 19) THEN concat(sid, ':0') WHEN v = 13 AND last > 0 THEN concat(sid, ':', CAST(last - 1 AS STRING)) END, CASE WHEN v IN (14, 15) THEN '2026-01-01T00:01:00.000Z' END,
    CASE WHEN v IN (10, 19) THEN 'mode' WHEN v = 16 THEN 'custom-title' WHEN v = 14 THEN 'assistant' WHEN v IN (13, 15) THEN 'user' ELSE 'last-prompt' END,
    CASE WHEN v IN (17, 18) OR (v = 9 AND side = 'hub') THEN concat(sid, ':0') WHEN v IN (0, 8, 9) THEN concat(sid, ':', CAST(last AS STRING)) END, v = 14, v = 15,
    {sha}(concat('extra', sid, CASE WHEN v = 9 THEN side ELSE '' END){bits})
  FROM b WHERE turn = 0 AND (v IN (0, 9) OR (v IN (8, 13, 14, 15, 19) AND side = 'local') OR (v IN (10, 16, 17, 18) AND side = 'hub'))),
lines AS (
  SELECT side, project_key, sid, idx, ok, CASE WHEN ok THEN uuid END AS uuid, CASE WHEN ok THEN parent END AS parent, CASE WHEN ok THEN ts END AS ts, CASE WHEN ok THEN type END AS type, is_sidechain, is_tool_fanout, leaf_uuid,
    CAST(NULL AS STRING) AS cwd, CAST(NULL AS STRING) AS session_id, CASE WHEN ok THEN canon_hash END AS canon_hash
  FROM rows_of),
presence AS (
  SELECT DISTINCT side, project_key, sid AS name, {sha}(concat(sid, CASE WHEN v IN (0, 6, 7) THEN '' ELSE side END){bits}) AS raw_sha256, conv_id % 7 <> 3 AS usable, conv_id, v FROM rows_of),
ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS STRING) AS name, concat('p', CAST(conv_id % 5 AS STRING)) AS project_key FROM c),
tombs AS (
  SELECT project_key, name AS target, CASE WHEN conv_id % 10 = 4 THEN {sha}(name{bits}) END AS base_hash, conv_id % 20 <> 19 AS valid FROM ids WHERE conv_id % 10 IN (4, 9) AND conv_id % 3 = 0),
baseline AS (
  SELECT 'hub' AS side, project_key, name FROM ids WHERE conv_id % 3 <> 0 UNION ALL SELECT 'local', project_key, name FROM ids WHERE conv_id % 4 <> 1
  UNION ALL SELECT 'local', project_key, concat('gone-', name) FROM ids WHERE project_key = 'p0'),
baselines AS (SELECT DISTINCT side, project_key FROM baseline WHERE NOT (side = 'hub' AND project_key = 'p4') AND NOT (side = 'local' AND project_key = 'p3')),
bound AS (SELECT DISTINCT project_key FROM ids WHERE project_key <> 'p2'),
covered AS (SELECT DISTINCT project_key FROM ids WHERE project_key <> 'p1')
"""

DOCS = """
d AS (SELECT doc_id, source, lang, text, concat(source, '-', lang, '-', CAST(doc_id % 40 AS STRING)) AS slug FROM {documents}),
e AS (SELECT 'local' AS side, * FROM d WHERE doc_id % 6 <> 1 UNION ALL SELECT 'hub' AS side, * FROM d WHERE doc_id % 6 <> 2),
docs AS (
  SELECT side, source AS project_key, concat('d', CAST(doc_id AS STRING), '.md') AS filename, CASE WHEN doc_id % 31 = 5 AND side = 'hub' THEN 'zero_byte' ELSE 'ok' END AS state,
    CASE WHEN doc_id % 17 <> 3 THEN slug END AS name, text AS description,
    CASE WHEN NOT (doc_id % 31 = 5 AND side = 'hub') THEN {sha}(CASE WHEN doc_id % 9 = 4 AND side = 'hub' THEN concat(text, '!') ELSE text END{bits}) END AS content_hash, doc_id, slug
  FROM e),
mtombs AS (
  SELECT source AS project_key, concat('d', CAST(doc_id AS STRING), '.md') AS target, CASE WHEN doc_id % 2 = 0 THEN {sha}(text{bits}) END AS base_hash, slug AS identity, TRUE AS valid FROM d WHERE doc_id % 97 = 8),
mbaseline AS (
  SELECT 'hub' AS side, source AS project_key, concat('d', CAST(doc_id AS STRING), '.md') AS name FROM d WHERE doc_id % 12 = 2 UNION ALL
  SELECT 'local', source, concat('d', CAST(doc_id AS STRING), '.md') FROM d WHERE doc_id % 12 = 1),
msources AS (SELECT DISTINCT source AS project_key FROM d)
"""


def spark_sql(text: str) -> str:
    """text with its derivations, for spark.sql with the tables as arguments."""
    return text.replace("{sha}", "sha2").replace("{bits}", ", 256")


def duck_sql(text: str) -> str:
    return text.replace("{sha}", "sha256").replace("{bits}", "").replace("{conversations}", "conversations").replace("{documents}", "documents").replace("{events}", "events")


def table(spark, sf_dir: str, name: str):
    """One of the derived tables above."""
    source, text = ("conversations", LINES) if f"\n{name} AS" in LINES else ("documents", DOCS)
    return spark.sql(spark_sql(f"WITH {text} SELECT * FROM {name}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})

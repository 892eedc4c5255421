"""Queries of the training-text problems and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import load
from . import containers, conversations, mixing, overlaps, pairs, pii, shared_spans, speech

Query = Callable[[SparkSession, str], DataFrame]


def _p4(which: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: which(load(spark, d, "message_rows"))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.cross_split_pairs(load(spark, d, "instruction_pairs")).select("row_a", "row_b")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda spark, d: pairs.broken_pairs(load(spark, d, "instruction_pairs")),
        "p1_report": lambda spark, d: pairs.defect_report(load(spark, d, "instruction_pairs")),
        "p2_found": lambda spark, d: speech.speaker_turns(load(spark, d, "call_records")).select("row_id", "turn_no", "speaker"),
        "p2_turns": lambda spark, d: speech.speaker_turns(load(spark, d, "call_records")),
        "p2_report": lambda spark, d: speech.turn_report(load(spark, d, "call_records")),
        "p3_found": lambda spark, d: pii.mentions(load(spark, d, "call_records"), load(spark, d, "instruction_pairs")).select("field", "row_id", "item_pos", "start_pos", "entity"),
        "p3_redacted": lambda spark, d: pii.redacted(load(spark, d, "call_records"), load(spark, d, "instruction_pairs")),
        "p4_found": _p4(conversations.dropped),
        "p4_conversations": _p4(conversations.rebuild_conversations),
        "p5_found": _p5_found,
        "p7_containers": lambda spark, d: containers.fill_containers(load(spark, d, "documents"), load(spark, d, "container_specs")),
        "p7_summary": lambda spark, d: containers.fill_summary(load(spark, d, "documents"), load(spark, d, "container_specs")),
        "p7_report": lambda spark, d: containers.fill_report(load(spark, d, "documents"), load(spark, d, "container_specs")),
        "p8_mix": lambda spark, d: mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[0],
        "p8_report": lambda spark, d: mixing.mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))[1],
        "p9_found": lambda spark, d: shared_spans.found(load(spark, d, "documents")),
        "p9_passages": lambda spark, d: shared_spans.shared_passages(load(spark, d, "documents")),
        "p9_report": lambda spark, d: shared_spans.shared_report(load(spark, d, "documents")),
        "p5_report": lambda spark, d: overlaps.overlap_report(load(spark, d, "instruction_pairs")),
    }


_WS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(8199)||chr(8239)||chr(12288)"

_MESSAGES = f"""
WITH m AS (
  SELECT message_id, conversation_id, trim(text, {_WS}) AS text,
         CASE WHEN lower(trim(speaker)) IN ('customer','caller','client','user','member') THEN 'caller'
              WHEN lower(trim(speaker)) IN ('agent','advisor','rep','operator','bot') THEN 'agent'
              WHEN lower(trim(speaker)) = 'ivr' THEN 'ivr' END AS role,
         CASE WHEN regexp_full_match(trim(start_ms, {_WS}), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') AND try_cast(trim(start_ms, {_WS}) AS DOUBLE) >= 0
              THEN try_cast(trim(start_ms, {_WS}) AS DOUBLE) END AS start
  FROM message_rows WHERE conversation_id IS NOT NULL),
said AS (SELECT * FROM m WHERE text IS NOT NULL AND text <> ''),
ties AS (SELECT DISTINCT conversation_id FROM said WHERE start IS NOT NULL AND role IN ('caller','agent') GROUP BY conversation_id, start HAVING count(DISTINCT role) = 2),
c AS (
  SELECT a.conversation_id,
         count(s.conversation_id) FILTER (s.role IS NULL OR s.role <> 'ivr') AS spoken,
         count(s.conversation_id) FILTER (s.role IS NULL OR s.start IS NULL) AS bad,
         count(DISTINCT s.role) FILTER (s.role IN ('caller','agent')) AS sides
  FROM (SELECT DISTINCT conversation_id FROM m) a LEFT JOIN said s USING (conversation_id) GROUP BY 1),
v AS (
  SELECT conversation_id, CASE WHEN spoken = 0 THEN 'empty'
    WHEN bad > 0 OR conversation_id IN (SELECT conversation_id FROM ties) THEN 'broken'
    WHEN sides < 2 THEN 'no_reply' END AS defect FROM c)
"""


def oracle_sql() -> dict[str, str]:
    return {
        # every window of 200 characters by its hash
        "p9_found": """
WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 198), lambda i: hash(substr(text, i, 200)))) AS h FROM documents WHERE length(text) >= 200)
SELECT DISTINCT doc_id FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1)""",
        "p4_found": _MESSAGES + "SELECT conversation_id, defect FROM v WHERE defect IS NOT NULL",
        "p4_conversations": _MESSAGES + """
SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY start, role <> 'ivr', text, message_id) - 1 AS position,
       role, text, start AS start_ms, message_id, deliveries
FROM (SELECT conversation_id, role, text, start, min(message_id) AS message_id, count(*) AS deliveries
      FROM said JOIN v USING (conversation_id) WHERE defect IS NULL GROUP BY 1, 2, 3, 4)""",
    }

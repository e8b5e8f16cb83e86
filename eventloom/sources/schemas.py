"""The data model: many graphs at once as long tables keyed by ``graph_id``.

``node_ord`` and ``edge_ord`` keep the order of first appearance, on which results depend.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _ddl(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


ARGUMENTS = "ARRAY<STRUCT<role: STRING, value: STRING>>"
DOCUMENT_DDL = "doc_id STRING, title STRING, text STRING, source STRING, publish_time STRING, metadata MAP<STRING, STRING>"
EVENT_DDL = f"event_id STRING, doc_id STRING, event_type STRING, trigger STRING, mention STRING, arguments {ARGUMENTS}, time STRING, location STRING, char_offset ARRAY<INT>, confidence DOUBLE"
RELATION_DDL = "relation_id STRING, cause_event_id STRING, effect_event_id STRING, relation_type STRING, evidence ARRAY<STRING>, confidence DOUBLE, time_lag STRING"
QUERY_DDL = "query_id STRING, question STRING, question_type STRING, seed_event_ids ARRAY<STRING>"
ANSWER_DDL = "query_id STRING, question_type STRING, answer_text STRING, evidence_chain ARRAY<STRING>, confidence DOUBLE"
NODE_DDL = f"graph_id STRING, node_ord LONG, {EVENT_DDL}"
EDGE_DDL = f"graph_id STRING, edge_ord LONG, {RELATION_DDL}"
NEWS_DDL = f"news_id STRING, domain STRING, date STRING, title STRING, source_url STRING, events ARRAY<STRUCT<{EVENT_DDL}>>, relations ARRAY<STRUCT<{RELATION_DDL}>>, queries ARRAY<STRUCT<{QUERY_DDL}>>"
GRAPH_DDL = f"graph_id STRING, nodes ARRAY<STRUCT<{EVENT_DDL}>>, edges ARRAY<STRUCT<{RELATION_DDL}>>, metadata MAP<STRING, STRING>"
PACK_EVENT_DDL = "event_id STRING, doc_id STRING, event_type STRING, trigger_word STRING, occur_time STRING, start STRING, `end` STRING, argument MAP<STRING, STRING>"
PACK_RELATION_DDL = "cause_event_id STRING, result_event_id STRING, effect_event_id STRING, causal_type STRING, relation_type STRING, confidence_level STRING, description STRING"
PACK_QUESTION_DDL = "sample_id STRING, pack_id STRING, question_type STRING, reasoning_type STRING, question STRING"
DUEE_DDL = "id STRING, text STRING, event_list ARRAY<STRUCT<event_type: STRING, trigger: STRING, trigger_start_index: INT, arguments: ARRAY<STRUCT<role: STRING, argument: STRING, argument_start_index: INT>>>>"

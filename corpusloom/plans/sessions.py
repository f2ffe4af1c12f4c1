"""Session-log and transcript queries over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions
from ..streaming import stream_fragments, stream_transcript
from .catalog import oracle, query, table, table_stream, view

_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_LINES = rf"""lines AS (SELECT run_id, line_no, {_STRIP.format(x='line')} AS s, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j
   FROM session_lines_v WHERE {_STRIP.format(x='line')} <> ''),
blocks AS (SELECT run_id, line_no, unnest(json_extract(j, '$.message.content[*]')) AS b, unnest(range(CAST(json_array_length(j->'$.message.content') AS BIGINT))) AS no
   FROM lines WHERE j->>'$.type' IN ('assistant', 'user')),
spoken AS (SELECT run_id, line_no, string_agg({_STRIP.format(x="b->>'$.text'")}, chr(10) || chr(10) ORDER BY no) AS text FROM blocks JOIN lines USING (run_id, line_no)
   WHERE j->>'$.type' = 'assistant' AND b->>'$.type' = 'text' AND {_STRIP.format(x="b->>'$.text'")} <> '' GROUP BY run_id, line_no),
tools AS (SELECT run_id, line_no, CAST(row_number() OVER (PARTITION BY run_id, line_no ORDER BY no) - 1 AS INTEGER) AS block_no, b FROM blocks JOIN lines USING (run_id, line_no)
   WHERE j->>'$.type' = 'user' AND b->>'$.type' = 'tool_result'),
used AS (SELECT DISTINCT run_id, line_no FROM blocks WHERE b->>'$.type' = 'tool_use')"""


_SHOWN = rf"""shown AS (SELECT run_id, line_no, string_agg(concat_ws(chr(31), b->>'$.type', CASE WHEN b->>'$.type' = 'text' THEN {_STRIP.format(x="b->>'$.text'")} ELSE '' END,
    coalesce(b->>'$.name', ''), coalesce(b->>'$.id', ''), coalesce(CAST(b->'$.input' AS VARCHAR), '')), chr(30) ORDER BY no) AS blocks
   FROM blocks JOIN lines USING (run_id, line_no) WHERE j->>'$.type' = 'assistant'
     AND (b->>'$.type' = 'tool_use' OR (b->>'$.type' = 'text' AND {_STRIP.format(x="b->>'$.text'")} <> '')) GROUP BY run_id, line_no)"""
_USAGE = "json_object(" + ", ".join(f"'{k}', j->'$.{k}'" for k in sessions.RESULT_KEYS) + ")"


@query("session_events", oracle(f"""SELECT run_id, line_no, 0 AS block_no, 'raw_line' AS event_type, left(s, 500) AS text, NULL AS tool_use_id, NULL AS blocks, NULL AS payload FROM lines WHERE j IS NULL
  UNION ALL SELECT run_id, line_no, 0, 'assistant_message', coalesce(text, ''), NULL, blocks, NULL FROM shown JOIN lines USING (run_id, line_no) LEFT JOIN spoken USING (run_id, line_no)
  UNION ALL SELECT run_id, line_no, block_no, 'tool_result', left(b->>'$.content', 2000), b->>'$.tool_use_id', NULL, NULL FROM tools
  UNION ALL SELECT run_id, line_no, 0, 'result', j->>'$.subtype', NULL, NULL, CAST({_USAGE} AS VARCHAR) FROM lines WHERE j->>'$.type' = 'result'
  UNION ALL SELECT run_id, line_no, 0, 'system', j->>'$.subtype', NULL, NULL, j->>'$.message' FROM lines WHERE j->>'$.type' = 'system'
  UNION ALL SELECT run_id, line_no, 0, 'claude_error', NULL, NULL, NULL, CAST(json_object('code', j->'$.code', 'type', j->'$.type') AS VARCHAR) FROM lines WHERE j->>'$.type' = 'error'
  UNION ALL SELECT run_id, line_no, 0, 'message', j->>'$.type', NULL, NULL, NULL FROM lines WHERE j->>'$.type' NOT IN ('assistant', 'user', 'result', 'system', 'error')""",
                                "session_lines_v", extra=f"{_LINES}, {_SHOWN}"))
def session_events(spark, sf):
    events = sessions.normalise_session(view(spark, sf, "session_lines_v"))
    shown = F.array_join(F.transform("blocks", lambda b: F.concat_ws("\x1f", *[F.coalesce(b[c], F.lit("")) for c in ("type", "text", "name", "id", "input")])), "\x1e")
    return events.select("run_id", "line_no", "block_no", "event_type", "text", "tool_use_id", shown.alias("blocks"), "payload")


@query("session_text", oracle("SELECT run_id, line_no, 0 AS block_no, text FROM spoken", "session_lines_v", extra=_LINES))
def session_text(spark, sf):
    return sessions.session_fragments(sessions.normalise_session(view(spark, sf, "session_lines_v")))


_FRAGMENTS = rf"""fragments AS (SELECT conv_id AS run_id, turn AS seq, CASE WHEN role = 'assistant' THEN {_STRIP.format(x='text')} ELSE '' END AS t FROM conversations),
whole AS (SELECT run_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY seq) FILTER (t <> ''), '(empty)') AS transcript FROM fragments GROUP BY run_id)"""


def _fragments(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", F.col("text")).alias("spoken"))


@query("transcripts", oracle("SELECT run_id, transcript FROM whole", extra=_FRAGMENTS))
def transcripts(spark, sf):
    return sessions.assemble_transcript(_fragments(spark, sf), "conv_id", "turn", "spoken")


@query("transcript_summary", oracle("SELECT run_id, left(transcript, 280) AS summary FROM whole", extra=_FRAGMENTS))
def transcript_summary(spark, sf):
    return sessions.transcript_summary(_fragments(spark, sf), "conv_id", "turn", "spoken")


@query("stream_transcript", oracle("SELECT run_id, transcript FROM whole", extra=_FRAGMENTS))
def stream_text(spark, sf):
    stream = table_stream(spark, sf, "conversations")
    return stream_transcript(stream_fragments(stream, "conv_id", "turn", "text", "role = 'assistant'"))

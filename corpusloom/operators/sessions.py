"""Session logs: JSON lines to typed events, transcripts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import RAW_LINE_CHARS, SUMMARY_CHARS, TOOL_RESULT_CHARS
from ..functions.text import parse_json, strip
from .compute import once
from .ordering import top_k_per_group

EVENT_FIELDS = ("block_no", "event_type", "text", "tool_use_id", "blocks", "payload")
_BLOCKS = "array<struct<type:string,text:string,name:string,id:string,input:string>>"

# Sequence numbers whose fragments are joined in one step.
PIECE_ROWS = 2_000

# Keys kept from a result line.
RESULT_KEYS = ("duration_ms", "duration_api_ms", "num_turns", "total_cost_usd", "usage", "subtype")


def _get(v: Column, path: str, as_type: str = "string") -> Column:
    return F.try_variant_get(v, path, as_type)


def _event(event_type: str | Column, block_no: Column | None = None, text: Column | None = None,
           tool_use_id: Column | None = None, blocks: Column | None = None, payload: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        (F.lit(0) if block_no is None else block_no).cast("int").alias("block_no"),
        (F.lit(event_type) if isinstance(event_type, str) else event_type).alias("event_type"),
        (none if text is None else text).alias("text"),
        (none if tool_use_id is None else tool_use_id).alias("tool_use_id"),
        (F.lit(None).cast(_BLOCKS) if blocks is None else blocks).alias("blocks"),
        (none if payload is None else payload).alias("payload"))


def normalise_session(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed events of a session log, several per line where a line holds several tool results.

    Blank lines vanish, unreadable ones become `raw_line`. Stateless: the same call serves streams.
    """
    keep = [c for c in lines.columns if c != line]
    text = once(once(lines, _s=strip(F.col(line))).where(F.col("_s") != ""), _v=parse_json("_s"))
    v = F.col("_v")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))
    kind = _get(v, "$.type")
    content = F.coalesce(_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))

    def block(b: Column) -> Column:
        is_text = _get(b, "$.type") == "text"
        return F.struct(_get(b, "$.type").alias("type"),
                        F.when(is_text, strip(F.coalesce(_get(b, "$.text"), F.lit("")))).alias("text"),
                        F.when(~is_text, _get(b, "$.name")).alias("name"), F.when(~is_text, _get(b, "$.id")).alias("id"),
                        F.when(~is_text, _get(b, "$.input")).alias("input"))

    blocks = F.filter(F.transform(content, block),
                      lambda b: ((b["type"] == "text") & (b["text"] != "")) | (b["type"] == "tool_use"))
    spoken = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n\n")
    tool_results = F.filter(content, lambda b: _get(b, "$.type") == "tool_result")
    # numbers and objects keep their type
    usage = F.to_json(F.struct(*[_get(v, f"$.{k}", "variant").alias(k) for k in RESULT_KEYS]), {"ignoreNullFields": "false"})
    events = (
        F.when(~is_object, F.array(_event("raw_line", text=F.left("_s", F.lit(RAW_LINE_CHARS)))))
        .when(kind == "assistant",
              F.when(F.size(blocks) > 0, F.array(_event("assistant_message", text=spoken, blocks=blocks)))
              .otherwise(F.array().cast(f"array<struct<block_no:int,event_type:string,text:string,tool_use_id:string,blocks:{_BLOCKS},payload:string>>")))
        .when(kind == "user", F.transform(tool_results, lambda b, i: _event(
            "tool_result", block_no=i, text=F.left(F.coalesce(_get(b, "$.content"), F.lit("")), F.lit(TOOL_RESULT_CHARS)),
            tool_use_id=_get(b, "$.tool_use_id"))))
        .when(kind == "result", F.array(_event("result", text=_get(v, "$.subtype"), payload=usage)))
        .when(kind == "system", F.array(_event("system", text=_get(v, "$.subtype"), payload=_get(v, "$.message"))))
        .when(kind == "error", F.array(_event("claude_error", payload=F.to_json(v))))
        .otherwise(F.array(_event("message", text=kind))))
    return once(text, _events=events).select(*keep, F.inline("_events"))


def session_fragments(events: DataFrame) -> DataFrame:
    """The spoken text of each assistant event, one row per event that has any."""
    keep = [c for c in events.columns if c not in EVENT_FIELDS]
    return events.where((F.col("event_type") == "assistant_message") & (F.col("text") != "")).select(*keep, "block_no", "text")


def assemble_transcript(fragments: DataFrame, run: str, seq: str, text: str, piece: int = PIECE_ROWS) -> DataFrame:
    """Non-blank trimmed texts of a run in order, joined by a blank line: (run_id, transcript), `(empty)` for a run
    without text. `seq` is unique in a run.

    Pieces of `piece` sequence numbers are joined first, in any task, then the pieces of a run.
    """
    trimmed = once(fragments.select(F.col(run).alias("run_id"), F.col(seq).alias("_seq"), F.col(text).alias("_text")),
                   _t=strip(F.coalesce("_text", F.lit("")))).drop("_text")
    spoken = F.collect_list(F.when(F.col("_t") != "", F.struct("_seq", "_t")))
    pieces = (trimmed.groupBy("run_id", F.floor(F.col("_seq") / piece).alias("_piece")).agg(F.array_sort(spoken).alias("_a"))
              .select("run_id", "_piece", F.when(F.size("_a") > 0, F.array_join(F.transform("_a", lambda x: x["_t"]), "\n\n")).alias("_t")))
    whole = pieces.groupBy("run_id").agg(F.array_sort(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("_piece", "_t")))).alias("_a"))
    return whole.select("run_id", F.when(F.size("_a") == 0, "(empty)").otherwise(F.array_join(F.transform("_a", lambda x: x["_t"]), "\n\n")).alias("transcript"))


def transcript_summary(fragments: DataFrame, run: str, seq: str, text: str, chars: int = SUMMARY_CHARS) -> DataFrame:
    """First `chars` characters of each transcript. Every fragment adds at least one character and a
    two-character break, so the first (chars + 2) / 3 fragments are enough whatever the run's length."""
    enough = (chars + 2 + 2) // 3
    trimmed = fragments.select(F.col(run).alias("run_id"), F.col(seq).alias("_seq"),
                               F.left(strip(F.coalesce(F.col(text), F.lit(""))), F.lit(chars)).alias("_t"))
    ordered = trimmed.withColumn("_blank", F.col("_t") == "")
    first = top_k_per_group(ordered, ["run_id"], ["_blank", "_seq"], enough)
    joined = first.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(~F.col("_blank"), F.struct("_seq", "_t")))).alias("_a"))
    whole = F.left(F.array_join(F.transform("_a", lambda x: x["_t"]), "\n\n"), F.lit(chars))
    return joined.select("run_id", F.when(F.size("_a") == 0, "(empty)").otherwise(whole).alias("summary"))

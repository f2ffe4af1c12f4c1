"""The log, its runs, transcripts and records as tables that a stream keeps up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import live, stream_events
from .catalog import mapped, oracle, query, table, table_stream, view
from .ledger import _status_sql
from .records import _oracle

FILES = 4  # that a table is cut into, one to a micro-batch
DELAY_S = 3_600


def in_batches(spark: SparkSession, df: DataFrame, order: str) -> DataFrame:
    """`df` as a stream of several micro-batches, ranges of `order`."""
    path = scratch_path(spark, "in-batches")
    df.repartitionByRange(FILES, order).write.parquet(path)
    return stream_events(spark, path, df.schema, files_per_batch=1)


@query("stream_log", "SELECT user_id AS run_id, event_id AS seq, event_type, ts, value FROM events")
def stream_log(spark, sf):
    # every event is delivered up to three times, some a day after
    events = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "ts", "value",
                                               F.explode(F.sequence(F.lit(0), F.col("event_id") % 3)).alias("attempt"))
    sent = F.col("ts") + F.make_dt_interval(days=F.when(F.col("seq") % 7 == 0, F.col("attempt")).otherwise(F.lit(0)).cast("int"))
    path = scratch_path(spark, "log")
    live.append_log(in_batches(spark, events.withColumn("sent", sent), "sent").drop("sent", "attempt"), path, ["run_id", "seq"], "ts", DELAY_S)
    return live.read_log(spark, path, ["run_id", "seq"])


@query("stream_status_open", oracle(_status_sql("event_id"), "raw_events_v", extra="log AS (SELECT * FROM raw_events_v)"))
def stream_status_open(spark, sf):
    log = mapped(spark, "raw_events_v", events=in_batches(spark, table(spark, sf, "events"), "ts")).withColumnRenamed("event_id", "seq")
    path = scratch_path(spark, "status")
    live.keep_status(log.select("run_id", "seq", "event_type", "ts"), path, DELAY_S)
    return live.read_status(spark, path)


_SPELLS = """alive AS (SELECT run_id, ts, event_type, ts - lag(ts) OVER (PARTITION BY run_id ORDER BY ts) > INTERVAL 90 SECOND AS apart FROM raw_events_v
   WHERE event_type IN ('heartbeat', 'starting', 'dispatched', 'quota_hit', 'result', 'cancel', 'timeout', 'dispatch_error')),
numbered AS (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS spell FROM alive),
spells AS (SELECT run_id, max(ts) AS last_seen, count(*) AS events_n, bool_or(event_type IN ('result', 'cancel', 'timeout', 'dispatch_error')) AS ended
   FROM numbered GROUP BY run_id, spell)"""


@query("stream_stale", oracle("""SELECT run_id, last_seen, last_seen + INTERVAL 90 SECOND AS due_at, events_n FROM spells
  WHERE NOT ended AND last_seen + INTERVAL 90 SECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM alive)""", "raw_events_v", extra=_SPELLS))
def stream_stale(spark, sf):
    # the last spells of the log are open: nothing later says that they are over
    events = table_stream(spark, sf, "events")
    log = mapped(spark, "raw_events_v", events=events).withColumn("at", F.col("ts").cast("timestamp"))
    found = live.stream_stale(log, "at", delay="0 seconds")
    return found.select("run_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "due_at")], "events_n")


@query("stream_transcript_live", oracle("SELECT run_id, transcript FROM whole", extra=r"""fragments AS (SELECT conv_id AS run_id, turn AS seq,
   CASE WHEN role = 'assistant' THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS t FROM conversations),
whole AS (SELECT run_id, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY seq) FILTER (t <> ''), '(empty)') AS transcript FROM fragments GROUP BY run_id)"""))
def stream_transcript_live(spark, sf):
    turns = in_batches(spark, table(spark, sf, "conversations"), "turn")
    path = scratch_path(spark, "live")
    live.keep_transcripts(turns.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "assistant", F.col("text")).alias("text")), path)
    return live.read_transcripts(spark, path)


@query("stream_records", _oracle("""SELECT line AS value, CASE WHEN problem IS NULL THEN id END AS id, problem FROM (SELECT line, j->>'$.service_id' AS id,
   CASE WHEN j IS NULL THEN 'bad_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_object' WHEN coalesce(j->>'$.service_id', '') = '' THEN 'no_id' END AS problem FROM parsed_a)""",
                                 "a", long=False))
def stream_records(spark, sf):
    path, lines = scratch_path(spark, "lines"), view(spark, sf, "records_a_v")
    lines.where(F.col("line").isNotNull()).select(F.col("line").alias("value")).repartition(FILES, "value").write.text(path)
    out = scratch_path(spark, "records")
    live.keep_records(spark.readStream.option("maxFilesPerTrigger", 1).text(path), out)
    none = F.lit(None).cast("string")
    return (live.read_kept(spark, out, "good").select("value", "id", none.alias("problem"))
            .unionByName(live.read_kept(spark, out, "bad").select("value", none.alias("id"), "problem")))

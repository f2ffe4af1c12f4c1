"""Run ledger: listing, idempotent inserts, status folding, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    CLOCK_SKEW_S,
    ERROR_TAIL_CHARS,
    HEARTBEAT_STALE_S,
    JOB_STATE_MAP,
    ORPHAN_AFTER_S,
    OUTPUT_FILES,
    RUN_STATUSES,
    SCRUB_AFTER_S,
    TERMINAL_STATUSES,
)
from ..functions.text import tail
from .ordering import HOT_ROWS, first_per_key, positions, top_k

# Event types that set a status. Others, such as worker errors, leave it alone.
STATUS_EVENTS = {
    "starting": "starting",
    "dispatched": "running",
    "quota_hit": "quota_blocked",
    "result": "completed",
    "cancel": "cancelled",
    "timeout": "timed_out",
}
# Sets `failed` from any state, even a terminal one.
FORCED_FAILURE = "dispatch_error"


def _seconds_before(now: str, seconds: int) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))


def list_runs(runs: DataFrame, pipeline: object | None = None, status: str | None = None,
              limit: int = 50) -> DataFrame:
    """Newest first; the limit is kept between 1 and 200."""
    if pipeline is not None:
        runs = runs.where(F.col("pipeline_id") == pipeline)
    if status is not None:
        runs = runs.where(F.col("status") == status)
    return top_k(runs, [F.desc("created_at"), F.desc("id")], min(max(limit, 1), 200))


def next_items(runs: DataFrame, n: int = 1, status: str = "queued") -> DataFrame:
    """Oldest runs in `status`."""
    return top_k(runs.where(F.col("status") == status), ["created_at", "id"], n)


def events_of(events: DataFrame, run_id: object) -> DataFrame:
    return events.where(F.col("run_id") == run_id).orderBy("seq")


def with_pipeline(runs: DataFrame, pipelines: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Attach pipeline columns; runs without a known pipeline get the defaults."""
    side = pipelines.withColumnRenamed("id", "pipeline_id")
    joined = runs.join(side, "pipeline_id", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def dedupe_first(events: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First delivery per key wins, as an insert that ignores conflicts."""
    return first_per_key(events, keys, order)


def dedupe_idempotent(runs: DataFrame, scope: str, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First run per (scope, key); runs without a key are all kept and never shuffled together."""
    keyed = runs.where(F.col(key).isNotNull() & (F.col(key) != ""))
    free = runs.where(F.col(key).isNull() | (F.col(key) == ""))
    return first_per_key(keyed, [scope, key], order).unionByName(free)


def number_events(events: DataFrame, run: str, order: Sequence[str | Column], out: str = "seq", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sequence number per run from 1; 0 is left for the dispatch event."""
    return positions(events, order, by=[run], out=out, hot_rows=hot_rows)


def status_code(names: Mapping[str, str] = STATUS_EVENTS) -> Column:
    """Index in RUN_STATUSES of the status an event asks for, null for events that ask for none."""
    code = F.lit(None).cast("int")
    for event, status in names.items():
        code = F.when(F.col("event_type") == event, F.lit(RUN_STATUSES.index(status))).otherwise(code)
    return code


def status_aggregates(terminal: Sequence[str] = TERMINAL_STATUSES) -> list[Column]:
    """Aggregates that fold a run's events whatever order they arrive in.

    A terminal status sticks, so it is the one asked for by the earliest event asking for a terminal
    status; before that the latest request holds. Codes and numbers keep the buffers fixed-width, so the
    fold is a hash aggregate with map-side combine, in batch and as streaming state.
    """
    code, seq, ts = status_code(), F.col("seq"), F.col("ts")
    ends = code.isin(*[RUN_STATUSES.index(s) for s in terminal])
    steps = code.isNotNull() & ~ends
    blocked = F.col("event_type") == "quota_hit"
    forced = F.col("event_type") == FORCED_FAILURE
    return [
        F.count(F.lit(1)).alias("events_n"),
        F.max(F.when(forced, ts)).alias("_forced_at"),
        F.min_by(code, F.when(ends, seq)).alias("_end"),
        F.min_by(ts, F.when(ends, seq)).alias("_ended_at"),
        F.max_by(code, F.when(steps, seq)).alias("_step"),
        F.max_by(ts, F.when(blocked, seq)).alias("_blocked_at"),
        F.min(F.when(code.isin(RUN_STATUSES.index("starting"), RUN_STATUSES.index("running")), ts)).alias("started_at"),
        F.max(F.when(F.col("event_type") == "heartbeat", ts)).alias("last_heartbeat_at"),
    ]


def status_columns() -> dict[str, Column]:
    names = F.array(*[F.lit(s) for s in RUN_STATUSES])
    forced = F.col("_forced_at").isNotNull()
    code = F.coalesce("_end", "_step", F.lit(RUN_STATUSES.index("queued")))
    return {
        "status": F.when(forced, "failed").otherwise(F.get(names, code)),
        "finished_at": F.coalesce("_forced_at", "_ended_at", "_blocked_at"),
    }


def fold_status(events: DataFrame, terminal: Sequence[str] = TERMINAL_STATUSES) -> DataFrame:
    """Status, times and event count per run from its event log (run_id, seq, event_type, ts)."""
    folded = events.groupBy("run_id").agg(*status_aggregates(terminal))
    return folded.withColumns(status_columns()).select(
        "run_id", "status", "started_at", "finished_at", "last_heartbeat_at", "events_n")


def first_results(events: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per run, the first non-empty value of each column among its results, late results included."""
    results = events.where(F.col("event_type") == "result")
    return results.groupBy("run_id").agg(*[
        F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col("seq"))).alias(c)
        for c in cols])


def run_outcome(events: DataFrame) -> DataFrame:
    """cancelled, error or ok per run. A non-zero exit counts as an error only without a cancel; cancelled
    runs keep what they wrote and still report a result."""
    cancelled = F.bool_or(F.col("event_type") == "cancelled")
    failed = F.bool_or((F.col("event_type") == "exit") & (F.coalesce(F.col("exit_code"), F.lit(0)) != 0))
    broken = F.bool_or(F.col("event_type") == "error")
    flags = events.groupBy("run_id").agg(cancelled.alias("_c"), failed.alias("_f"), broken.alias("_e"))
    outcome = (F.when(F.col("_e"), "error").when(F.col("_c"), "cancelled").when(F.col("_f"), "error").otherwise("ok"))
    return flags.select("run_id", outcome.alias("outcome"), (outcome != "error").alias("reports_result"))


def error_events(events: DataFrame, stderr: str, chars: int = ERROR_TAIL_CHARS) -> DataFrame:
    """The error event of every non-zero exit of a run that was not cancelled: exit code and the end of the error
    stream. Exits are few, so they meet the cancelled runs after both are cut down."""
    exits = events.where((F.col("event_type") == "exit") & (F.coalesce("exit_code", F.lit(0)) != 0))
    cancelled = events.where(F.col("event_type") == "cancelled").select("run_id").distinct()
    return exits.join(cancelled, "run_id", "left_anti").select(
        "run_id", "event_id", "exit_code", tail(F.coalesce(stderr, F.lit("")), chars).alias("error_tail"))


# -- time rules; `now` is always a parameter -------------------------------------------------------

def skew_gate(df: DataFrame, event_ts: str, ingest_s: str | Column, allowed_s: int = CLOCK_SKEW_S) -> DataFrame:
    """Add `accepted`: the sent epoch second is an integer within `allowed_s` of the receipt, late or early."""
    sent = F.col(event_ts).cast("string").try_cast("bigint")
    received = F.col(ingest_s) if isinstance(ingest_s, str) else ingest_s
    late = F.try_subtract(received, sent)  # null where the difference is beyond a long
    return df.withColumn("accepted", F.coalesce(late.between(-allowed_s, allowed_s), F.lit(False)))


def stale_runs(runs: DataFrame, now: str, after_s: int = HEARTBEAT_STALE_S) -> DataFrame:
    """Started or running with a job, without a heartbeat newer than `after_s`."""
    old = F.col("last_heartbeat_at").isNull() | (F.col("last_heartbeat_at") < _seconds_before(now, after_s))
    return runs.where(F.col("status").isin("starting", "running") & old & F.col("job_id").isNotNull())


def reconcile(stale: DataFrame, job_states: DataFrame, now: str,
              states: Mapping[str, str] = JOB_STATE_MAP) -> DataFrame:
    """Move stale runs to the status of their job; other job states and finished runs stay as they are."""
    joined = stale.join(job_states.select("job_id", "state"), "job_id", "left")
    mapped = F.lit(None).cast("string")
    for state, status in states.items():
        mapped = F.when(F.col("state") == state, status).otherwise(mapped)
    moves = mapped.isNotNull() & ~F.col("status").isin(*TERMINAL_STATUSES)
    text = F.concat(F.lit("reconciled from job state '"), F.col("state"), F.lit("'"))
    return joined.select(
        *[c for c in stale.columns if c not in ("status", "error_text", "finished_at")],
        F.when(moves, mapped).otherwise(F.col("status")).alias("status"),
        F.when(moves, F.coalesce(F.nullif("error_text", F.lit("")), text)).otherwise(F.col("error_text")).alias("error_text"),
        F.when(moves, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("finished_at")).alias("finished_at"),
        moves.alias("moved"))


def orphan_runs(runs: DataFrame, now: str, after_s: int = ORPHAN_AFTER_S) -> DataFrame:
    """Fail runs that began starting more than `after_s` ago and never got a job; others pass unchanged."""
    orphan = F.coalesce((F.col("status") == "starting") & F.col("job_id").isNull() &
                        (F.col("started_at") < _seconds_before(now, after_s)), F.lit(False))
    text = F.lit("orphan: dispatch ended before a job was started")
    return runs.withColumns({
        "error_text": F.when(orphan, F.coalesce(F.nullif("error_text", F.lit("")), text)).otherwise(F.col("error_text")),
        "finished_at": F.when(orphan, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("finished_at")),
        "status": F.when(orphan, "failed").otherwise(F.col("status")),
        "orphan": orphan,
    })


def scrub_after(runs: DataFrame, now: str, column: str, after_s: int = SCRUB_AFTER_S) -> DataFrame:
    """Null a sensitive column on terminal runs that finished more than `after_s` ago."""
    due = F.col("status").isin(*TERMINAL_STATUSES) & (F.col("finished_at") < _seconds_before(now, after_s))
    return runs.withColumn(column, F.when(~F.coalesce(due, F.lit(False)), F.col(column)))


def artifact_key(ts: str, pipeline: str, run_id: str, fmt: str) -> Column:
    """runs/YYYY/MM/DD/<pipeline>/<run_id>/output.<ext>"""
    name = F.lit(OUTPUT_FILES["md"])
    for ext, file_name in OUTPUT_FILES.items():
        name = F.when(F.lower(fmt) == ext, file_name).otherwise(name)
    return F.concat_ws("/", F.lit("runs"), F.date_format(ts, "yyyy/MM/dd"),
                       F.coalesce(F.col(pipeline).cast("string"), F.lit("unknown")), F.col(run_id).cast("string"), name)

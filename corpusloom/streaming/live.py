"""Tables that a stream keeps up to date, a micro-batch at a time: log, run status, transcripts, records, silent runs.

Each micro-batch writes folders named by its number below a path in the shared folder and overwrites them when it is
replayed, so a batch that is done twice changes nothing. What has to be remembered between batches is a table too
and is cut down by the high-water mark, the greatest event time of the batches before: state grows with the time that
events may be late, not with the age of the stream. What comes later still is never dropped: it goes to a late table,
or into partial results that are merged on read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import HEARTBEAT_STALE_S, RUN_STATUSES, TERMINAL_STATUSES
from ..operators.ledger import FORCED_FAILURE, STATUS_EVENTS, status_code
from ..operators.ordering import first_per_key
from ..operators.records import parse_lines
from ..operators.sessions import PIECE_ROWS, assemble_transcript
from ..session import cut
from .events import append_to_files, drain

Keep = Callable[[DataFrame, int], None]


def run_batches(stream: DataFrame, keep: Keep, path: str, mode: str = "append") -> None:
    """Give every available micro-batch to `keep`; progress lies beside the tables."""
    drain(stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/progress")
          .trigger(availableNow=True).start())


def _put(df: DataFrame, path: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def _mark(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """(mark): the high-water mark after a batch, null before the first one."""
    return spark.read.parquet(f"{path}/mark/batch={batch_id}") if batch_id >= 0 else spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS mark")


def _raise_mark(batch: DataFrame, ts: str, path: str, batch_id: int) -> object:
    """Write the mark after this batch and return the one before it: one row, one value."""
    before = _mark(batch.sparkSession, path, batch_id - 1)
    now = before.unionByName(batch.agg(F.max(F.col(ts).cast("timestamp_ntz")).alias("mark"))).agg(F.max("mark").alias("mark"))
    _put(now, path, "mark", batch_id)
    return before.first()["mark"]


def _since(ts: str, mark: object, delay_s: int) -> Column:
    """Rows that are not older than `delay_s` before the mark; without a mark all."""
    if mark is None:
        return F.lit(True)
    return F.coalesce(F.col(ts).cast("timestamp_ntz") >= F.lit(mark).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(delay_s)), F.lit(False))


# -- the log: each event once ----------------------------------------------------------------------

def append_log(events: DataFrame, path: str, keys: Sequence[str], ts: str, delay_s: int) -> None:
    """Append each event once. Keys are remembered for `delay_s` of event time; an event that comes later than that is
    written to the late table as it came, whether it is new or another delivery."""
    spark = events.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch = cut(batch)
        mark = _raise_mark(batch, ts, path, batch_id)
        in_time = _since(ts, mark, delay_s)
        fresh = batch.where(in_time).dropDuplicates(list(keys))
        known = spark.read.parquet(f"{path}/recent/batch={batch_id - 1}") if batch_id else None
        _put(fresh if known is None else fresh.join(known.select(*keys), list(keys), "left_anti").select(*batch.columns), path, "log", batch_id)
        _put(batch.where(~in_time), path, "late", batch_id)
        seen = spark.read.schema(batch.schema).parquet(f"{path}/log/batch={batch_id}").select(*keys, ts)
        now = _mark(spark, path, batch_id).first()["mark"]
        _put((seen if known is None else seen.unionByName(known)).where(_since(ts, now, delay_s)), path, "recent", batch_id)

    run_batches(events, keep, path)


def read_log(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The log with the events of the late table that it lacks, each once. Late rows are few; they alone are compared."""
    log, late = (spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("log", "late"))
    return log.unionByName(late.dropDuplicates(list(keys)).join(log.select(*keys), list(keys), "left_anti").select(*log.columns))


# -- status of runs --------------------------------------------------------------------------------

def _partials(terminal: Sequence[str]) -> list[Column]:
    """Aggregates of a run's events that can be merged by `_MERGE`, whatever order events and partials come in."""
    code, seq, ts = status_code(), F.col("seq"), F.col("ts")
    ends = code.isin(*[RUN_STATUSES.index(s) for s in terminal])
    return [F.count(F.lit(1)).alias("events_n"), F.max(ts).alias("last_at"),
            F.max(F.when(F.col("event_type") == FORCED_FAILURE, ts)).alias("forced_at"),
            F.min(F.when(ends, F.struct(seq.alias("seq"), code.alias("code"), ts.alias("ts")))).alias("end"),
            F.max(F.when(code.isNotNull() & ~ends, F.struct(seq.alias("seq"), code.alias("code")))).alias("step"),
            F.max(F.when(F.col("event_type") == "quota_hit", F.struct(seq.alias("seq"), ts.alias("ts")))).alias("blocked"),
            F.min(F.when(code.isin(RUN_STATUSES.index("starting"), RUN_STATUSES.index("running")), ts)).alias("started_at"),
            F.max(F.when(F.col("event_type") == "heartbeat", ts)).alias("last_heartbeat_at")]


_MERGE = {"events_n": F.sum, "last_at": F.max, "forced_at": F.max, "end": F.min, "step": F.max, "blocked": F.max, "started_at": F.min, "last_heartbeat_at": F.max}


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("run_id").agg(*[f(c).alias(c) for c, f in _MERGE.items()])


def keep_status(events: DataFrame, path: str, delay_s: int, terminal: Sequence[str] = TERMINAL_STATUSES) -> None:
    """Fold events (run_id, seq, event_type, ts) into the status of each run. Only open runs are read again by the next
    batch: a run that ended and has been silent for `delay_s` is put aside, and events of it that come later start a
    partial of their own, merged with the first on read."""
    spark = events.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        folded = cut(batch.groupBy("run_id").agg(*_partials(terminal)))
        _raise_mark(folded, "last_at", path, batch_id)
        now = _mark(spark, path, batch_id).first()["mark"]
        if batch_id:
            folded = _merged(folded.unionByName(spark.read.parquet(f"{path}/runs/batch={batch_id - 1}").where(~F.col("closed")).drop("closed")))
        over = (F.col("end").isNotNull() | F.col("forced_at").isNotNull()) & ~_since("last_at", now, delay_s)
        _put(folded.withColumn("closed", over), path, "runs", batch_id)

    run_batches(events, keep, path)


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status of every run: those put aside by any batch, and the open ones of the last."""
    last = spark.read.parquet(f"{path}/mark").agg(F.max("batch")).scalar()
    whole = _merged(spark.read.parquet(f"{path}/runs").where(F.col("closed") | (F.col("batch") == last)))
    names = F.array(*[F.lit(s) for s in RUN_STATUSES])
    status = F.when(F.col("forced_at").isNotNull(), "failed").otherwise(F.get(names, F.coalesce("end.code", "step.code", F.lit(RUN_STATUSES.index("queued")))))
    return whole.select("run_id", status.alias("status"), "started_at", F.coalesce("forced_at", "end.ts", "blocked.ts").alias("finished_at"),
                        "last_heartbeat_at", "events_n")


# -- runs that fell silent -------------------------------------------------------------------------

def signs_of_life(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("heartbeat", *STATUS_EVENTS, FORCED_FAILURE))


def spells(events: DataFrame, ts: str, gap_s: int = HEARTBEAT_STALE_S, terminal: Sequence[str] = TERMINAL_STATUSES) -> DataFrame:
    """(run_id, last_seen, due_at, events_n) of each spell of a run's signs of life (heartbeats and requests for a status,
    never more than `gap_s` apart) that holds no end of the run: the run is stale from `due_at` on. Batch or stream."""
    ends = [e for e, status in STATUS_EVENTS.items() if status in terminal] + [FORCED_FAILURE]
    # times come from aggregates: a filter on the window's own end would be pushed below the merging of windows
    found = signs_of_life(events).groupBy("run_id", F.session_window(ts, f"{gap_s} seconds").alias("spell")).agg(
        F.count(F.lit(1)).alias("events_n"), F.bool_or(F.col("event_type").isin(*ends)).alias("_ended"), F.max(ts).alias("last_seen"))
    return found.where(~F.col("_ended")).select("run_id", "last_seen", (F.col("last_seen") + F.make_dt_interval(secs=F.lit(gap_s))).alias("due_at"), "events_n")


def stream_stale(events: DataFrame, ts: str, gap_s: int = HEARTBEAT_STALE_S, delay: str = "0 seconds", label: str = "stale") -> DataFrame:
    """Stale runs as they become so: a spell is written once the watermark, which signs of life move on, has reached its
    end, and its state is dropped then. A sign of life that comes more than `delay` late cannot call a run back; it is still in the log."""
    return append_to_files(spells(signs_of_life(events).withWatermark(ts, delay), ts, gap_s), label)


# -- transcripts -----------------------------------------------------------------------------------

def keep_transcripts(fragments: DataFrame, path: str, piece: int = PIECE_ROWS) -> None:
    """Keep (run_id, seq, text) fragments by (run, piece of `piece` sequence numbers); a batch writes only the pieces that
    it changes, in whole, so text is there while the stream runs and a long run costs its last piece."""
    pieces = fragments.groupBy("run_id", F.floor(F.col("seq") / piece).alias("piece")).agg(F.collect_list(F.struct("seq", "text")).alias("parts"))
    run_batches(pieces, lambda batch, batch_id: _put(batch, path, "pieces", batch_id), path, "update")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, transcript) of everything that has come so far."""
    newest = first_per_key(spark.read.parquet(f"{path}/pieces"), ["run_id", "piece"], [F.desc("batch")])
    return assemble_transcript(newest.select("run_id", F.inline("parts")), "run_id", "seq", "text")


# -- records ---------------------------------------------------------------------------------------

def keep_records(lines: DataFrame, path: str, line: str = "value") -> None:
    """Usable record lines with their id to `good`, the others with the reason to `bad`; blank lines vanish."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        parsed = cut(parse_lines(batch, line).drop("record"))
        _put(parsed.where(F.col("problem").isNull()).drop("problem"), path, "good", batch_id)
        _put(parsed.where(F.col("problem").isNotNull()).drop("id"), path, "bad", batch_id)

    run_batches(lines, keep, path)


def read_kept(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}").drop("batch")

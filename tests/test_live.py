"""Tables kept by a stream: state that shrinks, replayed batches, late events, text while the stream runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ledger, records
from corpusloom.operators.sessions import assemble_transcript
from corpusloom.plans import QUERIES
from corpusloom.plans.catalog import table
from corpusloom.streaming import live, stream_events

T0 = dt.datetime(2026, 5, 4)
SCHEMA = "run_id long, seq long, event_type string, ts timestamp_ntz"


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds one file, so one micro-batch, to a stream's folder at a time."""
    def add(rows, schema=SCHEMA, name="in"):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return stream_events(spark, str(tmp_path / name), schema, files_per_batch=1)
    return add


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_log_keeps_each_event_once_and_forgets_old_keys(spark, feed, tmp_path):
    path, every = str(tmp_path / "log"), []
    rnd = random.Random(2)
    for hour in range(6):
        new = [(rnd.randrange(9), 1000 * hour + k, "heartbeat", at(3600 * hour + k)) for k in range(50)]
        again = rnd.sample(every, min(len(every), 20))  # also some from hours ago, beyond what is remembered
        late = [(77, 1000 * hour + 900, "error", at(3600 * hour - 9000))]
        live.append_log(feed(new + new[:9] + again + late), path, ["run_id", "seq"], "ts", 1800)
        every += new + late
        state = spark.read.parquet(f"{path}/recent/batch={hour}")
        assert state.count() <= 60  # not the whole log
    assert rows_of(live.read_log(spark, path, ["run_id", "seq"])) == rows_of(spark.createDataFrame(every, SCHEMA))
    log = spark.read.parquet(f"{path}/log")
    assert log.count() == log.select("run_id", "seq").distinct().count()


def test_status_state_shrinks_and_nothing_is_lost(spark, feed, tmp_path):
    path, every = str(tmp_path / "status"), []
    for day in range(5):
        start = 86_400 * day
        new = []
        for run in range(100 * day, 100 * day + 40):
            new += [(run, 1, "starting", at(start)), (run, 2, "heartbeat", at(start + 60)), (run, 3, "result" if run % 2 else "cancel", at(start + 100))]
        new += [(100 * day + 50, 1, "dispatched", at(start))]  # never ends
        if day:  # long after their run was put aside
            new += [(100 * (day - 1) + 1, 9, "dispatch_error", at(start - 80_000)), (100 * (day - 1) + 2, 0, "timeout", at(start - 86_400 + 5))]
        every += new
        live.keep_status(feed(new), path, 3600)
        runs = spark.read.parquet(f"{path}/runs/batch={day}")
        assert runs.where("not closed").count() <= 41 + 50
    runs = spark.read.parquet(f"{path}/runs/batch=4")
    assert runs.where("not closed").count() <= 41 + 5 + 2
    expected = ledger.fold_status(spark.createDataFrame(every, SCHEMA))
    assert rows_of(live.read_status(spark, path)) == rows_of(expected)


def test_stale_runs_of_a_stream_are_those_of_the_batch(spark, feed, tmp_path):
    rows = [(1, k, "heartbeat", at(60 * k)) for k in range(5)]  # silent from 240 on
    rows += [(2, 1, "starting", at(0)), (2, 2, "result", at(80))]  # ended
    rows += [(3, k, "heartbeat", at(90 * k)) for k in range(30)]  # alive to the end
    rows += [(4, 1, "dispatched", at(10)), (4, 2, "heartbeat", at(101)), (4, 3, "assistant_message", at(190))]  # 91 s apart: silent twice
    rows.sort(key=lambda r: r[3])
    for k in range(4):
        feed(rows[k * 10:(k + 1) * 10] if k < 3 else rows[30:])
    stream = stream_events(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1).withColumn("at", F.col("ts").cast("timestamp"))
    found = live.stream_stale(stream, "at", delay="60 seconds")
    seconds = lambda df: {(r.run_id, int((r.last_seen - T0).total_seconds()), r.events_n) for r in df.select("run_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "events_n").collect()}
    assert seconds(found) == {(1, 240, 5), (4, 10, 1), (4, 101, 1)}
    batch = live.spells(spark.createDataFrame(rows, SCHEMA).withColumn("at", F.col("ts").cast("timestamp")), "at")
    assert seconds(batch.where(F.col("due_at") <= F.lit(at(90 * 29 - 60)).cast("timestamp"))) == seconds(found)
    # the batch rule at the time of the last sign of life names the same runs
    ledgered = spark.createDataFrame([(r, "running", "j", at(s), None) for r, s in ((1, 240), (3, 90 * 29), (4, 101))], "id long, status string, job_id string, last_heartbeat_at timestamp_ntz, x string")
    assert {r.id for r in ledger.stale_runs(ledgered, str(at(90 * 29))).collect()} == {1, 4}


def test_transcript_is_there_after_each_batch(spark, feed, tmp_path):
    schema, path, every = "run_id long, seq long, text string", str(tmp_path / "t"), []
    for batch in ([(1, 1, "one"), (2, 1, " "), (1, 5, "five")], [(1, 3, " three "), (3, 1, None)], [(1, 2, "two"), (2, 9, "nine")]):
        every += batch
        live.keep_transcripts(feed(batch, schema), path, piece=2)
        expected = assemble_transcript(spark.createDataFrame(every, schema), "run_id", "seq", "text")
        assert rows_of(live.read_transcripts(spark, path)) == rows_of(expected)


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    lines = ['{"service_id":"a"}', "{bad", "  ", "[1]", '{"service_id":""}', '{"service_id":"a"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "lines"))
    kept, path = [], str(tmp_path / "out")
    original = live.run_batches
    try:
        live.run_batches = lambda stream, keep, path, mode="append": original(stream, lambda b, i: (keep(b, i), kept.append(rows_of(live.read_kept(spark, path, "good"))), keep(b, i)), path, mode)
        live.keep_records(spark.readStream.text(str(tmp_path / "lines")), path)
    finally:
        live.run_batches = original
    good, bad = (live.read_kept(spark, path, n) for n in ("good", "bad"))
    assert kept[-1] == rows_of(good) and good.count() == 2
    parsed = records.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), "value")
    assert rows_of(bad.select("value", "problem")) == rows_of(records.quarantine(parsed).select("value", "problem"))


@pytest.mark.parametrize("name", ["stream_transcript", "stream_dedupe", "stream_status", "stream_stale"])
def test_streams_read_tables_of_several_files(spark, sf, tmp_path, name):
    for t in ("conversations", "events"):
        table(spark, sf, t).repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    whole = sorted(map(repr, QUERIES[name](spark, sf).collect()))
    assert whole and sorted(map(repr, QUERIES[name](spark, str(tmp_path)).collect())) == whole

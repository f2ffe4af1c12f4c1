"""Status folding against a step-by-step simulation, stream against batch, time rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.fixed_values import TERMINAL_STATUSES
from corpusloom.operators import backlog, ledger
from corpusloom.streaming import append_to_files, latest_status, stream_dedupe, stream_events, stream_status

T0 = dt.datetime(2026, 5, 4)
SCHEMA = "run_id long, seq long, event_type string, ts timestamp_ntz"


def simulate(events, terminal=TERMINAL_STATUSES):
    status, finished = "queued", None
    for _, _, kind, ts in events:
        if kind == "dispatch_error":
            status, finished = "failed", ts
        elif kind in ledger.STATUS_EVENTS and status not in terminal:
            status = ledger.STATUS_EVENTS[kind]
            if status in TERMINAL_STATUSES or status == "quota_blocked":
                finished = ts
    return status, finished


@pytest.fixture(scope="module")
def log():
    rnd = random.Random(3)
    kinds = [*ledger.STATUS_EVENTS, "dispatch_error", "heartbeat", "assistant_message", "error", "quota_hit", "starting"]
    rows = []
    for run in range(300):
        for seq in range(rnd.randint(1, 8)):
            rows.append((run, seq, rnd.choice(kinds), T0 + dt.timedelta(seconds=run * 100 + seq)))
    rows += [(999, i, "heartbeat", T0 + dt.timedelta(seconds=i)) for i in range(1500)]  # one hot run
    return rows


@pytest.mark.parametrize("terminal", [TERMINAL_STATUSES, (*TERMINAL_STATUSES, "quota_blocked")])
def test_fold_matches_simulation(spark, log, terminal):
    shuffled = random.Random(1).sample(log, len(log))
    got = {r.run_id: (r.status, r.finished_at) for r in ledger.fold_status(spark.createDataFrame(shuffled, SCHEMA), terminal).collect()}
    runs = {}
    for e in sorted(log):
        runs.setdefault(e[0], []).append(e)
    assert got == {k: simulate(v, terminal) for k, v in runs.items()}


def test_guards(spark):
    rows = [(1, 0, "dispatched", T0), (1, 1, "quota_hit", T0), (1, 2, "result", T0), (2, 1, "cancel", T0), (2, 2, "result", T0),
            (2, 3, "quota_hit", T0), (3, 0, "cancel", T0), (3, 1, "dispatched", T0), (4, 1, "assistant_message", T0)]
    got = {r.run_id: r.status for r in ledger.fold_status(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "completed", 2: "cancelled", 3: "cancelled", 4: "queued"}


def test_first_result_fields_win(spark):
    df = spark.createDataFrame([(1, 1, "result", None, "s1"), (1, 2, "result", "u2", "s2"), (1, 3, "result", "u3", "")],
                               "run_id long, seq long, event_type string, output_uri string, summary string")
    assert ledger.first_results(df, ["output_uri", "summary"]).first()[1:] == ("u2", "s1")


def test_stream_equals_batch_over_several_batches(spark, log, tmp_path):
    path = str(tmp_path / "log")
    shuffled = spark.createDataFrame(random.Random(2).sample(log, len(log)), SCHEMA)
    shuffled.repartition(5).write.parquet(path)
    stream = stream_events(spark, path, SCHEMA, files_per_batch=1)
    batch = ledger.fold_status(shuffled)
    assert sorted(map(repr, latest_status(stream_status(stream)).collect())) == sorted(map(repr, batch.collect()))


def test_stream_dedupe_across_batches(spark, log, tmp_path):
    path = str(tmp_path / "log")
    twice = spark.createDataFrame(log + log[::2], SCHEMA)
    twice.repartition(4).write.parquet(path)
    out = append_to_files(stream_dedupe(stream_events(spark, path, SCHEMA, files_per_batch=1), ["run_id", "seq"]), "t")
    assert sorted(map(repr, out.collect())) == sorted(map(repr, spark.createDataFrame(log, SCHEMA).collect()))


def test_stream_dedupe_with_a_bound_on_lateness(spark, log, tmp_path):
    path = str(tmp_path / "log")
    spark.createDataFrame(log + log[:40], SCHEMA).coalesce(1).write.parquet(path)
    stream = stream_events(spark, path, SCHEMA).withColumn("at", F.col("ts").cast("timestamp"))
    out = append_to_files(stream_dedupe(stream, ["run_id", "seq"], "at", "1 day"), "w")
    assert out.count() == len(log)


def test_dedupe_is_idempotent(spark, log):
    df = spark.createDataFrame(log + log[::3], SCHEMA)
    once = ledger.dedupe_first(df, ["run_id", "seq"], ["ts", "event_type"])
    assert once.count() == len(log) == ledger.dedupe_first(once, ["run_id", "seq"], ["ts"]).count()


def test_limits(spark):
    runs = spark.range(500).select("id", F.lit(1).alias("pipeline_id"), F.lit("queued").alias("status"), F.lit(T0).alias("created_at"))
    assert [ledger.list_runs(runs, limit=n).count() for n in (-5, 0, 7, 9999)] == [1, 1, 7, 200]
    assert ledger.list_runs(runs, pipeline=2).count() == 0


def test_skew_gate(spark):
    df = spark.createDataFrame([("700", 1000), ("699", 1000), ("1300", 1000), ("1301", 1000), ("abc", 1000), (None, 1000), ("1.5", 1)],
                               "sent string, got long")
    assert [r.accepted for r in ledger.skew_gate(df, "sent", "got").collect()] == [True, False, True, False, False, False, False]


def test_time_rules(spark):
    rows = [(1, "running", "j", T0, None, None), (2, "running", "j", None, None, None), (3, "running", None, None, None, None),
            (4, "starting", None, None, T0, "old"), (5, "starting", "j", T0 + dt.timedelta(seconds=200), T0, None), (6, "completed", "j", None, T0, None)]
    runs = spark.createDataFrame(rows, "id int, status string, job_id string, last_heartbeat_at timestamp_ntz, started_at timestamp_ntz, error_text string")
    runs = runs.withColumn("finished_at", F.when(F.col("id") == 6, F.col("started_at"))).withColumn("secret", F.lit("k"))
    now = "2026-05-04 00:03:20"
    assert {r.id for r in ledger.stale_runs(runs, now).collect()} == {1, 2}
    orphans = {r.id: (r.status, r.error_text) for r in ledger.orphan_runs(runs, now).where("orphan").collect()}
    assert orphans == {4: ("failed", "old")}
    assert {r.id for r in ledger.scrub_after(runs, now, "secret").where("secret is null").collect()} == {6}
    states = spark.createDataFrame([("j", "canceled")], "job_id string, state string")
    moved = ledger.reconcile(ledger.stale_runs(runs, now), states, now).collect()
    assert {(r.id, r.status, r.error_text, r.moved) for r in moved} == {
        (1, "cancelled", "reconciled from job state 'canceled'", True), (2, "cancelled", "reconciled from job state 'canceled'", True)}


def test_null_keys_never_dedupe(spark):
    df = spark.createDataFrame([(1, "p", None), (2, "p", None), (3, "p", ""), (4, "p", "k"), (5, "p", "k"), (6, "q", "k")], "id int, p string, k string")
    assert {r.id for r in ledger.dedupe_idempotent(df, "p", "k", ["id"]).collect()} == {1, 2, 3, 4, 6}


def test_run_outcome(spark):
    df = spark.createDataFrame([(1, "exit", 1), (2, "exit", 1), (2, "cancelled", None), (3, "exit", 0), (4, "error", None)],
                               "run_id int, event_type string, exit_code int")
    assert {r.run_id: (r.outcome, r.reports_result) for r in ledger.run_outcome(df).collect()} == {
        1: ("error", False), 2: ("cancelled", True), 3: ("ok", True), 4: ("error", False)}


def test_backlog(spark):
    items = spark.createDataFrame([("a", "done", []), ("b", "todo", ["a"]), ("c", "todo", ["a", "b"]), ("d", "todo", []), ("e", "todo", ["gone"]),
                                   ("schema", "todo", []), ("f", "todo", None)], "id string, status string, depends_on array<string>")
    assert {r.id for r in backlog.ready_items(items, exclude=["schema"]).collect()} == {"b", "d", "f"}
    cands = spark.createDataFrame([(i, i) for i in range(10)], "id int, priority int")
    active = spark.range(3)
    assert [r.id for r in backlog.clamp_pick(cands, active, ["priority", "id"], 5).orderBy("slot").collect()] == [0, 1]
    assert backlog.clamp_pick(cands, active, ["priority"], 2).count() == 0


def test_checklists(spark):
    texts = ["- [x] a\n  - [X] b", "- [x] a\n- [ ] b", "no boxes", "", None, "x - [ ] a\n- [x] c"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = backlog.checklist_state(df, "id", "text").orderBy("id").collect()
    assert [(r.checked_n, r.open_n, r.complete) for r in got] == [
        (2, 0, True), (1, 1, False), (0, 0, False), (0, 0, False), (0, 0, False), (1, 0, True)]


def test_session_stream_equals_batch(spark, sf):
    from corpusloom.operators.sessions import normalise_session
    from corpusloom.plans.catalog import mapped, table, view
    stream = stream_events(spark, sf, table(spark, sf, "conversations").schema, pattern="conversations.parquet")
    lines = mapped(spark, "session_lines_v", conversations=stream)
    live = append_to_files(normalise_session(lines).drop("blocks"), "session")
    batch = normalise_session(view(spark, sf, "session_lines_v")).drop("blocks")
    assert batch.count() > 0 and sorted(map(repr, live.collect())) == sorted(map(repr, batch.collect()))


def test_artifacts_keep_their_keys(spark, tmp_path):
    from corpusloom.sources.tables import read_corpus, read_events, write_artifacts
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-05-04 10:00:00' ts, 'p' p, explode(array('r1', 'r2')) r, 'md' f, 'body' text")
    keyed = df.withColumn("key", ledger.artifact_key("ts", "p", "r", F.col("f")))
    write_artifacts(keyed, str(tmp_path / "runs"), "key", "text", files=1)
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "runs")).collect()]
    assert got == [(f"runs/2026/05/04/p/{r}/output.md", "body") for r in ("r1", "r2")]
    df.select("r", "text").write.parquet(str(tmp_path / "c"))
    assert read_corpus(spark, str(tmp_path / "c"), ["r", "absent"]).columns == ["r"]
    with pytest.raises(ValueError, match="run_id"):
        read_events(spark, str(tmp_path / "c"))


def test_error_events(spark):
    rows = [(1, 1, "exit", 2, "x" * 4000 + "end"), (2, 2, "exit", 0, "fine"), (3, 3, "exit", 1, "gone"), (3, 4, "cancelled", None, None), (4, 5, "exit", 9, None)]
    df = spark.createDataFrame(rows, "run_id long, event_id long, event_type string, exit_code int, err string")
    got = {r.run_id: (r.exit_code, r.error_tail) for r in ledger.error_events(df, "err").collect()}
    assert got == {1: (2, "x" * 2997 + "end"), 4: (9, "")}


def test_skew_gate_survives_extreme_timestamps(spark):
    rows = [("-9223372036854775808",), ("9223372036854775807",), ("1000",), ("1e3",), (None,)]
    df = spark.createDataFrame(rows, "sent string").withColumn("got", F.lit(1100).cast("long"))
    accepted = {r.sent: r.accepted for r in ledger.skew_gate(df, "sent", "got", 300).collect()}
    assert accepted == {"-9223372036854775808": False, "9223372036854775807": False, "1000": True, "1e3": False, None: False}

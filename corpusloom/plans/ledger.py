"""Run-ledger and URI queries, in batch and on the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.uris import normalise_uri, payload_text, redact_uri, split_s3, strip_query
from ..operators import ledger, records
from ..sources.tables import read_events, read_runs
from ..streaming import append_to_files, latest_status, stream_dedupe, stream_status
from .catalog import mapped, oracle, query, table, table_stream, view

NOW = "1998-06-01 00:01:40"
_NOW = f"TIMESTAMP '{NOW}'"


@query("list_runs", oracle("SELECT * FROM runs_v WHERE status = 'running' ORDER BY created_at DESC, id DESC LIMIT 50", "runs_v"))
def list_runs(spark, sf):
    return ledger.list_runs(view(spark, sf, "runs_v"), status="running")


@query("next_queued", oracle("SELECT * FROM runs_v WHERE status = 'queued' ORDER BY created_at, id LIMIT 5", "runs_v"))
def next_queued(spark, sf):
    return ledger.next_items(view(spark, sf, "runs_v"), 5)


@query("runs_with_pipeline", """SELECT o_orderkey AS id, o_custkey AS pipeline_id, coalesce(c_name, '') AS name, coalesce(c_mktsegment, 'none') AS segment
  FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def runs_with_pipeline(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("pipeline_id"))
    known = table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return ledger.with_pipeline(runs, known, {"name": "", "segment": "none"})


@query("dedupe_idempotent", oracle("""SELECT id, pipeline_id, idempotency_key FROM runs_v WHERE coalesce(idempotency_key, '') = ''
  UNION ALL SELECT id, pipeline_id, idempotency_key FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id, idempotency_key ORDER BY created_at, id) AS rn
    FROM runs_v WHERE idempotency_key <> '') WHERE rn = 1""", "runs_v"))
def dedupe_idempotent(spark, sf):
    kept = ledger.dedupe_idempotent(view(spark, sf, "runs_v"), "pipeline_id", "idempotency_key", ["created_at", "id"])
    return kept.select("id", "pipeline_id", "idempotency_key")


_ALL = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("dedupe_first", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_ALL)}) = 1""")
def dedupe_first(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_ALL)
    return ledger.dedupe_first(rows, ["l_orderkey", "l_linenumber"], _ALL).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query("dedupe_last", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in ['l_shipdate', 'l_linenumber', *_ALL[:-1]])}) = 1""")
def dedupe_last(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_ALL)
    return records.dedupe_last(rows, "l_orderkey", ["l_shipdate", "l_linenumber", *_ALL[:-1]]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


def numbered(spark: SparkSession, sf: str) -> DataFrame:
    """The event log with a sequence number per run."""
    return ledger.number_events(view(spark, sf, "raw_events_v"), "run_id", ["ts", "event_id"])


_NUMBERED = "log AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM raw_events_v)"


@query("number_events", oracle("SELECT run_id, seq, event_id FROM log", "raw_events_v", extra=_NUMBERED))
def number_events(spark, sf):
    return numbered(spark, sf).select("run_id", "seq", "event_id")


@query("run_events_ordered", oracle("SELECT run_id, seq, event_type, ts FROM log WHERE run_id = 24", "raw_events_v", extra=_NUMBERED))
def run_events_ordered(spark, sf):
    return ledger.events_of(numbered(spark, sf), 24).select("run_id", "seq", "event_type", "ts")


def _status_sql(seq: str) -> str:
    ends = "event_type IN ('result', 'cancel', 'timeout')"
    return f"""SELECT run_id, CASE WHEN bool_or(event_type = 'dispatch_error') THEN 'failed'
    WHEN bool_or({ends}) THEN CASE arg_min(event_type, {seq}) FILTER ({ends}) WHEN 'result' THEN 'completed' WHEN 'cancel' THEN 'cancelled' ELSE 'timed_out' END
    ELSE coalesce(CASE arg_max(event_type, {seq}) FILTER (event_type IN ('starting', 'dispatched', 'quota_hit')) WHEN 'starting' THEN 'starting'
      WHEN 'dispatched' THEN 'running' WHEN 'quota_hit' THEN 'quota_blocked' END, 'queued') END AS status,
  min(ts) FILTER (event_type IN ('starting', 'dispatched')) AS started_at,
  coalesce(max(ts) FILTER (event_type = 'dispatch_error'), arg_min(ts, {seq}) FILTER ({ends}), arg_max(ts, {seq}) FILTER (event_type = 'quota_hit')) AS finished_at,
  max(ts) FILTER (event_type = 'heartbeat') AS last_heartbeat_at, count(*) AS events_n FROM log GROUP BY run_id"""


@query("run_status", oracle(_status_sql("seq"), "raw_events_v", extra=_NUMBERED))
def run_status(spark, sf):
    return ledger.fold_status(numbered(spark, sf).select("run_id", "seq", "event_type", "ts"))


@query("first_results", oracle("SELECT run_id, arg_min(value, seq) FILTER (event_type = 'result' AND value IS NOT NULL) AS value FROM log WHERE event_type = 'result' GROUP BY run_id",
                               "raw_events_v", extra=_NUMBERED))
def first_results(spark, sf):
    return ledger.first_results(numbered(spark, sf), ["value"])


@query("run_outcome", oracle("""SELECT run_id, outcome, outcome <> 'error' AS reports_result FROM (SELECT run_id, CASE WHEN bool_or(event_type = 'error') THEN 'error'
   WHEN bool_or(event_type = 'cancelled') THEN 'cancelled' WHEN bool_or(event_type = 'exit' AND exit_code <> 0) THEN 'error' ELSE 'ok' END AS outcome
  FROM outcome_events_v GROUP BY run_id)""", "outcome_events_v"))
def run_outcome(spark, sf):
    return ledger.run_outcome(view(spark, sf, "outcome_events_v"))


@query("run_errors", oracle("""SELECT run_id, event_id, exit_code, right(coalesce(stderr, ''), 3000) AS error_tail FROM outcome_events_v e
  WHERE event_type = 'exit' AND exit_code <> 0 AND NOT EXISTS (SELECT 1 FROM outcome_events_v c WHERE c.run_id = e.run_id AND c.event_type = 'cancelled')""",
                             "outcome_events_v"))
def run_errors(spark, sf):
    return ledger.error_events(view(spark, sf, "outcome_events_v"), "stderr")


@query("events_read", "SELECT user_id AS run_id, event_id AS seq, event_type, ts FROM events")
def events_read(spark, sf):
    return read_events(spark, f"{sf}/events.parquet", {"run_id": "user_id", "seq": "event_id"})


@query("runs_read", """SELECT o_orderkey AS id, o_custkey AS pipeline_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders""")
def runs_read(spark, sf):
    return read_runs(spark, f"{sf}/orders.parquet", {"id": "o_orderkey", "pipeline_id": "o_custkey", "status": "o_orderstatus", "created_at": "o_orderdate"})


_SKEW = "CASE WHEN event_id % 29 = 0 THEN 'soon' WHEN event_id % 31 = 0 THEN NULL ELSE CAST(1704067200 + event_id * 259 + (event_id % 13 - 6) * 60 AS VARCHAR{n}) END"


@query("skew_gate", f"""SELECT event_id, coalesce(abs(1704067200 + event_id * 259 - try_cast(sent AS BIGINT)) <= 300, false) AS accepted
  FROM (SELECT event_id, {_SKEW.format(n='')} AS sent FROM events)""")
def skew_gate(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_SKEW.format(n="(20)")).alias("sent"),
                                             (F.lit(1704067200) + F.col("event_id") * 259).alias("received_s"))
    return ledger.skew_gate(rows, "sent", "received_s").select("event_id", "accepted")


_STALE = f"status IN ('starting', 'running') AND job_id IS NOT NULL AND (last_heartbeat_at IS NULL OR last_heartbeat_at < {_NOW} - INTERVAL 90 SECOND)"


@query("stale_runs", oracle(f"SELECT id, job_id, status, last_heartbeat_at FROM ledger_v WHERE {_STALE}", "ledger_v"))
def stale_runs(spark, sf):
    return ledger.stale_runs(view(spark, sf, "ledger_v"), NOW).select("id", "job_id", "status", "last_heartbeat_at")


@query("reconcile_states", oracle(f"""SELECT id, job_id, coalesce(mapped, status) AS status,
   CASE WHEN mapped IS NULL THEN error_text ELSE coalesce(nullif(error_text, ''), concat('reconciled from job state ''', state, '''')) END AS error_text,
   CASE WHEN mapped IS NULL THEN finished_at ELSE {_NOW} END AS finished_at, mapped IS NOT NULL AS moved
  FROM (SELECT l.*, state, CASE state WHEN 'succeeded' THEN 'completed' WHEN 'failed' THEN 'failed' WHEN 'canceled' THEN 'cancelled' WHEN 'internal_error' THEN 'failed' END AS mapped
    FROM ledger_v l LEFT JOIN job_states_v USING (job_id) WHERE {_STALE})""", "ledger_v", "job_states_v"))
def reconcile_states(spark, sf):
    stale = ledger.stale_runs(view(spark, sf, "ledger_v"), NOW)
    moved = ledger.reconcile(stale, view(spark, sf, "job_states_v"), NOW)
    return moved.select("id", "job_id", "status", "error_text", "finished_at", "moved")


_ORPHAN = f"(status = 'starting' AND job_id IS NULL AND started_at IS NOT NULL AND started_at < {_NOW} - INTERVAL 60 SECOND)"


@query("orphan_runs", oracle(f"""SELECT id, CASE WHEN {_ORPHAN} THEN 'failed' ELSE status END AS status,
   CASE WHEN {_ORPHAN} THEN coalesce(nullif(error_text, ''), 'orphan: dispatch ended before a job was started') ELSE error_text END AS error_text,
   CASE WHEN {_ORPHAN} THEN {_NOW} ELSE finished_at END AS finished_at FROM ledger_v""", "ledger_v"))
def orphan_runs(spark, sf):
    return ledger.orphan_runs(view(spark, sf, "ledger_v"), NOW).select("id", "status", "error_text", "finished_at")


@query("scrub_after", oracle(f"""SELECT id, CASE WHEN NOT (status IN ('completed', 'failed', 'cancelled', 'timed_out') AND finished_at IS NOT NULL
   AND finished_at < {_NOW} - INTERVAL 60 SECOND) THEN secret END AS secret FROM ledger_v""", "ledger_v"))
def scrub_after(spark, sf):
    return ledger.scrub_after(view(spark, sf, "ledger_v"), NOW, "secret").select("id", "secret")


_FORMATS = "CASE o_orderkey % 6 WHEN 0 THEN 'CSV' WHEN 1 THEN 'json' WHEN 2 THEN 'txt' WHEN 3 THEN 'pdf' WHEN 4 THEN 'md' END"


@query("artifact_keys", f"""SELECT o_orderkey, concat('runs/', strftime(o_orderdate, '%Y/%m/%d'), '/', o_custkey, '/', o_orderkey, '/',
  CASE {_FORMATS} WHEN 'CSV' THEN 'output.csv' WHEN 'json' THEN 'output.json' WHEN 'txt' THEN 'output.txt' ELSE 'output.md' END) AS key FROM orders""")
def artifact_keys(spark, sf):
    runs = table(spark, sf, "orders").withColumn("fmt", F.expr(_FORMATS))
    return runs.select("o_orderkey", ledger.artifact_key("o_orderdate", "o_custkey", "o_orderkey", "fmt").alias("key"))


# -- the log as a stream ---------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return table_stream(spark, sf, "events")


@query("stream_dedupe", "SELECT user_id AS run_id, event_id AS seq, event_type, value FROM events")
def stream_dedup(spark, sf):
    # every event is delivered up to three times
    delivered = _event_stream(spark, sf).select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "event_type", "value",
        F.explode(F.sequence(F.lit(1), F.lit(1) + F.col("event_id") % 3)).alias("attempt"))
    return append_to_files(stream_dedupe(delivered, ["run_id", "seq"]).drop("attempt"), "dedupe")


@query("stream_status", oracle(_status_sql("event_id"), "raw_events_v", extra="log AS (SELECT * FROM raw_events_v)"))
def stream_state(spark, sf):
    log = mapped(spark, "raw_events_v", events=_event_stream(spark, sf))
    return latest_status(stream_status(log.withColumnRenamed("event_id", "seq")))


# -- URIs and bundles ------------------------------------------------------------------------------

_TRIM = r"regexp_replace(uri, '^\s+|\s+$', '', 'g')"


@query("uri_validate", oracle(rf"""SELECT id, nullif({_TRIM}, '') AS uri, nullif({_TRIM}, '') IS NULL OR
   lower(regexp_extract({_TRIM}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('s3', 'https') AS valid FROM uris_v""", "uris_v"))
def uri_validate(spark, sf):
    return view(spark, sf, "uris_v").select("id", normalise_uri("uri").alias("u")).select("id", "u.uri", "u.valid")


_AUTH = r"regexp_replace(regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*:(?://([^/?#]*))?', 1), '^.*@', '')"


@query("uri_redact", oracle(rf"""SELECT id, CASE WHEN contains({_AUTH}, ':') AND NOT regexp_matches({_AUTH}, ':[0-9]{{1,5}}$') THEN '<unparseable uri>'
   WHEN NOT regexp_matches(uri, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN '<uri without scheme>'
   ELSE concat(lower(split_part(uri, ':', 1)), '://', lower({_AUTH}), regexp_extract(uri, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1)) END AS safe
  FROM uris_v""", "uris_v"))
def uri_redact(spark, sf):
    return view(spark, sf, "uris_v").select("id", redact_uri("uri").alias("safe"))


@query("uri_strip_query", oracle("SELECT id, split_part(uri, '?', 1) AS bare FROM uris_v", "uris_v"))
def uri_strip_query(spark, sf):
    return view(spark, sf, "uris_v").select("id", strip_query("uri").alias("bare"))


@query("uri_split", oracle("""SELECT id, nullif(regexp_extract(uri, '^s3://([^/]+)/(.+)$', 1), '') AS bucket, nullif(regexp_extract(uri, '^s3://([^/]+)/(.+)$', 2), '') AS key,
   regexp_matches(uri, '^s3://[^/]+/.+$') AS valid FROM uris_v""", "uris_v"))
def uri_split(spark, sf):
    return view(spark, sf, "uris_v").select("id", split_s3("uri").alias("s")).select("id", "s.bucket", "s.key", "s.valid")


_BODY = "regexp_replace(body, '^\ufeff', '')"


@query("payload_extract", oracle(f"""SELECT id, CASE WHEN NOT has THEN b WHEN good THEN j->>'$.prompt' END AS text, CASE WHEN has AND NOT good THEN '`prompt` must be a non-empty string' END AS error
  FROM (SELECT id, b, j, coalesce(json_type(j) = 'OBJECT' AND json_exists(j, '$.prompt'), false) AS has,
    coalesce(json_type(j, '$.prompt') = 'VARCHAR' AND trim(j->>'$.prompt') <> '', false) AS good
   FROM (SELECT id, {_BODY} AS b, CASE WHEN json_valid({_BODY}) THEN CAST({_BODY} AS JSON) END AS j FROM bodies_v))""", "bodies_v"))
def payload_extract(spark, sf):
    return view(spark, sf, "bodies_v").select("id", payload_text("body").alias("p")).select("id", "p.text", "p.error")

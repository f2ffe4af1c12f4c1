"""Backlog queries: orders as items, their parts as dependencies, customers as groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backlog
from .catalog import oracle, query, table, view


@query("ready_items", """SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40))""")
def ready_items(spark, sf):
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("dep"))
    done = table(spark, sf, "part").where(F.col("p_size") < 40).select(F.col("p_partkey").alias("id"))
    return backlog.ready_items(items, edges=edges, done=done, done_status="F")


@query("not_active", oracle("""SELECT id, pipeline_id FROM runs_v WHERE status = 'queued' AND pipeline_id NOT IN (
  SELECT pipeline_id FROM runs_v WHERE status = 'running' AND priority = '1-URGENT')""", "runs_v"))
def not_active(spark, sf):
    runs = view(spark, sf, "runs_v")
    busy = runs.where((F.col("status") == "running") & (F.col("priority") == "1-URGENT"))
    return backlog.not_active(runs.where(F.col("status") == "queued"), busy, "pipeline_id").select("id", "pipeline_id")


@query("clamp_pick", oracle("""SELECT id, priority, slot FROM (SELECT id, priority, row_number() OVER (ORDER BY priority, id) AS slot FROM runs_v WHERE status = 'queued')
  WHERE slot <= greatest(1500 - (SELECT count(*) FROM runs_v WHERE status = 'running' AND priority = '1-URGENT'), 0)""", "runs_v"))
def clamp_pick(spark, sf):
    runs = view(spark, sf, "runs_v")
    busy = runs.where((F.col("status") == "running") & (F.col("priority") == "1-URGENT"))
    wanted = runs.where(F.col("status") == "queued").select("id", "priority")
    return backlog.clamp_pick(wanted, busy, ["priority", "id"], cap=1500)


@query("active_counts", oracle("""SELECT c_custkey AS pipeline_id, count(id) AS active_n FROM customer LEFT JOIN runs_v ON pipeline_id = c_custkey AND status IN ('queued', 'running')
  GROUP BY c_custkey""", "runs_v"))
def active_counts(spark, sf):
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return backlog.active_counts(view(spark, sf, "runs_v"), known)


@query("checklist_state", oracle(r"""SELECT id, CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\s*- \[[xX]\]'))) AS INTEGER) AS checked_n,
   CAST(len(list_filter(l, lambda x: regexp_matches(x, '^\s*- \[ \]'))) AS INTEGER) AS open_n,
   len(list_filter(l, lambda x: regexp_matches(x, '^\s*- \[ \]'))) = 0 AND len(list_filter(l, lambda x: regexp_matches(x, '^\s*- \[[xX]\]'))) > 0 AS complete
  FROM (SELECT id, string_split(text, chr(10)) AS l FROM checklists_v)""", "checklists_v"))
def checklist_state(spark, sf):
    return backlog.checklist_state(view(spark, sf, "checklists_v"), "id", "text")


@query("all_done", oracle("""SELECT c_custkey AS pipeline_id, coalesce(bool_and(status = 'completed'), false) AS all_done FROM customer
  LEFT JOIN runs_v ON pipeline_id = c_custkey GROUP BY c_custkey""", "runs_v"))
def all_done(spark, sf):
    groups = table(spark, sf, "customer").select(F.col("c_custkey").alias("pipeline_id"))
    items = view(spark, sf, "runs_v").select("pipeline_id", (F.col("status") == "completed").alias("done"))
    return backlog.all_done(groups, items, "pipeline_id", "done")

"""Runs as files: artifacts at their keys, and record files read back with their run and line order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger
from ..session import scratch_path
from ..sources import artifacts
from ..sources.records import expected_files, read_run_lines
from .catalog import oracle, query, table, view

_KEYED = """SELECT concat('runs/', strftime(TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 400 AS INTEGER)), '%Y/%m/%d'), '/', c_nationkey, '/', c_custkey, '/',
   CASE c_custkey % 3 WHEN 0 THEN 'output.csv' WHEN 1 THEN 'output.json' ELSE 'output.md' END) AS key,
  CASE WHEN c_custkey % 11 = 0 THEN '(empty)' ELSE concat(c_name, chr(10), c_mktsegment, ' é') END AS text FROM customer"""


def written(spark: SparkSession, sf: str) -> str:
    """An artifact for each customer, written to a fresh folder."""
    runs = table(spark, sf, "customer").select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 400).cast("int"))).alias("day"), "c_nationkey", "c_custkey",
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' END").alias("fmt"),
        F.when(F.col("c_custkey") % 11 == 0, "(empty)").otherwise(F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit(" é"))).alias("text"))
    path = scratch_path(spark, "artifacts")
    artifacts.write_files(runs.withColumn("key", ledger.artifact_key("day", "c_nationkey", "c_custkey", "fmt")), path, "key", "text")
    return path


@query("artifact_files", f"SELECT key, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes FROM ({_KEYED})")
def artifact_files(spark, sf):
    return artifacts.list_files(spark, written(spark, sf)).select("key", "bytes")


@query("artifact_texts", f"SELECT key, text FROM ({_KEYED})")
def artifact_texts(spark, sf):
    return artifacts.read_files(spark, written(spark, sf))


def record_files(spark: SparkSession, sf: str) -> str:
    """The record lines of each run as JSON lines, in order of their number, in several files a run."""
    path = scratch_path(spark, "runs")
    lines = view(spark, sf, "records_a_v").where(F.col("line").isNotNull())
    for part in range(2):  # a run's files follow each other by name
        own = lines.where((F.col("line_no") % 100 >= 50) == F.lit(bool(part))).select(F.concat(F.col("run_id"), F.lit(f"/part={part}")).alias("run"), "line_no", "line")
        (own.repartition("run").sortWithinPartitions("run", "line_no").select("line", F.col("run").alias("run")).write.mode("append").partitionBy("run").text(f"{path}/{part}"))
    return path


_PLACED = "lines AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY line_no % 100 >= 50, line_no) AS line_no, line FROM records_a_v WHERE line IS NOT NULL)"


@query("run_lines", oracle("SELECT run_id, line_no, line FROM lines", "records_a_v", extra=_PLACED))
def run_lines(spark, sf):
    return read_run_lines(spark, record_files(spark, sf), r"run=([^/]+)%2F")


@query("run_files", oracle("""SELECT run_id, chunk_id, CASE WHEN files IS NULL THEN 'MISSING' ELSE 'ok' END AS status, coalesce(files, 0) AS files, coalesce(bytes, 0)::BIGINT AS bytes FROM
   (SELECT DISTINCT source AS run_id, CAST(substr(source, 4) AS INTEGER) AS chunk_id FROM documents UNION ALL SELECT 'absent', 99) LEFT JOIN
   (SELECT run_id, count(DISTINCT line_no % 100 >= 50) AS files, sum(octet_length(encode(line)) + 1) AS bytes FROM records_a_v WHERE line IS NOT NULL GROUP BY run_id) USING (run_id)""",
                           "records_a_v"))
def run_files(spark, sf):
    expected = table(spark, sf, "documents").select(F.col("source").alias("run_id"), F.substring("source", 4, 10).cast("int").alias("chunk_id")).distinct()
    absent = spark.range(1).select(F.lit("absent").alias("run_id"), F.lit(99).alias("chunk_id"))
    listing = artifacts.list_files(spark, record_files(spark, sf), "*.txt")
    return expected_files(expected.unionByName(absent), listing, r"run=([^/]+)%2F")

"""Extraction outputs: line reader, multi-run merge, first existing path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.ordering import positions
from ..operators.records import good_records, parse_lines, quarantine
from ..session import cut
from .artifacts import file_path

# Columns that order the lines of one file: split start, then place inside the task.
LINE_ORDER = ("block_start", "line_in_task")


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines with their file and an order that holds inside each file, however it was split."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
                        F.col("_metadata.file_block_start").alias("block_start"),
                        F.monotonically_increasing_id().alias("line_in_task"))


def read_records(spark: SparkSession, paths: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Usable records and the quarantined lines, both with file and line order."""
    parsed = parse_lines(read_lines(spark, paths))
    return good_records(parsed), quarantine(parsed)


def run_of(path: Column, pattern: str = r"run=([^/]+)") -> Column:
    """The run that a file's path names."""
    return F.url_decode(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")))


def read_run_lines(spark: SparkSession, path: str, pattern: str = r"run=([^/]+)") -> DataFrame:
    """(run_id, line_no, line) of the files below `path`: lines numbered from 1 in the order of their run's files, and of
    the lines in each, however files were split among tasks and however large one run is."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    placed = lines.select(run_of(file_path(), pattern).alias("run_id"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"),
                          F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_in_task"))
    return positions(cut(placed), ["path", *LINE_ORDER], by=["run_id"], out="line_no").select("run_id", "line_no", "line")


def expected_files(manifest: DataFrame, listing: DataFrame, pattern: str = r"run=([^/]+)") -> DataFrame:
    """`manifest` (run_id, chunk_id) with the files and bytes that were found of each run; a run without a file is MISSING."""
    found = listing.groupBy(run_of(F.col("key"), pattern).alias("run_id")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    joined = manifest.join(found, "run_id", "left")
    return joined.select("run_id", "chunk_id", F.when(F.col("files").isNull(), "MISSING").otherwise("ok").alias("status"),
                         F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def resolve_outputs(candidates: DataFrame, listing: DataFrame) -> DataFrame:
    """First existing path of each run: candidates (run_id, priority, path) against listed paths."""
    found = candidates.join(listing.select("path"), "path", "left_semi")
    best = found.groupBy("run_id").agg(F.min(F.struct("priority", "path")).alias("_b"))
    runs = candidates.select("run_id").distinct()
    return runs.join(best, "run_id", "left").select("run_id", F.col("_b.path").alias("path"))


def merge_runs(manifest: DataFrame, lines: DataFrame) -> DataFrame:
    """Non-blank lines per expected run with `ok` or `MISSING`, and a TOTAL row. Neither parsed nor deduped.

    `manifest` has run_id and chunk_id; a run whose file exists but is empty is passed in as a null line.
    """
    counts = lines.groupBy("run_id").agg(F.count_if(strip(F.coalesce("line", F.lit(""))) != "").alias("n"))
    per_run = manifest.join(counts, "run_id", "left").select(
        F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("chunk"),
        F.col("run_id").cast("string").alias("run"),
        F.when(F.col("n").isNull(), "MISSING").otherwise("ok").alias("status"),
        F.coalesce("n", F.lit(0)).alias("records"))
    total = per_run.agg(F.sum("records").alias("records")).select(
        F.lit("TOTAL").alias("chunk"), F.lit("").alias("run"), F.lit("").alias("status"), "records")
    return per_run.unionByName(total)


def records_per_run(records: DataFrame, run: str = "run_id", key: str = "id") -> DataFrame:
    """Usable records per run before dedupe, and a TOTAL row with all records and the distinct ids: one read, counts
    are reduced to (run, id) and then to (run) and id."""
    each = records.groupBy(run, key).agg(F.count(F.lit(1)).alias("_n"))
    both = each.select(F.inline(F.array(F.struct(F.col(run).cast("string").alias("run"), F.col(key).alias("_id"), "_n"),
                                        F.struct(F.lit("TOTAL").alias("run"), F.col(key).alias("_id"), "_n"))))
    return (both.groupBy("run", "_id").agg(F.sum("_n").alias("_n"))
            .groupBy("run").agg(F.sum("_n").alias("loaded"), F.count(F.lit(1)).alias("distinct_n")))

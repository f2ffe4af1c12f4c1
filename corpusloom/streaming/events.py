"""Event log on Structured Streaming: exactly-once append, live status, live transcript text.

Results go to files on the shared folder; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..fixed_values import TERMINAL_STATUSES
from ..operators.ledger import status_aggregates, status_columns
from ..operators.ordering import first_per_key
from ..operators.sessions import assemble_transcript
from ..session import scratch_path

__all__ = ["stream_events", "stream_dedupe", "append_to_files", "stream_status", "latest_status",
           "stream_fragments", "stream_transcript", "drain"]


def stream_events(spark: SparkSession, path: str, schema: StructType | str, pattern: str | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; `pattern` selects file names."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_dedupe(events: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """One event per key. Without `delay` keys are remembered for good and nothing is lost; with it, state
    older than the watermark is dropped, for sources that bound how late a retry can come."""
    if delay is None:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def drain(query) -> None:
    """Wait for an available-now query and raise what it raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def append_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is available and return its output as a table."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start())
    drain(query)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_status(events: DataFrame, terminal: Sequence[str] = TERMINAL_STATUSES) -> DataFrame:
    """Live status per run: the batch fold as streaming state, so late events land in their place."""
    folded = events.groupBy("run_id").agg(*status_aggregates(terminal))
    return folded.withColumns(status_columns()).select(
        "run_id", "status", "started_at", "finished_at", "last_heartbeat_at", "events_n")


def latest_status(status: DataFrame, label: str = "status") -> DataFrame:
    """Run the status stream over what is available; the last update of each run."""
    spark = status.sparkSession
    out = scratch_path(spark, label)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={batch_id}")

    query = (status.writeStream.outputMode("update").foreachBatch(keep)
             .option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start())
    drain(query)
    updates = spark.read.schema(StructType([*status.schema.fields, StructField("batch", LongType())])).parquet(f"{out}/data")
    return first_per_key(updates, ["run_id"], [F.desc("batch")]).drop("batch")


def stream_fragments(events: DataFrame, run: str, seq: str, text: str, spoken: str) -> DataFrame:
    """The text rows of a stream, ready to append: (run_id, seq, text), null text for other events."""
    return events.select(F.col(run).alias("run_id"), F.col(seq).alias("seq"),
                         F.when(F.expr(spoken), F.col(text)).alias("text"))


def stream_transcript(fragments: DataFrame, label: str = "transcript") -> DataFrame:
    """Append fragments as they come and assemble the transcripts from what has been written.

    The stream keeps no state: a run of any length costs appended rows, and the text is put together
    in bounded parts on read.
    """
    return assemble_transcript(append_to_files(fragments, label), "run_id", "seq", "text")

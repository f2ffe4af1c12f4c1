"""Contiguous chunks in id order and their manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import positions
from .profile import row_total


def chunk(df: DataFrame, k: int, order: Sequence[str], out: str = "chunk_id") -> DataFrame:
    """Slices of ceil(n / k) rows in a total order; the last is short and empty ones do not occur.

    Rows are cut into ranges of the order, null keys first, and numbered range by range: one plan for any k.
    """
    size = F.ceil(row_total(df).scalar() / F.lit(k))
    ranked = positions(df, list(order), out="_pos")
    return ranked.withColumn(out, (F.floor((F.col("_pos") - 1) / size) + 1).cast("int")).drop("_pos")


def chunk_manifest(chunks: DataFrame, id_col: str, batch_id: str, chunk_col: str = "chunk_id",
                   prefix: str = "inputs") -> DataFrame:
    """Per chunk: rows, id range, data and run locations; `total` repeats the batch size."""
    base = F.format_string(f"{prefix}/{batch_id}/chunk_%02d", F.col(chunk_col))
    per_chunk = chunks.groupBy(chunk_col).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))
    per_chunk = per_chunk.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))  # k rows
    return per_chunk.select(
        F.lit(batch_id).alias("batch_id"), chunk_col, "n", "total",
        "first_id", "last_id",
        F.concat(base, F.lit("/services.jsonl")).alias("services_uri"),
        F.concat(base, F.lit("/run.json")).alias("run_uri"))

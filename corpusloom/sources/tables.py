"""Corpus tables in and subsets out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan of the named columns; missing ones are left out, as the profile reports them."""
    df = spark.read.parquet(path)
    return df if cols is None else df.select(*[c for c in cols if c in df.columns])


# Columns of the run ledger and its event log, with the types that the operators rely on.
RUN_COLUMNS = {"id": "bigint", "pipeline_id": "bigint", "status": "string", "created_at": "timestamp_ntz"}
EVENT_COLUMNS = {"run_id": "bigint", "seq": "bigint", "event_type": "string", "ts": "timestamp_ntz"}


def _contract(df: DataFrame, columns: Mapping[str, str], names: Mapping[str, str]) -> DataFrame:
    missing = [c for c in columns if names.get(c, c) not in df.columns]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    return df.select(*[F.col(names.get(c, c)).cast(t).alias(c) for c, t in columns.items()])


def read_runs(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """The run ledger, in its contract's columns and types; `names` says which column of the files is which."""
    return _contract(spark.read.parquet(path), RUN_COLUMNS, names or {})


def read_events(spark: SparkSession, path: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """The event log, in its contract's columns and types."""
    return _contract(spark.read.parquet(path), EVENT_COLUMNS, names or {})


def subset_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id was picked, all columns."""
    return df.join(ids.select(id_col), id_col, "left_semi").select(*df.columns)


def write_subset(df: DataFrame, ids: DataFrame, path: str, id_col: str = "id") -> None:
    subset_by_ids(df, ids, id_col).write.mode("overwrite").option("compression", "zstd").parquet(path)


def json_rows(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One JSON object per row in column `value`, nulls written, text unescaped."""
    return df.select(F.to_json(F.struct(*keep), {"ignoreNullFields": "false"}).alias("value"))


def export_jsonl(df: DataFrame, keep: Sequence[str], path: str, partition_by: Sequence[str] = ()) -> None:
    """JSON lines with explicit nulls, one folder per partition value."""
    writer = df.select(*keep, *[c for c in partition_by if c not in keep]).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("ignoreNullFields", "false").json(path)


def write_artifacts(df: DataFrame, path: str, key: str, text: str, files: int = 200) -> None:
    """Texts with their artifact keys, many runs to a file: `path` gets (key, text) rows sorted by key within at most
    `files` ranges of it, so one artifact is found by the row groups' statistics. A folder and a file for each of
    millions of runs would be all listing."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows.repartitionByRange(files, "key").sortWithinPartitions("key").write.mode("overwrite").option("compression", "zstd").parquet(path)

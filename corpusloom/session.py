"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def build_session(app_name: str = "corpusloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned for; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # lets `row_number() <= k` prune inside each map task for larger k than the default 1000
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
        # record checks are heavy per byte, so small shuffles keep more tasks than the 1 MB default allows
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64kb",
        # building a column asks the JVM for its call site otherwise; wide rule sets build thousands
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`, or where that is unset one in the warehouse, which
    tables of the session share already."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder: later reads agree with each other, survive lost
    executors, fetch only the columns they use, and have a known size."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def last_key_wins(spark: SparkSession) -> None:
    """JSON objects that repeat a key keep its last value, instead of being unreadable."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

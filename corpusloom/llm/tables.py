"""Readers, written cuts, bounded samples and connected components shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Rows and bytes of an Arrow batch on its way to a Python worker: the worker's memory follows them.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends Python workers batches of at most `BATCH_ROWS` rows and about `BATCH_BYTES`."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % n


def threshold_sample(rows: DataFrame, group: str, per_group: int, key: Column) -> DataFrame:
    """At most `per_group` rows of each value of `group`, the least by the 64-bit hash `key`. Groups are counted first,
    so that only rows under a threshold of the key (the limit and five deviations over the count) are ranked: a task
    reads little more than the limit of a group, however many rows and partitions there are. Rows of equal key
    are in or out together until the rank cuts them."""
    from pyspark.sql import Window

    sizes = rows.groupBy(group).agg(F.count("*").alias("_rows"))
    slack = per_group + 5 * per_group ** 0.5 + 25
    unit = F.pmod(F.col("_key"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    # a row for each group, which are fewer than what a model keeps of each; a shuffle by group would gather all rows
    near = rows.withColumn("_key", key).join(F.broadcast(sizes), group).where(unit * F.col("_rows") <= slack)
    return (near.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_key"))).where(F.col("_rank") <= per_group)
            .drop("_rank", "_rows", "_key"))


PIECE_CHARS = 8_192  # of a text that a model learns from


def piece_of(text: Column, key: Column, chars: int = PIECE_CHARS) -> Column:
    """The text, or of a longer one `chars` characters from a place that `key` chooses."""
    room = F.greatest(F.char_length(text) - F.lit(chars) + 1, F.lit(1))
    return F.substring(text, F.lit(1) + F.pmod(key, room).cast("int"), F.lit(chars))


def labelled_sample(documents: DataFrame, labels: DataFrame, column: str, per_label: int, seed: int, allowed: Column | None = None,
                    piece_chars: int = PIECE_CHARS):
    """(table of y and text, share of label 1): at most `per_label` documents of each label 0 and 1 in `column`, one row
    for a doc_id, texts by a piece (`piece_of`), sorted by label and text. The bound holds whatever repeats: ids that
    are labelled both ways or have no text teach nothing, and of rows that repeat an id the least piece is taken,
    added up within each task first."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & (F.lit(True) if allowed is None else allowed))
    known = (known.groupBy("doc_id").agg(F.min(column).alias("y"), F.max(column).alias("_other")).where(F.col("y") == F.col("_other")).select("doc_id", "y"))
    here = documents.where(F.col("text").isNotNull()).select("doc_id").distinct()
    known = cut(known.join(here, "doc_id", "left_semi"))
    picks = threshold_sample(known, "y", per_label, F.xxhash64("doc_id", F.lit(seed)))
    # at most 2 x per_label keys by construction, so the broadcast has a fixed bound and texts stay where they are
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picks), "doc_id")
    rows = rows.groupBy("y", "doc_id").agg(F.min(piece_of(F.col("text"), F.xxhash64("doc_id", F.lit(seed)), piece_chars)).alias("text"))
    share = known.agg(F.avg("y")).first()[0]
    return rows.select("y", "text").toArrow().sort_by([("y", "ascending"), ("text", "ascending")]), share


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for the ids of `edges` (a, b): component is the smallest id that can be reached.

    Every round hangs each id under the smallest label among its neighbours' labels, then halves paths by a
    look-up of the label's own label. Rounds are cut by written tables, so a lost executor costs one round.
    """
    both = cut(edges.select(F.col("a").alias("id"), F.col("b").alias("other"))
               .union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy("id").agg(F.min("other").alias("o")).select("id", F.least("id", "o").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("other"), F.col("label").alias("near")), "other")
        low = seen.groupBy("id").agg(F.min("near").alias("near"))
        step = labels.join(low, "id").select("id", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        # the label of the old label may be lower still
        above = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        step = cut(step.join(above, "label", "left").select("id", "before", F.least("label", "up").alias("label")))
        moved = step.where(F.col("label") != F.col("before")).limit(1).count()
        labels = step.select("id", "label")
        if not moved:
            return labels.select("id", F.col("label").alias("component"))

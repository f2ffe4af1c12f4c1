"""Top-k, dedupe, running totals and positions that never put one large group into one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

# A group up to this many rows is left to one task, which sorts it with spill; larger ones are split.
HOT_ROWS = 5_000_000
# A table is broadcast only after its rows were counted and found to be at most this many.
MAX_BROADCAST_ROWS = 100_000
# Groups are pre-ranked in so many parts; one task ranks up to SALTS x RANKED_K rows of a group.
SALTS, RANKED_K = 16, 100_000


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in `order`. The rank limit prunes to one row per key inside each
    map task, so a key holding a third of the table ships one row per task."""
    w = W.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def top_k_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: int,
                    out: str = "rank") -> DataFrame:
    """The first `k` rows of every group in a total `order`, ranked from 1.

    Rows are ranked within (group, salt) and then within the group, so that the last task of a group sees k rows
    per salt. The salt follows the input partition and cannot change which rows win. Beyond `RANKED_K` rows a
    group's ranks come from range slices instead, as its first rows alone may be too many for a task.
    """
    order = _cols(order)
    if k > RANKED_K:
        return positions(df, order, by=by, out=out, hot_rows=RANKED_K).withColumn(out, F.col(out).cast("int")).where(F.col(out) <= k)
    salted = W.partitionBy(*by, "_salt").orderBy(*order)
    pruned = (df.withColumn("_salt", F.spark_partition_id() % SALTS).withColumn("_pre", F.row_number().over(salted))
                .where(F.col("_pre") <= k).drop("_pre", "_salt"))
    return (pruned.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
                  .where(F.col(out) <= k))


def running_totals(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
                   weight: Column | None = None, out: str = "before") -> DataFrame:
    """Sum of `weight` (default: row count) over the rows ahead of each row in its group.

    Rows are range-partitioned on group and order, so a hot group spans many slices; the sum inside a
    slice is a window, the sum of earlier slices comes from one small row per (group, slice).
    """
    order = _cols(order)
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    by = list(by)
    ahead = (W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = cut(df.withColumn("_w", weight)
                   .repartitionByRange(parts, *_cols(by), *order)
                   .withColumn("_slice", F.spark_partition_id()))
    totals = sliced.groupBy(*by, "_slice").agg(F.sum("_w").alias("_t"))
    # one row per (group, slice): at most `parts` rows in any group
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(*ahead)
    offsets = totals.withColumn("_off", F.coalesce(F.sum("_t").over(earlier), zero)).drop("_t")
    local = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(*ahead)
    inside = sliced.withColumn("_in", F.coalesce(F.sum("_w").over(local), zero))
    joined = inside.join(offsets, same_keys(inside, offsets, [*by, "_slice"]), "inner")
    keep = [inside[c] for c in df.columns]
    return joined.select(*keep, (inside["_in"] + offsets["_off"]).alias(out))


def counted_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df`, hinted for broadcast when it has at most `max_rows` rows. Pass a materialised table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of groups above `hot_rows` or None). There can be no more hot groups
    than rows / hot_rows, so the list of them stays small however large the table is."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = cut(counts.select(*keys))
    if hot.isEmpty():
        return df, None
    listed = counted_broadcast(hot)
    match = same_keys(df, listed, keys)
    return df.join(listed, match, "left_anti"), df.join(listed, match, "left_semi")


def _sliced_positions(df: DataFrame, order: list[Column], by: list[str], out: str) -> DataFrame:
    """Row numbers from one range shuffle: the place inside a slice comes with the sort, the offset of
    the slice from the first row of each (group, slice)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *_cols(by), *order).sortWithinPartitions(*_cols(by), *order)
    placed = cut(ranged.withColumn("_mid", F.monotonically_increasing_id())
                       .withColumn("_slice", F.shiftright("_mid", 33)))
    heads = placed.groupBy(*by, "_slice").agg(F.min("_mid").alias("_head"), F.count(F.lit(1)).alias("_n"))
    # one row per (group, slice): at most `parts` rows in any group
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    heads = cut(heads.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    listed = counted_broadcast(heads)
    joined = placed.join(listed, same_keys(placed, listed, [*by, "_slice"]), "inner")
    return joined.select(*[placed[c] for c in df.columns], (F.col("_off") + F.col("_mid") - F.col("_head") + 1).alias(out))


def positions(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "position",
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number per group in a total `order`.

    Ordinary groups are numbered by a window. A table numbered as a whole, or a group above `hot_rows`,
    is cut into ranges instead.
    """
    order, by = _cols(order), list(by)

    def windowed(rows: DataFrame) -> DataFrame:
        return rows.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))

    if not by:
        return _sliced_positions(df, order, by, out)
    ordinary, hot = split_hot(df, by, hot_rows)
    numbered = windowed(ordinary)
    return numbered if hot is None else numbered.unionByName(_sliced_positions(hot, order, by, out))


def top_k(df: DataFrame, order: Sequence[str | Column], k: int) -> DataFrame:
    return df.orderBy(*_cols(order)).limit(k)

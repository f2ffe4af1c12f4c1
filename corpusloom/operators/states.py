"""Reports from small mergeable states: quantiles, distinct unions and frequent values without reading data again.

A state is a sketch of some rows: a row for each input file, bucket or group. States of more rows are states of fewer
merged, so a report over everything reads states only, and a new file costs one scan of itself. Answers have a known
error: quantiles in rank (`KLL_RANK_ERROR`), distinct counts relative to their size (`distinct_error`), frequent
values by what a full table of counters can lose (`lost_count`). The exact operators are in `profile` and `segments`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.artifacts import file_path, list_data
from .ordering import top_k, top_k_per_group

KLL_K = 400
KLL_RANK_ERROR = 0.008  # for k = 400, at 99 % confidence
THETA_LG = 14
TOP_ITEMS = 10_000


# -- quantiles kept by file ------------------------------------------------------------------------

def value_states(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, null_n, min, max, sketch) of a whole-number column."""
    v = F.col(value).cast("bigint")
    return values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("null_n"), F.min(v).alias("min"), F.max(v).alias("max"),
                                   F.kll_sketch_agg_bigint(v, KLL_K).alias("sketch"))


def merged_values(states: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, n, null_n, min, max, p<percent>...): each quantile's rank is within `KLL_RANK_ERROR` of the asked one."""
    whole = states.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("null_n").alias("null_n"), F.min("min").alias("min"), F.max("max").alias("max"),
                                    F.kll_merge_agg_bigint(F.when(F.col("n") > F.col("null_n"), F.col("sketch"))).alias("_s"))
    quantiles = [F.when(F.col("n") > F.col("null_n"), F.kll_sketch_get_quantile_bigint("_s", F.lit(p))).alias(f"p{round(p * 100):02d}") for p in probs]
    return whole.select(*by, "n", "null_n", "min", "max", *quantiles)


def update_file_states(spark: SparkSession, data: str, states: str, values: dict[str, str]) -> int:
    """Add the states of the files below `data` (Parquet) that `states` does not hold yet, and say how many files were
    read. `values` maps a field's name to its SQL expression. A file that was changed is another file: its older state
    is left out on read. The names of new files pass through the driver, as in any listing."""
    listing = list_data(spark, data, "*.parquet").select(F.col("key").alias("file"), "bytes", "modified")
    names = ["file", "bytes", "modified"]
    try:
        listing = listing.join(spark.read.parquet(states).select(*names).distinct(), names, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    new = listing.collect()
    if not new:
        return 0
    rows = spark.read.parquet(*[f"{data.rstrip('/')}/{r.file}" for r in new])
    key = F.struct(F.substring_index(file_path(), data.rstrip("/").rpartition("/")[2] + "/", -1).alias("file"), F.col("_metadata.file_size").alias("bytes"),
                   F.col("_metadata.file_modification_time").alias("modified"))
    long = rows.select(key.alias("key"), F.inline(F.array(*[F.struct(F.lit(n).alias("field"), F.expr(e).cast("bigint").alias("value")) for n, e in values.items()])))
    value_states(long.select("key.*", "field", "value"), [*names, "field"], "value").write.mode("append").parquet(states)
    return len(new)


def profile_from_states(spark: SparkSession, data: str, states: str, probs: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """The profile of the files that are below `data` now, from their states alone."""
    now = list_data(spark, data, "*.parquet").select(F.col("key").alias("file"), "bytes", "modified")
    return merged_values(spark.read.parquet(states).join(now, ["file", "bytes", "modified"], "left_semi"), ["field"], probs)


# -- distinct ids over buckets ---------------------------------------------------------------------

def id_states(rows: DataFrame, by: Sequence[str], id_col: str, lg: int = THETA_LG) -> DataFrame:
    """(by, ids): a set sketch of the distinct ids of each group."""
    return rows.groupBy(*by).agg(F.theta_sketch_agg(id_col, lg).alias("ids"))


def union_size(states: DataFrame, by: Sequence[str], lg: int = THETA_LG) -> DataFrame:
    """(by, n): distinct ids of the merged states, none counted twice."""
    return states.groupBy(*by).agg(F.theta_sketch_estimate(F.theta_union_agg("ids", lg)).alias("n"))


def overlap_size(a: Column, b: Column) -> Column:
    """Distinct ids that two states share."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b))


def distinct_error(lg: int = THETA_LG, deviations: float = 3.0) -> float:
    """Relative error of a union's size; up to 2^lg ids the size is exact."""
    return deviations / 2 ** (lg / 2)


def cumulative_tiers(states: DataFrame, tiers: Sequence[int], lg: int = THETA_LG) -> DataFrame:
    """(max_tier, n): distinct ids within tiers 1..t for every t, from states by `tier`."""
    reach = states.select(F.explode(F.filter(F.array(*[F.lit(t) for t in tiers]), lambda t: t >= F.col("tier"))).alias("max_tier"), "ids")
    return union_size(reach, ["max_tier"], lg)


# -- frequent values -------------------------------------------------------------------------------

def frequent_states(rows: DataFrame, by: Sequence[str], value: str, items: int = TOP_ITEMS) -> DataFrame:
    """(by, n, top): the rows of each group with a value, and counters of at most `items` values."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k_accumulate(`{value}`, {items})").alias("top"))


def frequent_values(states: DataFrame, k: int, by: Sequence[str] = (), items: int = TOP_ITEMS) -> DataFrame:
    """(by, value, n): the k most frequent values of the merged states, ties by value. Counts are exact while the merged
    states hold no more than three quarters of `items` different values; else a value that occurs more often than
    `lost_count` is among the counters for certain, and its count is too high by no more than that."""
    whole = states.groupBy(*by).agg(F.expr(f"approx_top_k_combine(top, {items})").alias("_top"))
    found = whole.select(*by, F.inline(F.expr(f"approx_top_k_estimate(_top, {items})"))).select(*by, F.col("item").alias("value"), F.col("count").alias("n"))
    return top_k_per_group(found, list(by), [F.desc("n"), F.asc("value")], k) if by else top_k(found, [F.desc("n"), F.asc("value")], k)


def lost_count(rows: int, items: int = TOP_ITEMS) -> float:
    """Occurrences that a value's counter may lack after `rows` rows."""
    return 3.5 * rows / items

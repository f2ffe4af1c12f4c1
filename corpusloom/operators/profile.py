"""Corpus profile: fill rates, length and score distributions, value counts, cross-tabs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.predicates import card_bucket, fill_state, filled, richness_stratum, score_bucket
from .ordering import running_totals, same_keys, top_k

STRATA = ("rich", "norm_only", "sparse")


def with_share(counts: DataFrame, n: str, total: DataFrame | None = None, out: str = "share") -> DataFrame:
    """Add n / total; total defaults to the sum of `n`, a zero total gives 0.

    The total is a scalar subquery: one value, no join and no single-task window.
    """
    whole = (total if total is not None else counts.agg(F.sum(n))).scalar()
    return counts.withColumn(out, F.coalesce(F.try_divide(F.col(n), whole), F.lit(0.0)))


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)))


def value_counts(df: DataFrame, col: str, k: int | None = None) -> DataFrame:
    """Rows per value with its share of the table; `k` keeps the most frequent, ties by value."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = with_share(counts, "n", total=row_total(df))
    return counts if k is None else top_k(counts, [F.desc("n"), F.asc("value")], k)


def array_value_counts(df: DataFrame, col: str, k: int = 30) -> DataFrame:
    """Most frequent array elements."""
    values = df.select(F.explode(col).alias("value"))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.desc("n"), F.asc_nulls_last("value")], k)


def frequency(df: DataFrame, col: str, k: int = 80) -> DataFrame:
    """Value frequency of a column, element-wise when the schema says array; nulls left out of scalars."""
    if isinstance(df.schema[col].dataType, ArrayType):
        return array_value_counts(df, col, k)
    return top_k(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
                   .agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc("value")], k)


def fill_rates(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per field with the count of each fill state, in one scan. Fields the table lacks are
    reported as `MISSING` with null counts."""
    present = [f for f in fields if f in df.columns]
    states = ("null", "empty", "whitespace", "filled")
    # only the state of each field leaves the scan stage, not its text
    state = df.select(*[fill_state(f).alias(f) for f in present])
    counts = state.agg(F.count(F.lit(1)).alias("_all"),
                       *[F.count_if(F.col(f) == s).alias(f"{f}.{s}") for f in present for s in states])
    rows = []
    for f in fields:
        known = f in present
        rows.append(F.struct(
            F.lit(f).alias("field"),
            F.lit("ok" if known else "MISSING").alias("status"),
            *[(F.col(f"`{f}.{s}`") if known else F.lit(None).cast("bigint")).alias(f"{s}_n") for s in states],
            (F.try_divide(F.col(f"`{f}.filled`"), F.col("_all")) if known else F.lit(None).cast("double"))
            .alias("filled_share")))
    return counts.select(F.inline(F.array(*rows)))


def distribution(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, null_n, min, max, mean and exact interpolated quantiles p<percent> of `value`.

    Each distinct (group, value) is counted, and a quantile's two neighbours are found by running totals over
    those counts, so no task holds the values of a group.
    """
    by = list(by)
    names = [f"p{round(p * 100):02d}" for p in probs]
    rows = df.select(*by, F.col(value).alias("_v"))
    basics = [F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v").isNull()).alias("null_n"),
              F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean")]
    freq = rows.where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(freq, ["_v"], by=by, weight=F.col("_n"), out="_before")
    groups = rows.groupBy(*by).agg(*basics)
    if by:
        sizes = placed.groupBy(*by).agg(F.sum("_n").alias("_size"))
        placed = placed.join(sizes, same_keys(placed, sizes, by)).select(placed["*"], "_size")
    else:
        placed = placed.withColumn("_size", placed.agg(F.sum("_n")).scalar())

    def neighbour(p: float, up: bool) -> Column:
        at = p * (F.col("_size") - 1)
        rank = F.ceil(at) if up else F.floor(at)
        here = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col("_v")))

    marks = placed.groupBy(*by).agg(
        F.max("_size").alias("_size"),
        *[neighbour(p, False).alias(f"_lo{i}") for i, p in enumerate(probs)],
        *[neighbour(p, True).alias(f"_hi{i}") for i, p in enumerate(probs)])
    quantiles = []
    for i, (p, nm) in enumerate(zip(probs, names)):
        at = p * (F.col("_size") - 1)
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        quantiles.append((lo + (at - F.floor(at)) * (hi - lo)).alias(nm))
    marks = marks.select(*by, *quantiles)
    if by:
        joined = groups.join(marks, same_keys(groups, marks, by), "left")
        return joined.select(groups["*"], *[marks[nm] for nm in names])
    # one struct-valued subquery for all quantiles
    return groups.withColumn("_q", marks.select(F.struct(*names)).scalar()).select("*", "_q.*").drop("_q")


def length_profile(df: DataFrame, fields: Sequence[str], probs: Sequence[float] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Character-length distribution of every non-blank text field, one scan."""
    present = [f for f in fields if f in df.columns]
    lengths = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("field"), F.when(filled(f), F.length(f)).alias("_len")) for f in present])))
    dist = distribution(lengths.where(F.col("_len").isNotNull()), "_len", probs, by=["field"])
    return dist.drop("null_n", "mean")


def numeric_profile(df: DataFrame, col: str, by: str | None = None,
                    probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    narrow = df.select(*([by] if by else []), col)
    return distribution(narrow, col, probs, by=[by] if by else [])


def card_buckets(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(card_bucket(col).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n")


def score_buckets(df: DataFrame, col: str) -> DataFrame:
    counts = df.groupBy(score_bucket(col).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n")


def crosstab(df: DataFrame, **exprs: Column) -> DataFrame:
    """Row counts and shares over any number of derived keys."""
    counts = df.groupBy(*[e.alias(name) for name, e in exprs.items()]).agg(F.count(F.lit(1)).alias("n"))
    return with_share(counts, "n")


def strata_counts(df: DataFrame, texts: Sequence[str], array: str, long_text: str | None = None,
                  min_len: int = 200) -> DataFrame:
    """Totals of the three strata in one row; strata with no rows show 0."""
    stratum = df.select(richness_stratum(texts, array, long_text, min_len).alias("stratum"))
    return stratum.agg(*[F.count_if(F.col("stratum") == s).alias(f"{s}_n") for s in STRATA],
                       F.count(F.lit(1)).alias("total_n"))

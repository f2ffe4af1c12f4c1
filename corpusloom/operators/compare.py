"""Field-by-field comparison of two extraction runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compute import once
from .ordering import top_k
from .records import conflict_items, record_fields
from .rules import FieldRule


def align_runs(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Counts of ids in both runs, only in A, only in B; ids are unique per run."""
    left = a.select(key).withColumn("_a", F.lit(1))
    right = b.select(key).withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("common")
    return left.join(right, key, "full_outer").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def paired(a: DataFrame, b: DataFrame, fields: Sequence[FieldRule], key: str = "id") -> DataFrame:
    """Common ids with `pairs`: per field the filled flags and comparable values of both runs.

    The runs are joined with one row per id and record; fields are unfolded only afterwards. They take many times the
    memory of a record, but Spark estimates them as far smaller and would broadcast a whole unfolded run.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.col("record").alias(f"_r{name}"))

    def pair(x: Column, y: Column) -> Column:
        return F.struct(x["field"].alias("field"), x["filled"].alias("filled_a"), y["filled"].alias("filled_b"),
                        x["value"].alias("a"), y["value"].alias("b"))

    joined = side(a, "a").join(side(b, "b"), key, "inner")
    unfolded = F.zip_with(record_fields(fields, "_ra"), record_fields(fields, "_rb"), pair)
    return once(joined, conflicts_a=F.size(conflict_items(F.col("_ra"))), conflicts_b=F.size(conflict_items(F.col("_rb"))),
                pairs=unfolded).drop("_ra", "_rb")


def compare_fields(pairs: DataFrame) -> DataFrame:
    """Per field: filled in A, in B, in both, equal; agree_pct is null when never both filled."""
    rows = pairs.select(F.inline("pairs"))
    both = F.col("filled_a") & F.col("filled_b")
    counts = rows.groupBy("field").agg(
        F.count_if("filled_a").alias("filled_a_n"), F.count_if("filled_b").alias("filled_b_n"),
        F.count_if(both).alias("both_n"), F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("agree_n"))
    return counts.withColumn("agree_pct", F.try_divide(F.col("agree_n") * 100, F.col("both_n")))


def compare_coverage(pairs: DataFrame) -> DataFrame:
    """On common ids, per run: ids with a filled field, conflicts, ids with conflicts."""
    def filled(flag: str) -> Column:
        return F.exists("pairs", lambda p: p[flag])

    totals = pairs.agg(
        F.count(F.lit(1)).alias("common_n"),
        *[F.count_if(filled(f"filled_{s}")).alias(f"covered_{s}") for s in "ab"],
        *[F.coalesce(F.sum(f"conflicts_{s}"), F.lit(0)).alias(f"conflicts_{s}") for s in "ab"],
        *[F.count_if(F.col(f"conflicts_{s}") > 0).alias(f"conflicted_{s}") for s in "ab"])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(s.upper()).alias("run"), F.col("common_n"), F.col(f"covered_{s}").alias("covered_n"),
                 F.col(f"conflicts_{s}").alias("conflicts_n"), F.col(f"conflicted_{s}").alias("with_conflicts_n"))
        for s in "ab"])))


def top_disagreements(pairs: DataFrame, k: int = 10, details: int = 8, key: str = "id") -> DataFrame:
    """The `k` ids with most differing fields, highest id first on ties, and their first `details`."""
    differing = F.filter("pairs", lambda p: (p["filled_a"] | p["filled_b"]) & ~p["a"].eqNullSafe(p["b"]))
    counted = once(pairs.select(key, "pairs"), _d=differing).withColumn("diffs_n", F.size("_d"))
    return top_k(counted.select(key, "diffs_n", F.slice("_d", 1, details).alias("details")),
                 [F.desc("diffs_n"), F.desc(key)], k)


def ids_intersect(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def ids_except(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.select(key).subtract(b.select(key))

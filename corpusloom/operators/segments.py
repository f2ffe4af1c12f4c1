"""Rule-based segmentation of parents and of the children attached to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import bucket_predicate
from ..session import cut
from .compute import once
from .profile import row_total, with_share
from .rules import Bucket, literal_rows


def tag_buckets(parents: DataFrame, rules: Sequence[Bucket], codes_col: str | Column,
                text_cols: Sequence[str]) -> DataFrame:
    """Add `buckets`: (no, tier, bucket) of every rule a parent matches. One pass for all rules."""
    hits = [F.when(bucket_predicate(r.codes, r.patterns, codes_col, text_cols),
                   F.struct(F.lit(no).alias("no"), F.lit(r.tier).alias("tier"), F.lit(r.label).alias("bucket")))
            for no, r in enumerate(rules)]
    return once(parents, buckets=F.array_compact(F.array(*hits)))


def segment_counts(children: DataFrame, tagged: DataFrame, rules: Sequence[Bucket], child_id: str,
                   child_parent: str, parent_id: str = "id") -> DataFrame:
    """Distinct parents and children of every bucket, zero counts included; buckets may overlap.

    Only rule numbers travel through the joins and shuffles; labels come back at the end.
    """
    # both counts read the pairs, so they are written once instead of matching every rule twice
    pairs = cut(tagged.select(F.col(parent_id).alias("_pid"), F.explode("buckets").alias("_b"))
                      .select("_pid", F.col("_b.no").alias("no")).distinct())
    parents_n = pairs.groupBy("no").agg(F.count_distinct("_pid").alias("parents_n"))
    kids = children.select(F.col(child_id).alias("_cid"), F.col(child_parent).alias("_pid"))
    children_n = (kids.join(pairs, "_pid", "inner").groupBy("no")
                      .agg(F.count_distinct("_cid").alias("children_n")))
    names = literal_rows(children.sparkSession, ["no", "tier", "bucket"],
                         [(no, r.tier, r.label) for no, r in enumerate(rules)])
    counts = (names.join(parents_n, "no", "left").join(children_n, "no", "left")
                   .fillna(0, ["parents_n", "children_n"]).drop("no"))
    return with_share(counts, "children_n", total=row_total(children))


def children_of(children: DataFrame, tagged: DataFrame, child_parent: str, parent_id: str = "id",
                tier: int | None = None) -> DataFrame:
    """Children whose parent matches a bucket (of `tier`). A semi join: repeated parents add no rows."""
    hit = F.size("buckets") > 0 if tier is None else F.exists("buckets", lambda b: b["tier"] == tier)
    keep = tagged.where(hit).select(F.col(parent_id).alias(child_parent))
    return children.join(keep, child_parent, "left_semi").select(*children.columns)


def has_parent(children: DataFrame, parents: DataFrame, child_parent: str, parent_id: str = "id") -> DataFrame:
    keys = parents.select(F.col(parent_id).alias(child_parent))
    return children.join(keys, child_parent, "left_semi").select(*children.columns)


def parent_coverage(children: DataFrame, parents: DataFrame, child_parent: str, parent_id: str = "id") -> DataFrame:
    """Rows, rows with a parent and their share."""
    attached = row_total(has_parent(children, parents, child_parent, parent_id)).scalar()
    totals = children.agg(F.count(F.lit(1)).alias("children_n")).withColumn("with_parent_n", attached)
    return totals.withColumn("share", F.try_divide("with_parent_n", "children_n"))


def min_tier(children: DataFrame, tagged: DataFrame, child_id: str, child_parent: str,
             parent_id: str = "id") -> DataFrame:
    """Highest-ranked (lowest) tier of every child id, null when no parent matches.

    Parents without a bucket are left out of the join, and null parents are spread over it, so neither makes
    a hot partition.
    """
    best = (tagged.where(F.size("buckets") > 0)
                  .select(F.col(parent_id).alias("_pid"),
                          F.array_min(F.transform("buckets", lambda b: b["tier"])).alias("tier"))
                  .groupBy("_pid").agg(F.min("tier").alias("tier")))
    kids = children.select(F.col(child_id).alias("id"), F.col(child_parent).alias("_pid"), _spread(child_parent, child_id).alias("_salt"))
    joined = kids.join(best.withColumn("_salt", F.lit(0)), ["_pid", "_salt"], "left")
    return joined.groupBy("id").agg(F.min("tier").alias("tier"))


def _spread(key: str, by: str) -> Column:
    """0 for a row with a key; rows without one are spread over as many numbers as a shuffle may have tasks."""
    return F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(10_000)).cast("int")).otherwise(0)


def tier_coverage(children: DataFrame, tagged: DataFrame, tiers: Sequence[int], child_id: str,
                  child_parent: str, parent_id: str = "id") -> DataFrame:
    """Distinct children inside tiers 1..t for every t, none counted twice."""
    per_child = min_tier(children, tagged, child_id, child_parent, parent_id)
    counts = per_child.agg(*[F.count_if(F.col("tier") <= t).alias(f"_t{t}") for t in tiers])
    rows = counts.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("max_tier"), F.col(f"_t{t}").alias("children_n")) for t in tiers])))
    return with_share(rows, "children_n", total=row_total(children))


def unmatched(children: DataFrame, tagged: DataFrame, child_parent: str, parent_id: str = "id",
              child_id: str | None = None) -> DataFrame:
    """Children with no parent, or with a parent row that matches no bucket. `child_id` spreads rows without a parent."""
    inside = (tagged.select(F.col(parent_id).alias(child_parent), (F.size("buckets") > 0).alias("_in"))
                    .groupBy(child_parent).agg(F.bool_and("_in").alias("_in"))
                    .where("_in").select(child_parent))
    salted = children.withColumn("_salt", _spread(child_parent, child_id or child_parent))
    return salted.join(inside.withColumn("_salt", F.lit(0)), [child_parent, "_salt"], "left_anti").select(*children.columns)


def out_of_scope(children: DataFrame, tagged: DataFrame, child_id: str, child_parent: str,
                 parent_id: str = "id") -> DataFrame:
    rest = unmatched(children, tagged, child_parent, parent_id, child_id)
    counts = rest.agg(F.count_distinct(child_id).alias("children_n"))
    return with_share(counts, "children_n", total=row_total(children))


def out_of_scope_by(children: DataFrame, tagged: DataFrame, by: str, child_id: str, child_parent: str,
                    parent_id: str = "id") -> DataFrame:
    rest = unmatched(children, tagged, child_parent, parent_id, child_id)
    return rest.groupBy(by).agg(F.count_distinct(child_id).alias("children_n"))

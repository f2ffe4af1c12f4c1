"""Seeded stratified sampling: weights, quota picks, nested samples, manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SAMPLE_ALPHA, SAMPLE_QUOTAS, SAMPLE_SEED
from ..functions.keys import seeded_hash, weighted_key
from ..functions.predicates import score_boost
from ..session import cut
from .ordering import HOT_ROWS, MAX_BROADCAST_ROWS, top_k_per_group


def with_group_count(df: DataFrame, key: str, out: str = "source_count", keep_null: bool = False,
                     max_broadcast_rows: int = MAX_BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach the row count of each key. Rows with a null key are dropped unless `keep_null`.

    The counts are materialised once and measured. Few keys are broadcast, so the big side is never
    shuffled by a key one value of which may hold a third of the rows. Among many keys only the hot ones
    are broadcast, of which there are at most rows / hot_rows; the others are joined by shuffle.
    """
    counts = cut(df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(out)))

    def attach(rows: DataFrame, side: DataFrame) -> DataFrame:
        match = rows[key].eqNullSafe(side["_k"]) if keep_null else rows[key] == side["_k"]
        return rows.join(side, match, "inner").drop("_k")

    if counts.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return attach(df, F.broadcast(counts))
    hot = F.broadcast(counts.where(F.col(out) > hot_rows))
    rest = df.join(hot, df[key].eqNullSafe(hot["_k"]), "left_anti")
    return attach(df, hot).unionByName(attach(rest, counts.where(F.col(out) <= hot_rows)))


def sample_weights(df: DataFrame, source: str, score: str, alpha: float = SAMPLE_ALPHA,
                   keep_null: bool = False) -> DataFrame:
    """weight = score boost / source_count ** alpha."""
    counted = with_group_count(df, source, keep_null=keep_null)
    return (counted.withColumn("score_boost", score_boost(score))
                   .withColumn("weight", F.col("score_boost") / F.pow(F.col("source_count"), F.lit(alpha))))


def quota_sizes(n: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Rows wanted per stratum, halves to even. Short strata are taken whole by the pick itself."""
    return {name: round(n * share) for name, share in shares.items()}


def _within_quota(stratum: str, rank: str, quotas: Mapping[str, int]) -> Column:
    limit = F.coalesce(*[F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()], F.lit(0))
    return F.col(rank) <= limit


def quota_pick(df: DataFrame, stratum: str, order: Sequence[Column | str], quotas: Mapping[str, int]) -> DataFrame:
    """First `quotas[s]` rows of every stratum s; strata without a quota give none."""
    wanted = df.where(F.col(stratum).isin(*quotas))
    ranked = top_k_per_group(wanted, [stratum], order, max(quotas.values()))
    return ranked.where(_within_quota(stratum, "rank", quotas))


def seeded_pick(df: DataFrame, id_col: str, stratum: str, quotas: Mapping[str, int],
                seed: int | str = SAMPLE_SEED) -> DataFrame:
    """Uniform pick per stratum, ordered by a seeded hash of the id."""
    keyed = df.withColumn("_key", seeded_hash(id_col, seed))
    return quota_pick(keyed, stratum, ["_key", id_col], quotas).drop("_key")


def weighted_stratified_sample(df: DataFrame, id_col: str, stratum: str, weight: str, n: int,
                               shares: Mapping[str, float] = SAMPLE_QUOTAS, seed: int | str = SAMPLE_SEED) -> DataFrame:
    """Weighted sample without replacement per stratum: the k smallest of -ln(u)/w, u from the id's hash."""
    keyed = df.withColumn("_key", weighted_key(id_col, F.col(weight), seed))
    return quota_pick(keyed, stratum, ["_key", id_col], quota_sizes(n, shares)).drop("_key")


def nested_sample(df: DataFrame, id_col: str, stratum: str, weight: str, sizes: Mapping[str, int],
                  shares: Mapping[str, float] = SAMPLE_QUOTAS, seed: int | str = SAMPLE_SEED) -> DataFrame:
    """Samples of several sizes as long rows (sample, ...). The same key ranks all of them, so the
    smaller is contained in the larger by construction."""
    largest = max(sizes.values())
    picked = weighted_stratified_sample(df, id_col, stratum, weight, largest, shares, seed)
    labels = F.array(*[F.when(_within_quota(stratum, "rank", quota_sizes(n, shares)), F.lit(name))
                       for name, n in sizes.items()])
    return picked.withColumn("sample", F.explode(F.array_compact(labels)))


def subset_violations(inner: DataFrame, outer: DataFrame, id_col: str) -> DataFrame:
    """Ids of `inner` that `outer` lacks; empty when the samples nest."""
    return inner.select(id_col).join(outer.select(id_col), id_col, "left_anti")


def sampling_manifest(picks: DataFrame, stratum: str, source: str, score: str) -> DataFrame:
    """Per sample and stratum: rows, median and mean score, rows per source as a map.

    The sample is materialised once, so the corpus is not sampled again for the second aggregate. The map
    holds the sources of a sample, not of the corpus.
    """
    picks = cut(picks.select("sample", stratum, source, score))
    scores = picks.groupBy("sample", stratum).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(F.col(score), 0.5).alias("score_p50"),
        F.avg(score).alias("score_mean"))
    per_source = (picks.groupBy("sample", stratum, F.col(source).alias("_src")).agg(F.count(F.lit(1)).alias("_n"))
                  .groupBy("sample", stratum)
                  .agg(F.map_from_entries(F.collect_list(F.struct("_src", "_n"))).alias("by_source")))
    return scores.join(per_source, ["sample", stratum], "left")
